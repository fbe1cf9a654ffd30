"""Time: windows of assets, scene cuts, frame statistics, transcripts joined by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import replies
from ..functions import text as tx
from .ordered import lagged, running


def fixed_windows(assets: DataFrame, width: float) -> DataFrame:
    """(asset, segment_id "seg-0000", start_sec, end_sec), to a hundredth; an asset without length is one empty window."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_sec") / width))
    out = assets.select("asset", "duration_sec", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("i"))
    end = F.least("duration_sec", (F.col("i") + 1) * F.lit(float(width)))
    return out.select("asset", F.format_string("seg-%04d", "i").alias("segment_id"), F.round(F.col("i") * F.lit(float(width)), 2).alias("start_sec"), F.round(F.greatest(end, F.lit(0.0)), 2).alias("end_sec"))


def frame_times(start: Column, end: Column, n: int = 3) -> Column:
    """n evenly spaced times from start, without end; none if there is no length."""
    return F.when(end <= start, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + i * (end - start) / n))


def evidence_times(start: Column, end: Column, n: int, change: Column | None = None) -> Column:
    """Up to n distinct times: near the start, the middle, near the end, a change point and even ones."""
    at = lambda share: F.round(start + (end - start) * share, 3)
    extra = [F.round(change, 3)] if change is not None else []
    even = [at((i + 1) / (n + 1)) for i in range(n)]
    return F.slice(F.array_distinct(F.filter(F.array(at(0.06), at(0.5), at(0.94), *extra, *even), lambda x: x.isNotNull())), 1, n)


#: Seconds of an asset whose frames are ordered in one task.
SPAN = 600.0


def _changed(frames: DataFrame, keys: list[str], bucket: Column | None) -> tuple[DataFrame, Column]:
    """frames with `diff`, the change of gray from the frame before, and the range of time each is in."""
    at = F.floor(F.col("t") / SPAN) if bucket is None else bucket
    out = lagged(frames, keys, at, ["t"], F.col("gray"), "before_")
    return out.withColumn("diff", F.abs(F.col("gray") - F.col("before_"))).drop("before_"), at


def scenes(frames: DataFrame, threshold: float = 22.0, bucket: Column | None = None) -> DataFrame:
    """Scenes of sampled frames (asset, t, gray): a new one begins where gray changes by the threshold (gaps and islands).

    bucket tells the range of time of a frame where t is no number of seconds."""
    moved, at = _changed(frames, ["asset"], bucket)
    cut = F.coalesce((F.col("diff") >= threshold).cast("int"), F.lit(0))
    marked = running(moved.withColumn("cut_", cut), ["asset"], at, ["t"], {"scene": F.col("cut_")})
    return marked.groupBy("asset", "scene").agg(F.min("t").alias("start_sec"), F.max("t").alias("end_sec"), F.count("*").alias("frames"))


def change_points(frames: DataFrame, bucket: Column | None = None) -> DataFrame:
    """The time of the greatest change of gray of each segment (asset, segment_id, t, gray), the first if equal."""
    diff = _changed(frames, ["asset", "segment_id"], bucket)[0].filter("diff is not null")
    return diff.groupBy("asset", "segment_id").agg(F.max_by(F.col("t"), F.struct("diff", -F.col("t"))).alias("change_sec"))


def visual_statistics(frames: DataFrame, bucket: Column | None = None) -> DataFrame:
    """(asset, segment_id, brightness, contrast, motion, visual_signature) of frames (asset, segment_id, t, gray, deviation)."""
    moved = _changed(frames, ["asset", "segment_id"], bucket)[0]
    out = moved.groupBy("asset", "segment_id").agg(F.avg("gray").alias("brightness"), F.avg("deviation").alias("contrast"), F.coalesce(F.avg("diff"), F.lit(0.0)).alias("motion"))
    return out.withColumn("visual_signature", F.substring(F.md5(F.concat_ws("|", *(F.round(c, 2).cast("string") for c in ("brightness", "contrast", "motion"))).cast("binary")), 1, 12))


def distinct_frames(frames: DataFrame) -> DataFrame:
    """The first frame of each whole-number mean of a segment."""
    first = Window.partitionBy("asset", "segment_id", F.floor("gray")).orderBy("t")
    return frames.withColumn("n_", F.row_number().over(first)).filter("n_ = 1").drop("n_")


def frame_hash(frames: DataFrame) -> DataFrame:
    """(asset, segment_id, frame_hash) of small frames (asset, segment_id, t, height, width, pixels binary) in order of time: 16 hex
    characters over their sizes and pixels; a segment whose frames are all null has the hash of `empty`, of 12.

    Frames are hashed one by one before they meet, so a segment's cell holds a hash for each."""
    own = F.sha1(F.concat(F.format_string("(%d, %d, 3)", "height", "width").cast("binary"), F.col("pixels")))
    each = frames.select("asset", "segment_id", F.when(F.col("pixels").isNotNull(), F.struct("t", own.alias("h"))).alias("x"))
    joined = each.groupBy("asset", "segment_id").agg(F.array_sort(F.collect_list("x")).alias("l"))
    return joined.select("asset", "segment_id", F.when(F.size("l") == 0, F.substring(F.md5(F.lit("empty").cast("binary")), 1, 12)).otherwise(F.substring(F.sha1(F.array_join(F.transform("l", lambda x: x["h"]), "").cast("binary")), 1, 16)).alias("frame_hash"))


def stage(ratio: Column) -> Column:
    return F.when(ratio < 0.25, "opening").when(ratio < 0.55, "middle").when(ratio < 0.80, "late").otherwise("ending")


def light(brightness: Column) -> Column:
    return F.when(brightness <= 0, "unknown").when(brightness < 70, "dark").when(brightness < 145, "medium").otherwise("bright")


def movement(motion: Column) -> Column:
    return F.when(motion < 3, "still").when(motion < 12, "moderate").otherwise("fast")


def detail(contrast: Column) -> Column:
    return F.when(contrast < 4, "flat").when(contrast < 14, "medium").otherwise("rich")


def describe(duration: Column) -> Column:
    """A sentence on a segment that no model has seen."""
    middle = (F.col("start_sec") + F.col("end_sec")) / 2 / F.greatest(duration, F.lit(1.0))
    return F.concat_ws(" ", F.lit("segment"), tx.evidence_tag(F.col("start_sec"), F.col("end_sec")), stage(middle), light(F.col("brightness")), movement(F.col("motion")), detail(F.col("contrast")))


def clip(start: Column, end: Column, duration: Column, margin: float = 0.0) -> Column:
    """A clip's bounds within its asset, null if nothing is left."""
    a, b = F.greatest(F.lit(0.0), start - margin), F.least(duration, end + margin)
    return F.when(b > a, F.struct(a.alias("start_sec"), b.alias("end_sec")))


def bad_bounds(segments: DataFrame, durations: DataFrame, slack: float = 0.5) -> DataFrame:
    """Segments that begin before 0, have no length or end after their asset."""
    joined = segments.join(durations, "asset")
    rule = F.when((F.col("start_sec") < 0) | (F.col("end_sec") <= F.col("start_sec")), "bounds").when(F.col("end_sec") > F.col("duration_sec") + slack, "after_end")
    return joined.withColumn("error", rule).filter("error is not null").select("asset", "segment_id", "error")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: float, a: str = "start_sec", b: str = "end_sec", c: str = "span_start", d: str = "span_end") -> DataFrame:
    """Rows of left and right with equal keys whose open intervals (a, b), (c, d) overlap.

    Both sides are cut into bins of `width`, joined by bin, and a pair is kept in the one bin where the later of the two
    starts lies, so it comes once. Choose a width near the usual length: a row takes a bin for each width it spans."""
    bins = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / width), F.floor(F.col(y) / width))).alias("bin_")
    l = left.filter(F.col(b) > F.col(a)).select("*", bins(a, b))
    r = right.filter(F.col(d) > F.col(c)).select("*", bins(c, d))
    both = l.join(r, [*keys, "bin_"]).filter((F.col(d) > F.col(a)) & (F.col(c) < F.col(b)))
    return both.filter(F.col("bin_") == F.floor(F.greatest(F.col(a), F.col(c)) / width)).drop("bin_")


def align_transcripts(segments: DataFrame, spans: DataFrame, width: float = 60.0, cap: int = 1600) -> DataFrame:
    """(asset, segment_id, asr_text): distinct texts of the spans (asset, span_start, span_end, span_text) that overlap, in order."""
    hits = overlapping(segments.select("asset", "segment_id", "start_sec", "end_sec"), spans, ["asset"], width)
    texts = hits.groupBy("asset", "segment_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "span_text"))).alias("s"))
    joined = texts.select("asset", "segment_id", F.substring(F.array_join(F.array_distinct(F.transform("s", lambda x: x["span_text"])), " "), 1, cap).alias("asr_text"))
    return segments.select("asset", "segment_id").join(joined, ["asset", "segment_id"], "left").withColumn("asr_text", F.coalesce("asr_text", F.lit("")))


def annotation_pages(segments: DataFrame, size: int = 12) -> DataFrame:
    """Midpoints of segments, dealt to pages in order."""
    order = Window.partitionBy("asset").orderBy("start_sec", "segment_id")
    return segments.select("asset", "segment_id", ((F.col("start_sec") + F.col("end_sec")) / 2).alias("mid_sec"), F.floor((F.row_number().over(order) - 1) / size).alias("page"))


def described(segments: DataFrame, analyses: DataFrame) -> DataFrame:
    """segments with what a model said about them (segment_id, reply): `caption`, `ocr_text`, `scene`, `entities`, `actions`,
    `confidence`, `structured` (for the gate) and `text`, which stays as it was where the reply says nothing.

    One reply a segment: of several the longest counts, then the first in order. Segments without one get nulls."""
    one = analyses.filter("reply is not null").groupBy("segment_id").agg(F.max_by("reply", F.struct(F.length("reply"), F.col("reply"))).alias("reply"))
    said = one.select("segment_id", replies.normalise(F.col("reply")).alias("said_")).filter("said_ is not null")
    out = segments.join(said, "segment_id", "left")
    found = F.col("said_").isNotNull()
    text = F.when(found, replies.told(F.col("said_")))
    return out.select(
        *(F.col(c) for c in segments.columns if c != "text"), F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.col("text")).alias("text"), F.col("said_.summary").alias("caption"),
        *(F.col(f"said_.{c}").alias(c) for c in ("ocr_text", "scene", "entities", "actions", "confidence")), F.when(found, replies.structured(F.col("said_"))).alias("structured"),
    )
