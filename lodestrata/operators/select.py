"""Question intent and choice of evidence over time."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..tables import Scratch
from .retrieve import top_k

# Marks of a question's intent.
OPENING = ["开场", "开头", "开始", "一开始", "opening", "intro"]
MIDDLE = ["中段", "中间", "过程", "各国", "分国家", "试喝", "middle"]
ENDING = ["最后", "结尾", "末尾", "盲测", "ending", "final"]
OVERVIEW = ["整体", "流程", "主要讲", "概括", "总结", "全过程", "阶段", "依次", "从头到尾", "从开场到", "从开始到", "到最后", "overview", "process"]
COMPARISON = ["比较", "区别", "差异", "差距", "对比", "compare", "difference"]
SEVERAL = ["分别", "两次", "多个", "各国", "各自", "前后", "不同国家", "multi-span"]
COUNT = ["多少", "几个", "数量", "count"]
# Where in an asset a stage is looked for.
TARGETS = {"opening": 0.08, "middle": 0.50, "ending": 0.92}


def classify(query: Column) -> Column:
    """struct(kind, coverage_mode, stage_hints, time_anchor_sec) of a question."""
    low = F.lower(tx.strip(F.coalesce(query, F.lit(""))))
    any_of = lambda marks: tx.contains_any(low, marks)
    hints = F.filter(F.array(*(F.when(any_of(m), F.lit(n)) for n, m in (("opening", OPENING), ("middle", MIDDLE), ("ending", ENDING)))), lambda h: h.isNotNull())
    anchor = F.regexp_extract(low, "(?<![0-9])([0-9]+(?:\\.[0-9]+)?)\\s*(?:秒|s)", 1).try_cast("double")
    overview = (F.size(hints) >= 2) | any_of(OVERVIEW)
    staged = F.size(hints) > 0
    kind = F.when(overview, "overview").when(any_of(COMPARISON), "comparison").when(any_of(COUNT), "count").otherwise("locate")
    mode = (
        F.when(overview, "distributed")
        .when(any_of(COMPARISON), F.when(any_of(SEVERAL), "multi_span").when(staged, "stage_local").otherwise("local"))
        .when(any_of(COUNT), "multi_span").when(staged, "stage_local").when(anchor.isNotNull(), "time_local").otherwise("local")
    )
    return F.struct(kind.alias("kind"), mode.alias("coverage_mode"), hints.alias("stage_hints"), anchor.alias("time_anchor_sec"))


def midpoint() -> Column:
    return (F.col("start_sec") + F.col("end_sec")) / 2


def in_stage(ratio: Column, label: Column) -> Column:
    return F.when(label == "opening", ratio <= 0.25).when(label == "ending", ratio >= 0.75).otherwise((ratio > 0.25) & (ratio < 0.75))


def _best() -> list[Column]:
    return [F.desc("score"), F.asc("segment_id")]


def select_top(ranked: DataFrame, k: int) -> DataFrame:
    return top_k(ranked, ["query_id"], _best(), k)


def select_stage(ranked: DataFrame, k: int) -> DataFrame:
    """The k best of the segments in a hinted stage, or of all if none is. ranked has duration_sec and stage_hints."""
    ratio = midpoint() / F.greatest("duration_sec", F.lit(1.0))
    marked = ranked.withColumn("fits", F.exists("stage_hints", lambda h: in_stage(ratio, h)))
    # A fitting segment precedes all others, so ranking alone shows whether there is one.
    best = top_k(marked, ["query_id"], [F.desc("fits"), *_best()], k)
    found = best.groupBy("query_id").agg(F.max("fits").alias("found"))
    return best.join(found, "query_id").filter("fits or not found").drop("found")


def select_nearest(ranked: DataFrame, k: int) -> DataFrame:
    """The k segments whose midpoints are nearest to the question's time anchor."""
    return top_k(ranked.withColumn("gap", F.abs(midpoint() - F.col("time_anchor_sec"))), ["query_id"], [F.asc("gap"), *_best()], k)


def stages_for(hints: Column, k: int, least: int) -> Column:
    """Hinted stages, filled up with the others to the least number."""
    every = F.array(*(F.lit(t) for t in TARGETS))
    known = F.filter(hints, lambda h: h.isin(*TARGETS))
    first = F.when(F.size(known) > 0, known).otherwise(every)
    return F.slice(F.concat(first, F.slice(F.array_except(every, first), 1, F.greatest(F.lit(0), min(least, k) - F.size(first)))), 1, k)


def select_spread(ranked: DataFrame, k: int, least: int) -> DataFrame:
    """The k segments of each question that greedy choice takes one by one out of all its candidates, each with a reason.

    Every round is one aggregate over all candidates, joined with the few rows that their question has chosen so far."""
    d = F.greatest("duration_sec", F.lit(1.0))
    many = F.col("coverage_mode") == "multi_span"
    rows = ranked.select("query_id", "segment_id", "score", "start_sec", "end_sec", d.alias("d"), midpoint().alias("mid"), many.alias("many"), "stage_hints")
    scratch = Scratch(ranked.sparkSession, "spread")
    rows = scratch.save(rows, "rows")
    none = F.array().cast("array<struct<segment_id:bigint,start_sec:double,score:double,mid:double,reason:string>>")
    state = rows.groupBy("query_id").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.first("stage_hints").alias("hints"), F.first("many").alias("many"))
    state = state.select("query_id", "low", "high", F.when(F.col("many"), F.array().cast("array<string>")).otherwise(stages_for(F.coalesce("hints", F.array().cast("array<string>")), k, least)).alias("targets"), none.alias("chosen"))
    span = F.col("high") - F.col("low")
    norm = F.when(span > 1e-9, (F.col("score") - F.col("low")) / span).otherwise(0.5)
    ratio = F.col("mid") / F.col("d")
    for i in range(k):
        label = F.get("targets", F.lit(i))
        far = F.when(label == "opening", F.greatest(F.col("start_sec"), F.lit(0.0)) / F.col("d")).when(label == "ending", F.greatest(F.col("d") - F.col("end_sec"), F.lit(0.0)) / F.col("d")).otherwise(F.abs(ratio - TARGETS["middle"]))
        new = F.coalesce(F.array_min(F.transform("chosen", lambda c: F.abs(F.col("mid") - c["mid"]) / F.col("d"))), F.lit(1.0))
        novel = F.when(F.col("many"), 0.88 * norm + 0.12 * new).otherwise(0.78 * norm + 0.22 * new)
        anchor = F.col("many") & (F.size("chosen") == 0)
        value = F.when(anchor, F.col("score")).when(label.isNotNull(), 0.10 * norm - 0.90 * far).otherwise(novel)
        reason = F.when(anchor, "best_score").when(label.isNotNull(), F.concat(F.lit("stage_"), label)).otherwise("score_and_distance")
        left = ~F.exists("chosen", lambda c: c["segment_id"] == F.col("segment_id"))
        # What is left precedes what is chosen, and what lies in the stage what does not.
        key = F.struct(left, label.isNotNull() & in_stage(ratio, label), value, F.col("score"), -F.col("segment_id"))
        item = F.struct(left.alias("left"), F.struct(F.col("segment_id").cast("long").alias("segment_id"), "start_sec", "score", "mid", reason.alias("reason")).alias("item"))
        best = rows.join(state, "query_id").groupBy("query_id").agg(F.max_by(item, key).alias("best"), *(F.first(c).alias(c) for c in ("low", "high", "targets", "chosen")))
        state = best.select("query_id", "low", "high", "targets", F.when(F.col("best.left"), F.concat("chosen", F.array("best.item"))).otherwise(F.col("chosen")).alias("chosen"))
    state = scratch.save(state.select("query_id", "chosen"), "chosen")
    scratch.drop("rows")
    return state.select("query_id", F.explode("chosen").alias("c")).select("query_id", "c.segment_id", "c.start_sec", "c.score", "c.reason")


def select_evidence(ranked: DataFrame, k: int, least: int = 3) -> DataFrame:
    """(query_id, segment_id, place, reason) by each question's coverage mode.

    ranked: query_id, segment_id, score, start_sec, end_sec, duration_sec, coverage_mode, stage_hints, time_anchor_sec. The
    local modes are window functions; the two that spread evidence over time choose greedily from all candidates."""
    simple = lambda df, reason: df.select("query_id", "segment_id", "start_sec", "score", F.lit(reason).alias("reason"))
    local = simple(select_top(ranked.filter("coverage_mode = 'local'"), k), "top_score")
    stage = simple(select_stage(ranked.filter("coverage_mode = 'stage_local'"), k), "stage_local")
    near = simple(select_nearest(ranked.filter("coverage_mode = 'time_local'"), k), "time_local")
    greedy = select_spread(ranked.filter("coverage_mode in ('multi_span', 'distributed')"), k, least)
    chosen = local.union(stage).union(near).union(greedy)
    return top_k(chosen, ["query_id"], [F.asc("start_sec"), F.desc("score"), F.asc("segment_id")], k, "place").select("query_id", "segment_id", "place", "reason")


def pack_context(chosen: DataFrame, limit: int = 1800, least: int = 2) -> DataFrame:
    """chosen (query_id, place, segment_id, text) with `kept`: in order, the first `least` always, then what still fits; what
    does not fit takes no room. A question's evidence is a few rows, folded in one expression."""
    items = chosen.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "segment_id", F.length("text").alias("size")))).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.array().cast("array<struct<segment_id:bigint,kept:boolean,used:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        kept = (s["n"] < least) | (s["used"] + x["size"] <= limit)
        used = F.when(kept, s["used"] + x["size"]).otherwise(s["used"])
        return F.struct(used.alias("used"), F.when(kept, s["n"] + 1).otherwise(s["n"]).alias("n"), F.concat(s["out"], F.array(F.struct(x["segment_id"].cast("bigint").alias("segment_id"), kept.alias("kept"), used.alias("used")))).alias("out"))

    return items.select("query_id", F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("x")).select("query_id", "x.*")


def compress(text: Column, query: Column, limit: int = 360) -> Column:
    """A text within a limit: whole, or its sentences with most question terms (longer first), or head and tail."""
    t = F.coalesce(text, F.lit(""))

    def pick(q: Column) -> Column:
        ranked = F.transform(tx.sentences(t), lambda s, i: F.struct((-F.size(F.array_intersect(q, tx.keywords(s)))).alias("hits"), (-F.length(s)).alias("size"), i.alias("i"), s.alias("s")))
        kept = F.aggregate(F.sort_array(ranked), F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out")), lambda a, x: F.when(a["used"] - x["size"] <= limit, F.struct((a["used"] - x["size"]).alias("used"), F.concat(a["out"], F.array(x["s"])).alias("out"))).otherwise(a), lambda a: a["out"])
        return F.when(F.size(q) == 0, F.array().cast("array<string>")).otherwise(kept)

    head = int(limit * 0.72)
    tail = max(0, limit - head - 18)
    ends = F.concat(F.rtrim(F.substring(t, 1, head)), F.lit(" ... "), F.ltrim(F.substring(t, -tail, tail))) if tail else F.rtrim(F.substring(t, 1, limit))
    return F.when(F.length(t) <= limit, t).otherwise(tx.let(tx.let(tx.keywords(query), pick), lambda s: F.when(F.size(s) > 0, F.array_join(s, " ")).otherwise(ends)))


def planner_examples(ranked: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, query, candidates, target_plan): training rows of a planner. A plan retrieves the best k segments, ranked from 0,
    and then synthesizes; a question without candidates has none and only the last step."""
    best = top_k(ranked, ["query_id"], _best(), k, "place")
    steps = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((F.col("place") - 1).alias("rank"), F.col("segment_id").cast("string").alias("target"), "score"))).alias("steps"))
    rows = questions.select("query_id", "query").join(steps, "query_id", "left").withColumn("steps", F.coalesce("steps", F.array().cast("array<struct<rank:int,target:string,score:double>>")))
    step = lambda action, target, rank: F.struct(action.alias("action"), target.alias("target"), rank.cast("int").alias("rank"))
    last = F.array(step(F.lit("synthesize"), F.lit("knowledge_pack"), F.lit(None)))
    return rows.select("query_id", "query", F.transform("steps", lambda s: F.struct(s["target"].alias("segment_id"), s["score"].alias("score"))).alias("candidates"), F.concat(F.transform("steps", lambda s: step(F.lit("retrieve"), s["target"], s["rank"])), last).alias("target_plan"))


def plan(ranked: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, step, action, target): retrieve the best segments, then synthesize; inspect where there is no candidate."""
    best = top_k(ranked, ["query_id"], _best(), k, "step").select("query_id", "step", F.lit("retrieve").alias("action"), F.col("segment_id").cast("string").alias("target"))
    counts = questions.select("query_id").join(best.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    last = counts.select("query_id", (F.coalesce("n", F.lit(0)) + 1).alias("step"), F.when(F.col("n").isNull(), "inspect").otherwise("synthesize").alias("action"), F.when(F.col("n").isNull(), "full_video").otherwise("knowledge_pack").alias("target"))
    return best.union(last.withColumn("step", F.col("step").cast("int")))


def ranker_pairs(ranked: DataFrame) -> DataFrame:
    """The best candidate of each question with every other one: the best is an aggregate joined back."""
    best = ranked.groupBy("query_id").agg(F.max_by(F.col("segment_id"), F.struct(F.col("score"), -F.col("segment_id"))).alias("positive"))
    return ranked.join(best, "query_id").filter("segment_id <> positive").select("query_id", "positive", F.col("segment_id").alias("negative"))
