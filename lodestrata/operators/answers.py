"""Answers and evidence as rows: lines of an answer, texts merged by time, evidence bound to its context, prompts, and the rules
by which supervision rows, sweeps and candidates are admitted or chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Headings of an answer, by the part that follows them.
HEADINGS = {"question": ["问题：", "用户问题："], "conclusion": ["结论：", "总体结论：", "回答："], "evidence": ["证据：", "证据如下：", "依据："], "memory": ["记忆补充：", "记忆："]}
# What stands for evidence that says nothing, and the labels of its parts.
NOTHING = "证据不足"
SCENE, THINGS, DEEDS = "场景：", "人物与物体：", "动作与变化："
# The lines of a prompt around its evidence and its memory.
PROMPT_QUESTION, PROMPT_EVIDENCE, PROMPT_MEMORY = "用户问题：", "证据上下文：", "记忆命中："


def lines(answers: DataFrame) -> DataFrame:
    """(answer_id, place, part, said, key): the lines of each answer (answer_id, answer) that say something, with the part they
    belong to (question and conclusion lines are their own; others follow the last heading, evidence first) and the time they
    name, null if none. Marks, bullets, headings and times are taken off."""
    raw = answers.select("answer_id", F.posexplode(F.split("answer", "\\r\\n|\\n|\\r")).alias("place", "raw")).withColumn("plain", tx.strip(F.regexp_replace("raw", "[*_`#]", ""))).filter("plain <> ''")
    head = F.coalesce(*(F.when(F.exists(F.array(*(F.lit(m) for m in marks)), lambda m: F.startswith(F.col("plain"), m)), F.lit(part)) for part, marks in HEADINGS.items()))
    marked = raw.withColumn("head", head)
    # An answer's lines are few, so its parts are a window over them.
    section = F.last(F.when(F.col("head") == "conclusion", "evidence").when(F.col("head") != "question", F.col("head")), ignorenulls=True).over(Window.partitionBy("answer_id").orderBy("place"))
    parted = marked.withColumn("part", F.when(F.col("head").isin("question", "conclusion"), F.col("head")).otherwise(F.coalesce(section, F.lit("evidence"))))
    body = F.when(F.col("head").isNotNull(), F.regexp_replace("plain", "^[^：]*：", "")).otherwise(F.regexp_replace("plain", "^[-*•]\\s+", ""))
    said = tx.strip(F.regexp_replace(F.regexp_replace(body, tx.TIMESTAMP, ""), "[(（]\\s*[)）]", ""))
    ref = F.regexp_extract("plain", tx.TIMESTAMP, 1)
    out = parted.select("answer_id", "place", "part", said.alias("said"), F.when(ref != "", tx.time_key(ref)).alias("key"), "head")
    return out.filter("said <> '' or key is not null or head in ('question', 'conclusion')").drop("head")


def sections(answers: DataFrame) -> DataFrame:
    """(answer_id, question, conclusion, evidence, memory): the last question and conclusion, and texts in order."""
    rows = lines(answers)
    of = lambda part: F.transform(F.array_sort(F.collect_list(F.when((F.col("part") == part) & (F.col("said") != ""), F.struct("place", "said")))), lambda x: x["said"])
    one = lambda part: F.max_by(F.when(F.col("part") == part, F.col("said")), F.when(F.col("part") == part, F.col("place")))
    return rows.groupBy("answer_id").agg(F.coalesce(one("question"), F.lit("")).alias("question"), F.coalesce(one("conclusion"), F.lit("")).alias("conclusion"), of("evidence").alias("evidence"), of("memory").alias("memory"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "^[ ：:;；]+|[ ：:;；]+$", "")


def joined(parts: Column) -> Column:
    """Distinct texts in order, without marks at their ends, joined into one."""
    return F.array_join(F.array_distinct(F.filter(F.transform(parts, trimmed), lambda t: t != "")), "；")


def merge_by_time(items: DataFrame, by: str = "answer_id") -> DataFrame:
    """(by, place, start_sec, end_sec, text): items (by, place, start_sec, end_sec, text) with one row for each time, to a
    thousandth, in its first place, with the texts of all."""
    key = F.struct(F.bround("start_sec", 3).alias("start"), F.bround("end_sec", 3).alias("end"))
    rows = items.groupBy(by, key.alias("key")).agg(F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", "text"))).alias("all_"))
    return rows.select(by, "place", F.col("key.start").alias("start_sec"), F.col("key.end").alias("end_sec"), joined(F.transform("all_", lambda x: x["text"])).alias("text"))


def first_text(*columns: str) -> Column:
    """The first text that is neither null nor empty, or the empty text."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns), F.lit(""))


def evidence_text(text: Column, caption: Column, ocr: Column, entities: Column, actions: Column) -> Column:
    """All that is known of a piece of evidence, as one text."""
    return F.array_join(F.filter(F.array(text, caption, ocr, F.array_join(entities, " "), F.array_join(actions, " ")), lambda t: t.isNotNull() & (t != "")), " ")


def told(text: Column, caption: Column, ocr: Column, scene: Column, entities: Column, actions: Column, cap: int = 260) -> Column:
    """What stands in for an observation that says nothing."""
    label = lambda name, t: F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit(name), t))
    return F.substring(joined(F.array(caption, ocr, text, label(SCENE, scene), label(THINGS, F.array_join(entities, "、")), label(DEEDS, F.array_join(actions, "、")))), 1, cap)


def bind(evidence: DataFrame, context: DataFrame, short: int = 12) -> DataFrame:
    """evidence (answer_id, place, start_sec, end_sec, text) with `segment_id` and a fuller text from the context (answer_id, rank,
    segment_id, start_sec, end_sec, told): the first of its rows at the same time. Evidence without such a row keeps its text."""
    key = F.struct(F.bround("start_sec", 3).alias("start"), F.bround("end_sec", 3).alias("end")).alias("key")
    first = context.select("answer_id", key, "rank", "segment_id", "told").groupBy("answer_id", "key").agg(F.min_by(F.struct("segment_id", "told"), "rank").alias("c"))
    out = evidence.withColumn("key", key).join(first, ["answer_id", "key"], "left")
    own, more = F.coalesce("text", F.lit("")), F.coalesce("c.told", F.lit(""))
    full = F.when(own == "", more).when((more != "") & (F.length(own) < short), joined(F.array(own, more))).otherwise(own)
    return out.select("answer_id", "place", "start_sec", "end_sec", F.col("c.segment_id").alias("segment_id"), F.coalesce(F.nullif(full, F.lit("")), F.lit(NOTHING)).alias("text"))


def normalised(evidence: DataFrame) -> DataFrame:
    """(answer_id, place, start_sec, end_sec, tag, text) of evidence with usable times: 0 <= start < end."""
    return evidence.filter("start_sec >= 0 and end_sec > start_sec").select("answer_id", "place", "start_sec", "end_sec", tx.evidence_tag(F.col("start_sec"), F.col("end_sec")).alias("tag"), tx.strip(F.coalesce("text", F.lit(""))).alias("text"))


def accepted(grounded: DataFrame, tags: DataFrame) -> DataFrame:
    """grounded (answer_id, ok, reason) once more judged: an answer also needs a time in every tag of its evidence (answer_id, tag)."""
    timeless = tags.groupBy("answer_id").agg(F.max(~F.contains("tag", F.lit("timestamp="))).alias("timeless"))
    rows = grounded.join(timeless, "answer_id", "left").withColumn("timeless", F.col("ok") & F.coalesce("timeless", F.lit(False)))
    return rows.select("answer_id", (F.col("ok") & ~F.col("timeless")).alias("ok"), F.when(F.col("timeless"), "evidence without time").otherwise(F.col("reason")).alias("reason"))


def prompts(questions: DataFrame, items: DataFrame, memory: DataFrame) -> DataFrame:
    """(query_id, prompt): the question, its evidence (query_id, place, segment_id, start_sec, end_sec, score, text) and its memory
    hits (query_id, rank, memory_id, segment_id, text), a line each, in order."""
    line = F.concat(F.lit("- segment_id="), F.col("segment_id").cast("string"), F.lit(" "), tx.evidence_tag(F.col("start_sec"), F.col("end_sec")), F.lit(" score="), F.format_string("%.4f", F.col("score")), F.lit(" text="), F.coalesce("text", F.lit("")))
    hit = F.concat(F.lit("- memory_id="), F.col("memory_id"), F.lit(" source="), F.col("segment_id").cast("string"), F.lit(" text="), F.coalesce("text", F.lit("")))
    gather = lambda df, by, x, name: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, x.alias("l")))), lambda r: r["l"]).alias(name))
    rows = questions.select("query_id", "query").join(gather(items, "place", line, "e"), "query_id", "left").join(gather(memory, "rank", hit, "m"), "query_id", "left")
    none = F.array().cast("array<string>")
    body = F.concat(F.array(F.concat(F.lit(PROMPT_QUESTION), F.coalesce("query", F.lit(""))), F.lit(""), F.lit(PROMPT_EVIDENCE)), F.coalesce("e", none), F.array(F.lit(""), F.lit(PROMPT_MEMORY)), F.coalesce("m", none))
    return rows.select("query_id", F.array_join(body, "\n").alias("prompt"))


def payload(items: DataFrame) -> DataFrame:
    """(query_id, items, evidence_tags): the packed context of a question as one nested row, for a sink; a few rows each."""
    row = F.struct("place", "segment_id", "start_sec", "end_sec", "score", "text", tx.evidence_tag(F.col("start_sec"), F.col("end_sec")).alias("tag"))
    return items.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("items")).withColumn("evidence_tags", F.array_distinct(F.transform("items", lambda x: x["tag"])))


def winner(candidates: DataFrame, keys: list[str], order: list[tuple[str, bool, float]], name: str) -> DataFrame:
    """The candidate of each group that is best by several measures in turn: (column, whether more is better, what null counts as)."""
    score = F.struct(*((F.coalesce(F.col(c).cast("double"), F.lit(null)) * (1 if more else -1)).alias(f"o{i}") for i, (c, more, null) in enumerate(order)))
    return candidates.groupBy(*keys).agg(F.max_by(name, score).alias(name))


def choose_adapter(candidates: DataFrame) -> DataFrame:
    """(experiment, selected): of candidates (experiment, kind, validated, preference_passed) the preference-tuned one if it passed
    both gates, else the supervised one if validated, else null."""
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}")
    one = candidates.groupBy("experiment").agg(of("dpo", "validated"), of("dpo", "preference_passed"), of("sft", "validated"))
    return one.select("experiment", F.when(F.col("dpo_validated") & F.col("dpo_preference_passed"), "dpo").when(F.col("sft_validated"), "sft").alias("selected"))


def supervision_failures(rows: DataFrame, allow_test: bool = False) -> DataFrame:
    """(failure,) of rerank rows (split, label): none at all, rows of the frozen test split, or a single class."""
    sums = rows.agg(F.count("*").alias("n"), F.count_if(F.lower("split") == "test").alias("test"), F.count_if(F.col("label") > 0.5).alias("good"))
    found = F.array(F.when(F.col("n") == 0, "empty"), F.when((F.col("test") > 0) & ~F.lit(allow_test), "frozen test rows"), F.when((F.col("n") > 0) & ((F.col("good") == 0) | (F.col("good") == F.col("n"))), "one class only"))
    return sums.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("failure"))


def rerank_rows(features: DataFrame, gold_labels: DataFrame) -> DataFrame:
    """features (query_id, segment_id, ...) with the label of each segment against the gold spans: 1 where any overlaps."""
    return features.join(gold_labels.select("query_id", "segment_id", "label"), ["query_id", "segment_id"], "left").fillna(0.0, ["label"])


def sweep_failures(sweeps: DataFrame, least_candidates: int = 8, least_runs: int = 3) -> DataFrame:
    """(sweep_id, failure) of sweeps (sweep_id, source_sha256, candidates, frozen_seen, same_spec, final_skipped, final_preference,
    final_dev, validated, passed, cases, runs, dev_std): every rule of admission that does not hold."""
    rules = {
        "no source fingerprint": F.coalesce("source_sha256", F.lit("")) == "", "too few candidates": F.coalesce("candidates", F.lit(0)) < least_candidates, "frozen test seen": F.coalesce("frozen_seen", F.lit(True)), "specs differ": ~F.coalesce("same_spec", F.lit(False)),
        "frozen preference": F.coalesce("final_skipped", F.lit(True)) | (F.coalesce("final_preference", F.lit(0.0)) != 1.0), "dev preference": F.coalesce("final_dev", F.lit(0.0)) < 1.0, "product comparison": ~F.coalesce("validated", F.lit(False)),
        "regression": F.coalesce("passed", F.lit(0)) != F.coalesce("cases", F.lit(-1)), "seeds": (F.coalesce("runs", F.lit(0)) < least_runs) | (F.coalesce("dev_std", F.lit(1.0)) != 0.0),
    }
    found = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return sweeps.select("sweep_id", F.explode(found).alias("failure"))


# Fields of a pack's manifest and where its metadata (JSON) has them.
MANIFEST = {"agent_mode": "$.agent_run.mode", "scorer_mode": "$.scorer_mode", "vlm_backend": "$.vlm.backend", "llm_backend": "$.llm_backend", "asr_backend": "$.asr.backend", "query_intent": "$.query_intent", "retrieval_strategy": "$.retrieval_selection.strategy", "source_sha256": "$.source_sha256", "video_sha256": "$.video_sha256", "environment": "$.environment", "performance": "$.performance"}


def manifest(packs: DataFrame) -> DataFrame:
    """One flat row per pack (video_path, duration_sec, segments array, clips array, summary, metadata JSON), of sixteen fields."""
    return packs.select("video_path", "duration_sec", F.size("segments").alias("num_segments"), F.size("clips").alias("num_clips"), "summary", *(F.get_json_object("metadata", path).alias(name) for name, path in MANIFEST.items()))
