"""Memory of segments: records, search, merging, keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .retrieve import top_k


def top_keywords(rows: DataFrame, keys: list[str], text: str = "text", k: int = 8) -> DataFrame:
    """keys and `keywords`: the k most frequent tokens of each row's text, in order of frequency and then of first place.

    Texts are dealt by their keys once; words are counted, ranked and gathered where their text is, and are never shuffled."""
    terms = rows.select(*keys, text).repartition(*keys).select(*keys, F.posexplode(tx.tokens(F.col(text))).alias("pos", "term"))
    counts = terms.groupBy(*keys, "term").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    best = top_k(counts, keys, [F.desc("n"), F.asc("pos")], k)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))


def build(segments: DataFrame, score: str = "score") -> DataFrame:
    """An episodic record for each segment with a text and a semantic one where it has keywords."""
    said = segments.filter(tx.strip(F.coalesce("text", F.lit(""))) != "")
    words = top_keywords(said, ["asset", "segment_id"])
    rows = said.join(words, ["asset", "segment_id"], "left")
    salience = F.least(F.lit(1.0), 0.35 * (F.length("text") / 180.0) + 0.35 * (F.col("motion") / 30.0) + 0.30 * F.col(score))
    base = rows.withColumn("salience", salience).withColumn("importance", F.col(score) + 0.02 * F.col("motion") + F.col("salience"))
    ident = lambda kind: F.concat(F.col("asset"), F.lit(f":{kind}-"), F.col("segment_id").cast("string")).alias("memory_id")
    words = F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords")
    episodic = F.struct(ident("mem"), F.lit("episodic").alias("kind"), F.col("text"), F.col("importance"))
    semantic = F.struct(ident("sem"), F.lit("semantic").alias("kind"), F.concat(F.lit("片段主题关键词："), F.array_join("keywords", ", ")).alias("text"), (0.5 * F.col("importance")).alias("importance"))
    # Both records of a segment come from one row, so segments and words are worked out once.
    both = F.when(F.size("keywords") > 0, F.array(episodic, semantic)).otherwise(F.array(episodic))
    out = base.select("asset", "segment_id", "start_sec", "end_sec", "salience", words, F.explode(both).alias("r"))
    return out.select("r.memory_id", "r.kind", "asset", "segment_id", "start_sec", "end_sec", "r.text", "r.importance", "salience", "keywords")


def search(records: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, memory_id, score, rank): the k best records of the asset a question is asked of, above 0."""
    both = records.withColumn("said_", tx.keywords(F.col("text"))).join(questions.select("query_id", "asset", tx.keywords(F.col("query")).alias("q")), "asset")
    score = F.size(F.array_intersect("q", "said_")) + 1.5 * F.size(F.array_intersect("q", "keywords")) + 0.08 * F.col("importance") + 0.05 * F.col("salience")
    return top_k(both.select("query_id", "memory_id", score.alias("score")), ["query_id"], [F.desc("score"), F.asc("memory_id")], k).filter("score > 0")


def merge_hits(*hits: DataFrame, k: int = 4) -> DataFrame:
    """The best score of each record over several searches, the k best of each question."""
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return top_k(out.groupBy("query_id", "memory_id").agg(F.max("score").alias("score")), ["query_id"], [F.desc("score"), F.asc("memory_id")], k)


def upsert(old: DataFrame, new: DataFrame, key: str = "memory_id", version: str = "version") -> DataFrame:
    """Rows of both, the latest version of each key; of equal versions the new one."""
    both = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    return top_k(both, [key], [F.desc(version), F.desc("new_")], 1, "n_").drop("n_", "new_")
