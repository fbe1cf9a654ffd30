"""Relations of the evidence model over the tables at hand: assets, segments, queries; and running totals that scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = 4096) -> DataFrame:
    """df with the sum of value over earlier rows of the same keys, by a whole-number order column."""
    return running(df, keys, F.floor(F.col(order) / width), [order], {name: value}, inclusive=False)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as a segment of its source: as many hundredths of a second long as it has characters, in order of ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("asset"), F.col("doc_id").alias("segment_id"), "text", F.coalesce("n_chars", F.lit(0)).alias("size"))
    placed = running_total(docs, ["asset"], "segment_id", F.col("size"), "before")
    i = F.col("segment_id")
    return placed.select(
        "asset", "segment_id", (F.col("before") / 100).alias("start_sec"), ((F.col("before") + F.col("size")) / 100).alias("end_sec"), "text",
        F.pmod(i * 37, F.lit(256)).cast("double").alias("brightness"), F.pmod(i * 17, F.lit(64)).cast("double").alias("contrast"), F.pmod(i * 13, F.lit(32)).cast("double").alias("motion"), (F.pmod(i * 29, F.lit(100)) / 100).alias("vlm_score"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, segment_id, text) of segments(), straight from the table: texts take no part in the order of time."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("asset"), F.col("doc_id").alias("segment_id"), "text")


#: The same in DuckDB, to go before a query.
SEGMENTS = """segments AS (
  SELECT source AS asset, doc_id AS segment_id,
    (coalesce(sum(coalesce(n_chars, 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100.0)::DOUBLE AS start_sec,
    (sum(coalesce(n_chars, 0)) OVER (PARTITION BY source ORDER BY doc_id) / 100.0)::DOUBLE AS end_sec, text,
    ((doc_id * 37) % 256)::DOUBLE AS brightness, ((doc_id * 17) % 64)::DOUBLE AS contrast, ((doc_id * 13) % 32)::DOUBLE AS motion, (((doc_id * 29) % 100) / 100.0)::DOUBLE AS vlm_score
  FROM documents)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark item as a question to one of twenty sources."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.pmod("item_id", F.lit(20)).cast("string")).alias("asset"), F.col("text").alias("query"))


QUESTIONS = "questions AS (SELECT item_id AS query_id, 'src' || (item_id % 20)::VARCHAR AS asset, text AS query FROM benchmark)"


def duck_tokens(x: str) -> str:
    return f"""flatten(list_transform(regexp_extract_all(lower({x}), '[a-zA-Z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]+'), lambda t: CASE WHEN regexp_full_match(t, '[\\x{{4e00}}-\\x{{9fff}}]+') THEN CASE WHEN length(t) <= 2 THEN [t] ELSE list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) END WHEN length(t) > 1 THEN [t] ELSE []::VARCHAR[] END))"""


def duck_keywords(x: str) -> str:
    return f"list_distinct({duck_tokens(f'coalesce({x}, $$$$)')})"


def duck_informative(x: str) -> str:
    from ..functions.text import GENERIC_PHRASES, GENERIC_TERMS

    cleaned = f"lower(coalesce({x}, $$$$))"
    for phrase in GENERIC_PHRASES:
        cleaned = f"replace({cleaned}, '{phrase}', ' ')"
    return f"list_filter(list_distinct({duck_tokens(cleaned)}), lambda w: NOT list_contains([{', '.join(f'$${t}$$' for t in GENERIC_TERMS)}], w))"


def duck_overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len({a})::DOUBLE END"
