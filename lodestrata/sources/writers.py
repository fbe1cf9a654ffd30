"""Writers of packs, manifests, datasets and indexes, through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.memory import upsert


def write_packs(packs: DataFrame, path: str) -> None:
    packs.write.mode("overwrite").json(path)


def markdown(question: Column, answer: Column, timeline: Column) -> Column:
    """A report: question, answer and a line for each (start_sec, end_sec, text) of the timeline."""
    rows = F.transform(timeline, lambda t: F.concat(F.lit("- "), t["start_sec"].cast("string"), F.lit("-"), t["end_sec"].cast("string"), F.lit(": "), t["text"]))
    return F.concat(F.lit("# "), question, F.lit("\n\n"), answer, F.lit("\n\n## Timeline\n"), F.array_join(rows, "\n"))


def write_reports(reports: DataFrame, path: str, column: str = "report") -> None:
    reports.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_dataset(rows: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Writes JSON lines and gives the summary: rows by the columns of `by` and over all."""
    rows.write.mode("overwrite").json(path)
    return rows.rollup(*by).agg(F.count("*").alias("rows"))


def write_index(vectors: DataFrame, path: str) -> None:
    vectors.filter("embedding is not null").select("segment_id", "embedding").write.mode("overwrite").parquet(path)


def safe_name(name: Column) -> Column:
    """A file name of a title: its plain characters, at most 64, and a piece of its hash."""
    return F.concat(F.substring(F.regexp_replace(name, "[^A-Za-z0-9_-]+", "_"), 1, 64), F.lit("-"), F.substring(F.sha1(name), 1, 10))


def write_memory(old: DataFrame, new: DataFrame, path: str) -> None:
    """The merged memory, to a path other than the old one's."""
    upsert(old, new).write.mode("overwrite").parquet(path)
