"""Readers of captions, records and stored tables, with explicit schemas; a row that doesn't fit is an error, never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators.fingerprints import tree
from ..operators.retrieve import top_k

EVIDENCE = "array<struct<start_sec:double,end_sec:double,text:string,source:string>>"
SCHEMAS = {
    "sft": f"record_id string, asset string, split string, query string, answer string, behaviour string, provenance string, schema_version string, frozen_test boolean, evidence {EVIDENCE}",
    "preference": f"pair_id string, record_id string, asset string, split string, query string, chosen string, rejected string, negative_type string, rationale string, behaviour string, schema_version string, evidence {EVIDENCE}",
    "rerank": "group_id string, case_id string, asset string, split string, query string, segment_id string, start_sec double, end_sec double, label double, features map<string,double>",
    "verifier": f"example_id string, pair_id string, asset string, split string, variant string, negative_type string, query string, answer string, label int, evidence {EVIDENCE}, features map<string,double>",
    "memory": "memory_id string, kind string, text string, asset string, segment_id string, start_sec double, end_sec double, importance double, salience double, keywords array<string>, version long",
    "case": "case_id string, asset string, split string, query string, behaviour string, gold_spans array<struct<start_sec:double,end_sec:double>>, gold_keywords array<string>, forbidden_keywords array<string>",
}
CORRUPT = "_corrupt"


def jsonl(spark: SparkSession, paths: str | list[str], kind: str, strict: bool = True) -> DataFrame:
    """Records of a known kind, one JSON object a line. With strict a line that doesn't parse ends the query with its text."""
    schema = T._parse_datatype_string(SCHEMAS[kind]).add(CORRUPT, "string")
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(paths)
    if not strict:
        return df
    first = df.columns[0]
    checked = F.when(F.col(CORRUPT).isNotNull(), F.raise_error(F.concat(F.lit(f"bad {kind} record: "), F.substring(CORRUPT, 1, 200)))).otherwise(F.col(first))
    return df.withColumn(first, checked).drop(CORRUPT)


def json_list(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of files that hold one JSON array each."""
    return spark.read.schema(schema).json(paths, multiLine=True)


def captions(spark: SparkSession, path: str) -> DataFrame:
    """(path, span_start, span_end, span_text) of SRT and WebVTT files: cues split at blank lines, without notes and tags."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\\r\\n?", "\n").alias("value"))
    return parse_captions(files)


def parse_captions(files: DataFrame) -> DataFrame:
    cues = files.select("path", F.explode(F.split("value", "\\n\\s*\\n")).alias("cue")).filter("cue like '%-->%'").filter(~F.startswith(F.ltrim("cue"), F.lit("NOTE")))
    lines = cues.withColumn("lines", F.split("cue", "\n"))
    at = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True).cast("int")
    bounds = F.split(F.try_element_at("lines", F.greatest(at, F.lit(1))), "-->")
    said = F.array_join(F.filter(F.transform(F.slice("lines", at + 1, F.greatest(F.lit(0), F.size("lines") - at)), lambda x: tx.strip(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != ""), " ")
    end = F.regexp_extract(F.trim(F.try_element_at(bounds, F.lit(2))), "^([0-9:.,]+)", 1)
    out = lines.select("path", tx.clock(F.trim(F.try_element_at(bounds, F.lit(1)))).alias("span_start"), tx.clock(end).alias("span_end"), said.alias("span_text"))
    return out.filter("span_end > span_start and span_text <> ''")


def caption_json(spark: SparkSession, path: str) -> DataFrame:
    """The same of JSON files: a list of spans or an object with `segments`; start and end under either of their names."""
    span = "start_sec:double,end_sec:double,start:double,end:double,text:string"
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    spans = F.coalesce(F.from_json("value", f"struct<segments:array<struct<{span}>>>")["segments"], F.from_json("value", f"array<struct<{span}>>"))
    rows = whole.select("path", F.explode(spans).alias("s"))
    out = rows.select("path", F.coalesce("s.start_sec", "s.start").alias("span_start"), F.coalesce("s.end_sec", "s.end").alias("span_end"), tx.strip(F.coalesce("s.text", F.lit(""))).alias("span_text"))
    return out.filter("span_end > span_start and span_text <> ''")


def sidecars(files: DataFrame) -> DataFrame:
    """The caption file of each asset by preference: srt, vtt, json. files: (asset, path)."""
    kind = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    rank = F.when(kind == "srt", 0).when(kind == "vtt", 1).when(kind == "json", 2)
    return top_k(files.withColumn("priority", rank).filter("priority is not null"), ["asset"], [F.asc("priority"), F.asc("path")], 1, "n_").drop("n_", "priority")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified, sha256) of files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def tree_fingerprint(files: DataFrame) -> DataFrame:
    """One hash of all files (path, sha256) of listing(), level by level (see fingerprints.tree)."""
    return tree(files.select("path", F.col("sha256").alias("hash"))).select("fingerprint")


def jobs(spark: SparkSession, path: str, schema: str, limit: int) -> DataFrame:
    """The newest job documents by time of change, those that don't parse marked in `_corrupt`."""
    full = T._parse_datatype_string(schema).add(CORRUPT, "string")
    df = spark.read.schema(full).option("columnNameOfCorruptRecord", CORRUPT).json(path, multiLine=True)
    return df.select("*", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("path")).orderBy(F.desc("modified"), "path").limit(limit)


def supervision(spark: SparkSession, path: str) -> DataFrame:
    """Cases of supervision files, a JSON list or an object with `cases`: (path, case_id, asset, media, query, split, gold_spans).

    Defaults: a number in order of the file for case_id, `dev` for split (always lower case), the media file's bare name for
    asset; a media path that is not absolute lies beside its file. A case without a query or a media path ends the query."""
    case = "struct<case_id:string,video_path:string,query:string,video_id:string,split:string,gold_spans:array<struct<start_sec:double,end_sec:double>>>"
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = whole.select("path", F.posexplode(F.coalesce(F.from_json("value", f"struct<cases:array<{case}>>")["cases"], F.from_json("value", f"array<{case}>"))).alias("i", "c")).select("path", "i", "c.*")
    given = lambda c, default: F.coalesce(F.when(F.col(c) != "", F.col(c)), default)
    needed = lambda c: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"case without {c}: "), "path", F.lit(" "), F.col("i").cast("string"))).cast("string"))
    media = F.when(F.startswith(needed("video_path"), F.lit("/")) | F.contains("video_path", F.lit("://")), F.col("video_path")).otherwise(F.concat(F.regexp_replace("path", "[^/]+$", ""), "video_path"))
    stem = F.regexp_replace(F.regexp_replace("video_path", "^.*/", ""), "(?<=.)\\.[^.]*$", "")
    return rows.select("path", given("case_id", F.format_string("supervision-%04d", "i")).alias("case_id"), given("video_id", stem).alias("asset"), media.alias("media"), needed("query").alias("query"), F.lower(given("split", F.lit("dev"))).alias("split"), F.coalesce("gold_spans", F.array().cast("array<struct<start_sec:double,end_sec:double>>")).alias("gold_spans"))


#: Endings of media files.
MEDIA = ["mp4", "mov", "m4v", "avi", "mkv", "webm"]


def resolve_media(packs: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """packs (pack_id, declared, sha256) with `path`, the file (path, sha256) under root that they mean, null if there is none.

    First the declared path, if it is under root and its bytes are right (or no hash was recorded); then, only where a hash is
    known, the file of that name and then any media file under root's data/raw with those bytes, the first by path."""
    base = root.rstrip("/")
    known = F.when(F.lower("sha256").rlike("^[0-9a-f]{64}$"), F.lower("sha256"))
    full = F.when(F.startswith("declared", F.lit("/")), F.col("declared")).otherwise(F.concat(F.lit(f"{base}/"), "declared"))
    wanted = packs.select("*", known.alias("want_"), F.when(F.trim("declared") != "", full).alias("full_"), F.regexp_replace("declared", "^.*/", "").alias("name_"))
    there = files.filter(F.startswith("path", F.lit(f"{base}/"))).select(F.col("path").alias("at_"), F.lower("sha256").alias("has_"))
    direct = wanted.join(there, [F.col("full_") == F.col("at_"), F.col("want_").isNull() | (F.col("want_") == F.col("has_"))]).select("pack_id", F.lit(0).alias("step_"), "at_")
    raw = there.filter(F.startswith("at_", F.lit(f"{base}/data/raw/")))
    media = F.lower(F.regexp_extract("at_", "\\.([^./]+)$", 1)).isin(MEDIA)
    same = wanted.join(raw, F.col("want_") == F.col("has_"))
    named = F.col("at_") == F.concat(F.lit(f"{base}/data/raw/"), F.col("name_"))
    moved = same.filter(named | media).select("pack_id", F.when(named, 1).otherwise(2).alias("step_"), "at_")
    best = direct.union(moved).groupBy("pack_id").agg(F.min(F.struct("step_", "at_")).alias("x")).select("pack_id", F.col("x.at_").alias("path"))
    return packs.join(best, "pack_id", "left")


def resolve_by_hash(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (asset, sha256) with the first path that holds those bytes."""
    best = files.groupBy("sha256").agg(F.min("path").alias("path"))
    return wanted.join(best, "sha256", "left")


def dense_index(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """A stored index (segment_id, embedding); a vector of another length ends the query."""
    df = spark.read.schema("segment_id string, embedding array<float>").parquet(path)
    return df.withColumn("embedding", F.when(F.size("embedding") != dims, F.raise_error(F.lit(f"index vectors must have {dims} numbers"))).otherwise(F.col("embedding")))
