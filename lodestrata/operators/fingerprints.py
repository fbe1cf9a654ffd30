"""Fingerprints of files, of JSON whatever its form, and of runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that are hashed at a time.
CHUNK = 1 << 20


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files under root, by their path below it; any store that Spark reads.

    Spark gives no row for an empty file, so these do not count."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    top = re.sub("^[a-z0-9]+:/+", "/", root.rstrip("/"))
    return found.select(F.regexp_replace("path", f"^.*?\\Q{top}\\E/+", "").alias("path"), "content")


def content_hash(content: Column) -> Column:
    """Hex hash of the hashes of a file's chunks of CHUNK bytes, in order; an empty file has one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(content) / CHUNK)).cast("int")
    return F.sha2(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sha2(F.substr(content, i * CHUNK + 1, F.lit(CHUNK)), 256)), "").cast("binary"), 256)


def leaf(path: Column, hashed: Column) -> Column:
    """Hash of a file's path, with its length in bytes before it, and of its content's hash."""
    return F.sha2(F.concat(F.lpad(F.octet_length(path).cast("string"), 10, "0"), F.lit(":"), path, F.lit(":"), hashed).cast("binary"), 256)


def tree(leaves: DataFrame, name: str = "fingerprint") -> DataFrame:
    """One row (files, fingerprint) over (path, hash): leaves are hashed in order of paths within 65,536 groups by the md5 of the
    path, groups within 256, these into one, so no cell holds more than its group. Without files the hash of nothing.

    A byte, a name or a place that changes gives another fingerprint; equal paths count as often as they are there."""
    over = lambda by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "h"))), lambda x: x["h"]), "").cast("binary"), 256).alias("h")
    each = leaves.select("path", leaf(F.col("path"), F.col("hash")).alias("h"))
    small = each.groupBy(F.substring(F.md5(F.col("path").cast("binary")), 1, 4).alias("p")).agg(over("path"), F.count("*").alias("n"))
    large = small.groupBy(F.substring("p", 1, 2).alias("q")).agg(over("p"), F.sum("n").alias("n"))
    return large.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), over("q").alias(name))


def canonical(text: Column, without: str | None = None) -> Column:
    """JSON text in one form: keys in order at every depth, no white space, numbers by value (1.0 is 1); null where it is none.

    `without` names a field by its path (a.b.c), which is left out; objects on the way to it have to be there."""
    return F.to_json(F.try_parse_json(_without(text, without.split(".")) if without else text))


def _without(text: Column, path: list[str]) -> Column:
    parts = F.from_json(text, "map<string,variant>")
    left = F.map_filter(parts, lambda k, _: k != path[0])
    if len(path) > 1:
        # The object below, without its part, as JSON again; what is no object stays.
        below = F.to_json(F.element_at(parts, path[0]))
        inner = F.when(F.startswith(below, F.lit("{")), _without(below, path[1:])).otherwise(below)
        left = F.when(F.map_contains_key(parts, path[0]), F.map_concat(left, F.create_map(F.lit(path[0]), F.try_parse_json(inner)))).otherwise(left)
    return F.when(parts.isNotNull(), F.to_json(left)).otherwise(text)


def canonical_hash(text: Column, without: str | None = None) -> Column:
    return F.sha2(canonical(text, without).cast("binary"), 256)


def run_signature(config: Column, source: Column, manifest: Column, split: Column) -> Column:
    """Hash of a run's configuration (a struct), the fingerprints of its sources and manifest, and its split (`all` if null):
    equal for equal runs in whatever order fields are given."""
    payload = F.struct(source.alias("source_sha256"), manifest.alias("manifest_sha256"), F.coalesce(split, F.lit("all")).alias("split"), config.alias("config"))
    return F.sha2(F.to_json(F.to_variant_object(payload)).cast("binary"), 256)
