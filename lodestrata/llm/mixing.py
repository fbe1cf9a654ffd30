"""Mixing sources to target weights by Poisson replication, in Spark SQL functions only.

A source with target share w of `total` rows and n rows of its own has the rate w * total / n. Each row draws a count by
inverting the Poisson distribution at a uniform number hashed from the seed and its id, is exploded into that many copies,
and the copies are put in one global order by another hash. The counts of a rerun, on any cluster, are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name

#: A larger rate is drawn as a sum of parts of at most this rate, so that exp(-rate) keeps its precision.
PART = 64.0


def _uniform(*parts: Column) -> Column:
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, total: float | None = None) -> DataFrame:
    """(source, rows, rate, parts, cdf): the plan of each source, with the distribution function of a part of its rate.

    weights: target weight by source, 0 for a source that is not listed. Without it a source weighs rows**power. total:
    expected rows of the result, as many as docs has by default. A null source is a source of its own.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(float(power)))
    elif weights:
        weight = F.coalesce(F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v))))[F.col("source")], F.lit(0.0))
    else:
        weight = F.lit(0.0)
    weighed = counts.withColumn("weight", weight)
    sums = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("rows").alias("all_rows"))
    size = F.col("all_rows") if total is None else F.lit(float(total))
    # One row of sums is joined to one row for each source.
    rated = weighed.join(F.broadcast(sums)).select("source", "rows", F.coalesce(F.try_divide(F.col("weight") * size, F.col("all_weight") * F.col("rows")), F.lit(0.0)).alias("rate"))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("part", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("part") + 12 * F.sqrt("part") + 30).cast("int")
    none = F.exp(-F.col("part"))
    steps = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(none.alias("p"), none.alias("sum"), F.array(none).alias("cdf")),
        lambda s, k: F.struct((s["p"] * F.col("part") / k).alias("p"), (s["sum"] + s["p"] * F.col("part") / k).alias("sum"), F.concat(s["cdf"], F.array(s["sum"] + s["p"] * F.col("part") / k)).alias("cdf")),
        lambda s: s["cdf"],
    )
    return rated.withColumn("cdf", steps).drop("part")


def replicate(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, total: float | None = None, seed: int = 17) -> DataFrame:
    """Copies of the rows of docs with `copy` (1, 2, ...), `copies` and `shuffle_key`, in the global order of shuffle_key.

    Columns of these names in docs are replaced; all others are kept whole. A null id draws as an empty one; repeated rows
    draw the same count. No row is dropped but by drawing 0.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = docs.drop("copy", "copies", "shuffle_key")
    # A table of a row for each source: Spark broadcasts it if it is small, and else splits hot sources of the join.
    plan = scratch.save(rates(docs, source_col, weights, power, total).withColumnRenamed("source", "mix_source"), "rates")
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    names = [free_name(docs, x) for x in ("mix_source", "parts", "cdf")]
    plan = plan.select(*(F.col(x).alias(y) for x, y in zip(("mix_source", "parts", "cdf"), names)))
    _, parts, cdf = (F.col(x) for x in names)
    joined = docs.join(plan, docs[source_col].eqNullSafe(plan[names[0]]))
    uniform = free_name(docs, "uniform")
    drawn = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, j: n + F.size(F.filter(cdf, lambda c: c <= _uniform(F.lit(str(seed)), ident, j.cast("string")))))
    one = F.size(F.filter(cdf, lambda c: c <= F.col(uniform)))
    joined = joined.withColumn(uniform, _uniform(F.lit(str(seed)), ident, F.lit("1")))
    joined = joined.withColumn("copies", F.when(parts == 1, one).otherwise(drawn)).filter("copies > 0")
    exploded = joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "copies")
    keyed = exploded.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), ident, F.col("copy").cast("string")).cast("binary")))
    return keyed.orderBy("shuffle_key", "copy")


def digest(docs: DataFrame) -> DataFrame:
    """Whole rows with their copies, as the operator gives them."""
    return replicate(docs)


#: For a result of digest(): the same draws by joining each row with the distribution functions.
ORACLE = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rated AS (
  SELECT source, sqrt(n::DOUBLE) * (SELECT sum(n) FROM counts) / ((SELECT sum(sqrt(n::DOUBLE)) FROM counts) * n) AS rate FROM counts),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS s FROM rated
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), s + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
drawn AS (
  SELECT d.*, ('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, '') || '|1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents d),
counted AS (
  SELECT w.doc_id, w.text, w.lang, w.source, w.n_chars, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM w.source AND c.s <= w.u) AS copies FROM drawn w)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, copies::INTEGER AS copies,
  md5('17-order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
"""
