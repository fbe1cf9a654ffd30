"""Running aggregates in order, spread over ranges of the order, so that no key's rows are ordered in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], bucket: Column, order: list, values: dict[str, Column], how=F.sum, inclusive: bool = True) -> DataFrame:
    """df with how (F.sum or F.max) of each value over the rows of the same keys up to each row, or before it.

    bucket must not fall along the order. Buckets are aggregated first and only these are ordered as a whole; rows are ordered
    within a bucket. Null keys and buckets are keys and buckets like others. Sums of no rows are 0, maxima null."""
    placed = df.withColumn("range_", bucket)
    parts = placed.groupBy(*keys, "range_").agg(*(how(v).alias(f"part_{n}_") for n, v in values.items()))
    before = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    on = [*keys, "range_"]
    bases = parts.select(*(F.col(k).alias(f"key_{i}_") for i, k in enumerate(on)), *(how(f"part_{n}_").over(before).alias(f"base_{n}_") for n in values))
    own = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    both = placed.join(bases, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"key_{i}_")) for i, k in enumerate(on)]))
    for n, v in values.items():
        base, here = F.col(f"base_{n}_"), how(v).over(own)
        both = both.withColumn(n, F.greatest(base, here) if how is F.max else F.coalesce(base, F.lit(0)) + F.coalesce(here, F.lit(0)))
    return both.drop("range_", *(f"key_{i}_" for i in range(len(on))), *(f"base_{n}_" for n in values))


def lagged(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the value of the row before, of the same keys in this order, null for the first.

    bucket must not fall along the order. Rows are ordered within a bucket; the last row of each bucket is carried to the next one
    that has rows, and only buckets are ordered as a whole, so a key in most rows is many tasks. Null keys are keys like others."""
    placed = df.withColumn("range_", bucket)
    on = [*keys, "range_"]
    lasts = placed.groupBy(*on).agg(F.max_by(F.struct(value.alias("v")), F.struct(*order)).alias("last_"))
    edges = lasts.select(*(F.col(k).alias(f"key_{i}_") for i, k in enumerate(on)), F.lag("last_").over(Window.partitionBy(*keys).orderBy("range_")).alias("carried_"))
    both = placed.join(edges, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"key_{i}_")) for i, k in enumerate(on)]))
    own = Window.partitionBy(*on).orderBy(*order)
    before = F.when(F.row_number().over(own) == 1, F.col("carried_.v")).otherwise(F.lag(value).over(own))
    return both.withColumn(name, before).drop("range_", "carried_", *(f"key_{i}_" for i in range(len(on))))


def scaled(df: DataFrame, value: str, name: str = "place_", parts: int = 512) -> DataFrame:
    """df with the place of a row's value among at most `parts` ranges that hold about as many rows each, null for null.

    Ranges are cut at quantiles (one aggregate, a fixed number of values for the driver), so an outlier, a heavy tail or infinite
    values take no room from the others; equal values share a range, and what is no number comes last. The place is found by
    halving."""
    x = F.col(value).cast("double")
    found = df.agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted({q for q in found if q == q})

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x < F.lit(cuts[mid]), among(low, mid)).otherwise(among(mid + 1, high))

    return df.withColumn(name, F.when(x.isNotNull(), among(0, len(cuts))))
