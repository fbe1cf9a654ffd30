import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import segment
from lodestrata.operators.ordered import lagged

FRAMES = "asset string, segment_id long, t double, gray double, deviation double"


def frames(spark, n=6000):
    """Nine of ten frames are of one asset, over many ranges of time, with gaps of several ranges and null values."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        asset = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
        rows.append((asset, i // 500, i * 3.7 + (5000 if i > n // 2 else 0) - 4000, None if rng.random() < 0.02 else float(rng.randrange(0, 60)), 1.0))
    return spark.createDataFrame(rows, FRAMES).repartition(5)


def test_value_before_over_ranges_is_that_of_one_window(spark):
    df = frames(spark)
    for keys in (["asset"], ["asset", "segment_id"], []):
        got = lagged(df, keys, F.floor(F.col("t") / 600), ["t"], F.col("gray"), "before")
        want = df.withColumn("before", F.lag("gray").over(Window.partitionBy(*keys).orderBy("t")))
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert lagged(df.limit(0), ["asset"], F.floor(F.col("t") / 600), ["t"], F.col("gray"), "before").count() == 0


def test_no_task_orders_a_hot_asset(spark):
    """The frames that one task puts in order: those of a range, not of the asset."""
    df = frames(spark)
    sizes = [r["n"] for r in df.groupBy("asset", F.floor(F.col("t") / segment.SPAN).alias("r")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 600 / 3.7 + 2 < 0.05 * df.filter("asset = 'hot'").count()
    plan = segment.scenes(df)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line and ("lag(gray" in line or "sum(cut_" in line)]
    assert windows and all("range_" in line for line in windows)


def test_scenes_and_changes_over_ranges(spark):
    df = frames(spark)
    order = Window.partitionBy("asset").orderBy("t")
    cut = F.coalesce((F.abs(F.col("gray") - F.lag("gray").over(order)) >= 22).cast("int"), F.lit(0))
    plain = df.withColumn("cut", cut).withColumn("scene", F.sum("cut").over(order)).groupBy("asset", "scene").agg(F.min("t").alias("start_sec"), F.max("t").alias("end_sec"), F.count("*").alias("frames"))
    assert sorted(map(str, segment.scenes(df).collect())) == sorted(map(str, plain.collect()))
    own = Window.partitionBy("asset", "segment_id").orderBy("t")
    diff = df.withColumn("diff", F.abs(F.col("gray") - F.lag("gray").over(own)))
    change = diff.filter("diff is not null").groupBy("asset", "segment_id").agg(F.max_by("t", F.struct("diff", -F.col("t"))).alias("change_sec"))
    assert sorted(map(str, segment.change_points(df).collect())) == sorted(map(str, change.collect()))
    motion = {(r["asset"], r["segment_id"]): r["m"] for r in diff.groupBy("asset", "segment_id").agg(F.coalesce(F.avg("diff"), F.lit(0.0)).alias("m")).collect()}
    got = {(r["asset"], r["segment_id"]): r["motion"] for r in segment.visual_statistics(df).collect()}
    assert got.keys() == motion.keys() and all(abs(got[k] - motion[k]) < 1e-9 for k in got)
