"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


WIDE = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(16 << 20)}


class Scratch:
    """Parquet tables under spark.checkpoint.dir, which every executor can read: they cut lineage and survive lost executors.

    Tables that a step no longer needs are dropped on the way; what a result is read from stays in a folder named after the
    step, for the result is a plan over it. A folder of this machine is taken in local mode only."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="lodestrata-")
            atexit.register(shutil.rmtree, base, True)
        self.spark, self.dir = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, tag: str, codec: str = "zstd", wide: bool = False) -> DataFrame:
        """wide: rows may be megabytes each. Parquet looks at sizes after 100 rows at first, and writes and reads a row group (its
        pages, packed as wholes) in memory; here it looks at every row and ends a group after 16 MB."""
        path = f"{self.dir}/{tag}"
        df.write.option("compression", codec).options(**WIDE if wide else {}).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{tag}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def reclaim(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now rather than at its next collection."""
        gc.collect()
        self.spark._jvm.System.gc()
