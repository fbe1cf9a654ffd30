"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import crosstoken, embeddings, extract, langid, lm, minhash, mixing, packing, quality, resample, substring, suffix, tokencount


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict:
    docs = lambda f: lambda spark, sf_dir: f(_table(spark, sf_dir, "documents"))
    return {
        "op1_minhash": docs(minhash.digest),
        "op2_packing": docs(packing.digest),
        "op3_language": docs(langid.digest),
        "op4_embeddings": lambda spark, sf_dir: embeddings.digest(_table(spark, sf_dir, "embeddings")),
        "op5_token_counts": docs(tokencount.digest),
        "op6_lm": docs(lm.digest),
        "op7_suffix": docs(suffix.digest),
        "op8_substring": docs(substring.digest),
        "op9_mixing": docs(mixing.digest),
        "op10_quality": lambda spark, sf_dir: quality.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")),
        "op11_crosstoken": docs(crosstoken.digest),
        "op12_resample": lambda spark, sf_dir: resample.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")),
        "op13_extract": lambda spark, sf_dir: extract.digest(_table(spark, sf_dir, "pages")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": minhash.ORACLE, "op4_embeddings": embeddings.ORACLE, "op8_substring": substring.ORACLE, "op9_mixing": mixing.ORACLE, "op12_resample": resample.ORACLE}
