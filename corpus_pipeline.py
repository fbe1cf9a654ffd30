"""From raw documents to packed training sequences: language ID, near-dedup, substring dedup, mixing, packing."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import langid, minhash, mixing, packing, substring
from lodestrata.llm.common import Scratch

#: A document goes if its language is not known to the model or the model prefers it by less than this.
LEAST_SCORE = 0.5
#: Words of a passage that repeats.
PASSAGE_WORDS = 50


#: The columns that stages work on; all others pass through.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def passing(stage):
    """The stage with other columns under names that no operator gives, so that none of them is taken for a result."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in COLUMNS else f"given_{i}__" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*names), sf_dir)
        back = dict(zip(names, docs.columns))
        return out.select(*(F.col(c).alias(back.get(c, c)) for c in out.columns))

    return run


@passing
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those no language clearly explains; `lang` becomes the predicted one.

    A tie between languages goes to the first in the alphabet, whose score is then under the least. Repeated rows are judged
    each, null ids do not matter; without labelled rows, or an empty table, no row stays."""
    model = langid.fit(docs.filter(~langid.held_out()))
    found = langid.identify(docs, model).filter(F.col("lang_pred") != "und").filter(F.col("score") >= LEAST_SCORE)
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@passing
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near copies (five words, similarity 0.8); of rows
    equal in id and text, the one with the smallest source, language and size."""
    found = minhash.near_duplicates(docs).filter("kept")
    order = Window.partitionBy("doc_id", "component_id", "text").orderBy("source", "lang", "n_chars")
    return found.withColumn("place__", F.row_number().over(order)).filter("place__ = 1").select(*docs.columns)


@passing
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words or more that occur again out of every text; the other texts stay as they are, byte for byte.

    Every copy of a passage goes, of repeated rows too, for windows are judged on the input. A null text stays null, an empty one
    empty, and a text that is all repeated becomes empty; no row goes. An empty table stays one."""
    lean = substring.remove_repeats(docs, window=PASSAGE_WORDS)
    text = F.when(F.col("n_removed") > 0, F.col("lean_text")).otherwise(F.col("text"))
    return lean.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@passing
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents so that sources weigh as the square root of their sizes, in one global order.

    A document may come out no time or several times; equal ids draw alike, so repeated rows are all in or all out. A null source
    is a source, a null id draws as an empty one, ties in the order go by copy. An empty table stays one."""
    return mixing.replicate(docs).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit bins of 2,048 tokens, with no two documents of a source and no two copies in one.

    A null or empty text is one end token, a long one several pieces. Null sources are one source. Ties in length go by id;
    repeated rows are copies of one another and lie in bins of their own. An empty table gives no row."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("mix", mix), ("sequences", sequences)]

#: Language models and packing are beyond SQL; tests compare the stages with brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
