"""Token counts as an exact histogram of encoded lengths.

Texts are encoded once, by a public byte-pair vocabulary; only lengths go on. Documents are summed by length, in each task
first, and sums over the histogram from its long end answer every total, quantile and truncated total: for a context limit L,
sum(min(length, L)) is the tokens of shorter documents plus L times the documents at least as long.
"""

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tune

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to this public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths whose suffix sums one task makes; sums of whole blocks are added to them.
BLOCK = 4096


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """docs with `n_tokens` (replaced if there is one); null and empty texts have 0. The vocabulary's path is one of the driver.

    Repeated rows count each; a text of any length is encoded whole in one task."""
    tune(docs.sparkSession)
    docs = docs.drop("n_tokens")
    at, names = docs.columns.index(text_col), docs.columns
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # of fixed size

    def run(batches):
        enc = encoder(shared.value, pattern)
        for batch in batches:
            n = [len(enc.encode_ordinary(x)) if x else 0 for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*names, "n_tokens"])

    schema = docs.schema
    return docs.mapInArrow(run, type(schema)(list(schema)).add("n_tokens", "long"))


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per length in use: `n_tokens`, `n_docs`, `docs_at_least`, `tokens_at_least`, `docs_at_most`, `share_at_most`,
    `total_truncated` (all tokens if texts end after n_tokens). An empty table gives no row; a null length counts as 0. Equal lengths, of repeated rows too, are one row."""
    rows = lengths.groupBy(F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    # A row for each length, asked for twice below: a table, so that texts are encoded once.
    rows = Scratch(lengths.sparkSession, "lengths").save(rows, "rows")
    rows = rows.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A row for each block of lengths: as many as the longest text has blocks, however many texts there are.
    beyond = sums.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("more_docs"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("more_tokens"), F.sum("d").over(all_rows).alias("all_docs"), F.sum("t").over(all_rows).alias("all_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = rows.join(beyond, "block").withColumn("docs_at_least", F.sum("n_docs").over(own) + F.col("more_docs")).withColumn("tokens_at_least", F.sum(F.col("n_docs") * F.col("n_tokens")).over(own) + F.col("more_tokens"))
    at_most = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", at_most.alias("docs_at_most"), (at_most / F.col("all_docs")).alias("share_at_most"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("total_truncated"),
    )


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(`limit`, `total`): tokens left when every text ends after `limit` tokens, for any limits, in use as lengths or not."""
    spark = hist.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    total = hist.agg(F.sum(F.col("n_docs") * F.col("n_tokens")).alias("all"))
    # The first length at or over a limit has the suffix sums that the limit needs.
    near = asked.join(F.broadcast(hist.select("n_tokens", "docs_at_least", "tokens_at_least")), F.col("n_tokens") >= F.col("limit"), "left").groupBy("limit").agg(F.min_by("docs_at_least", "n_tokens").alias("d"), F.min_by("tokens_at_least", "n_tokens").alias("t"))
    return near.join(F.broadcast(total)).select("limit", (F.coalesce("all", F.lit(0)) - F.coalesce("t", F.lit(0)) + F.coalesce("d", F.lit(0)) * F.col("limit")).alias("total"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(`share`, `n_tokens`): the least length that this share of the documents does not pass."""
    asked = hist.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return asked.join(F.broadcast(hist.select("n_tokens", "share_at_most")), F.col("share_at_most") >= F.col("share"), "left").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def digest(docs: DataFrame) -> DataFrame:
    return histogram(encoded_lengths(docs.select("text")).select("n_tokens"))
