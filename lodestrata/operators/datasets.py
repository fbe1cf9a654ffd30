"""Training sets: builders, and validators as rule queries that give a table of errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .retrieve import top_k

SPLITS = ["train", "dev", "test"]
BEHAVIOURS = ["answer", "abstain"]


def errors(*rules: tuple[str, DataFrame]) -> DataFrame:
    """(rule, key) of all rows of the rule queries; the first column of each is its key."""
    return reduce(DataFrame.union, [df.select(F.lit(name).alias("rule"), F.col(df.columns[0]).cast("string").alias("key")) for name, df in rules])


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def leaks(records: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups with rows in more than one split, and those splits."""
    return records.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits")).filter("size(splits) > 1")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right lacks: what an inner join would lose silently."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def validate_sft(records: DataFrame, group: str = "asset") -> DataFrame:
    """Errors of records (record_id, asset, split, query, answer, behaviour, evidence array<struct<start_sec, end_sec, text>>)."""
    bad = lambda e: (e["start_sec"] < 0) | (e["end_sec"] <= e["start_sec"])
    blank = lambda c: tx.strip(F.coalesce(c, F.lit(""))) == ""
    present = records.agg(F.collect_set("split").alias("s")).select(F.explode(F.array_except(F.array(*(F.lit(x) for x in SPLITS)), "s")).alias("split"))
    return errors(
        ("duplicate_id", duplicates(records, "record_id")), ("split", records.filter(~F.col("split").isin(SPLITS) | F.col("split").isNull()).select("record_id")), ("behaviour", records.filter(~F.col("behaviour").isin(BEHAVIOURS)).select("record_id")),
        ("empty", records.filter(blank(F.col("query")) | blank(F.col("answer"))).select("record_id")), ("leak", leaks(records, group)), ("abstain_with_evidence", records.filter((F.col("behaviour") == "abstain") & (F.size("evidence") > 0)).select("record_id")),
        ("no_evidence", records.filter((F.col("behaviour") == "answer") & (F.size("evidence") == 0)).select("record_id")), ("bounds", records.filter(F.exists("evidence", bad)).select("record_id")), ("evidence_text", records.filter(F.exists("evidence", lambda e: blank(e["text"]))).select("record_id")), ("missing_split", present),
    )


def build_sft(cases: DataFrame, spans: DataFrame) -> DataFrame:
    """Records of cases (case_id, asset, split, query, behaviour) and spans (case_id, start_sec, end_sec, text): distinct spans with
    a length, in order; none, and a refusal, for a case that abstains."""
    found = spans.filter("end_sec > start_sec and start_sec >= 0").groupBy("case_id").agg(F.array_sort(F.collect_set(F.struct("start_sec", "end_sec", "text"))).alias("evidence"))
    none = F.array().cast("array<struct<start_sec:double,end_sec:double,text:string>>")
    rows = cases.join(found, "case_id", "left").withColumn("evidence", F.when(F.col("behaviour") == "abstain", none).otherwise(F.coalesce("evidence", none)))
    lines = F.transform("evidence", lambda e: F.concat(F.lit("- "), e["text"], F.lit(" ("), tx.evidence_tag(e["start_sec"], e["end_sec"]), F.lit(")")))
    body = F.when(F.col("behaviour") == "abstain", F.lit("结论：证据不足，无法确认。")).otherwise(F.concat(F.lit("结论：\n"), F.array_join(lines, "\n")))
    return rows.select(F.concat(F.lit("sft-"), F.col("case_id").cast("string")).alias("record_id"), "asset", "split", "query", "behaviour", "evidence", F.concat(F.lit("问题："), F.col("query"), F.lit("\n"), body).alias("answer"))


def build_preferences(annotations: DataFrame, records: DataFrame) -> DataFrame:
    """annotations (pair_id, record_id, negative_type, rejected) with their records; the good answer is chosen. Check unmatched() first."""
    return annotations.join(records, "record_id").select("pair_id", "record_id", "asset", "split", "query", "behaviour", "evidence", F.col("answer").alias("chosen"), "rejected", "negative_type")


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.array(*(tx.spaced(p.cast("string")) for p in parts))), 256)


def validate_preferences(pairs: DataFrame, records: DataFrame, tolerance: float = 0.11) -> DataFrame:
    """Errors of pairs: repeated ids or contents, chosen equal to rejected, wrong times where the type says so, drift from records."""
    within = lambda r: F.exists("evidence", lambda e: (F.abs(e["start_sec"] - r["start"]) <= tolerance) & (F.abs(e["end_sec"] - r["end"]) <= tolerance))
    bound = F.forall(tx.time_ranges(F.concat_ws(" ", tx.time_references(F.col("rejected")))), within)
    drift = pairs.alias("p").join(records.alias("r"), "record_id").filter(reduce(lambda a, b: a | b, [~F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("asset", "split", "query", "behaviour")]) | ~F.col("p.chosen").eqNullSafe(F.col("r.answer"))).select("pair_id")
    return errors(
        ("duplicate_id", duplicates(pairs, "pair_id")), ("identical", pairs.filter(tx.spaced(F.col("chosen")) == tx.spaced(F.col("rejected"))).select("pair_id")), ("duplicate_content", duplicates(pairs.select(fingerprint(F.col("query"), F.col("chosen"), F.col("rejected")).alias("print")), "print")),
        ("wrong_timestamp", pairs.filter((F.col("negative_type") == "wrong_timestamp") & bound).select("pair_id")), ("missing_timestamp", pairs.filter((F.col("negative_type") == "missing_timestamp") & F.contains("rejected", F.lit("timestamp="))).select("pair_id")), ("leak", leaks(pairs, "asset")), ("drift", drift),
    )


def verifier_rows(pairs: DataFrame) -> DataFrame:
    """Two rows for each pair: the chosen answer is safe, the rejected one is not."""
    both = F.array(F.struct(F.lit("chosen").alias("variant"), F.col("chosen").alias("answer"), F.lit(1).alias("label")), F.struct(F.lit("rejected").alias("variant"), F.col("rejected").alias("answer"), F.lit(0).alias("label")))
    return pairs.select("pair_id", "asset", "split", "query", "evidence", "negative_type", F.explode(both).alias("x")).select(F.concat_ws(":", F.col("pair_id").cast("string"), "x.variant").alias("example_id"), "pair_id", "asset", "split", "query", "evidence", "negative_type", "x.*")


def validate_verifier(rows: DataFrame) -> DataFrame:
    """Errors of verifier rows: repeated ids, labels other than 0 and 1, pairs without both variants, leaks."""
    halves = rows.groupBy("pair_id").agg(F.array_sort(F.collect_set("variant")).alias("v")).filter(F.col("v") != F.array(F.lit("chosen"), F.lit("rejected")))
    return errors(("duplicate_id", duplicates(rows, "example_id")), ("label", rows.filter(~F.col("label").isin(0, 1)).select("example_id")), ("variants", halves), ("leak", leaks(rows, "asset")))


def payload_hash(rows: DataFrame, key: str, columns: list[str], split: str = "train") -> DataFrame:
    """One row: a hash of the training rows in order of their keys, made of hashes of rows, then of 65,536 groups of keys, of 256
    and of all."""
    all_of = lambda *order: F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x["h"])), 256).alias("h")
    each = rows.filter(F.col("split") == split).select(F.col(key).cast("string").alias("k"), F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"))
    small = each.groupBy(F.substring(F.md5(F.col("k").cast("binary")), 1, 4).alias("p")).agg(all_of("k", "h"), F.count("*").alias("n"))
    large = small.groupBy(F.substring("p", 1, 2).alias("q")).agg(all_of("p", "h"), F.sum("n").alias("n"))
    return large.agg(F.sum("n").alias("rows"), all_of("q", "h").alias("hash"))


def mixed_groups(rows: DataFrame, group: str = "group_id", label: str = "label") -> DataFrame:
    """(group, positives, negatives, pairs) of groups that have both labels."""
    out = rows.groupBy(group).agg(F.sum((F.col(label) > 0).cast("long")).alias("positives"), F.sum((F.col(label) <= 0).cast("long")).alias("negatives"))
    return out.filter("positives > 0 and negatives > 0").withColumn("pairs", F.col("positives") * F.col("negatives"))


def model_card(rows: DataFrame, group: str, scores: list[str], label: str = "label") -> DataFrame:
    """(score, pairs, accuracy, lift) for each score column; lift over the first."""
    from .evals import pairwise_accuracy

    each = None
    for s in scores:
        one = pairwise_accuracy(rows, [group], s, label).agg(F.sum("correct").alias("c"), F.sum("pairs").alias("pairs")).select(F.lit(s).alias("score"), "pairs", F.try_divide("c", "pairs").alias("accuracy"))
        each = one if each is None else each.union(one)
    first = each.filter(F.col("score") == scores[0]).select(F.col("accuracy").alias("base"))
    return each.join(F.broadcast(first)).select("score", "pairs", "accuracy", (F.col("accuracy") - F.col("base")).alias("lift"))


def manifest(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Expected artifacts (path) with the size and hash of the files found (path, size, sha256); `missing` where there is none."""
    return expected.join(files, "path", "left").withColumn("missing", F.col("sha256").isNull())


def first_valid(options: DataFrame, key: str, valid: str = "valid") -> DataFrame:
    """The option of each key with the lowest priority number that is valid."""
    return top_k(options.filter(valid), [key], [F.asc("priority")], 1, "n_").drop("n_")


def admit(base: DataFrame, adapter: DataFrame, slack: float = 0.05) -> DataFrame:
    """Whether an adapter (case_id, coverage, verified) may replace the base: no verified case lost, coverage lower by no more than slack."""
    both = base.alias("b").join(adapter.alias("a"), "case_id")
    s = both.agg(F.avg("b.coverage").alias("base"), F.avg("a.coverage").alias("adapter"), F.coalesce(F.sum((F.col("b.verified") & ~F.col("a.verified")).cast("long")), F.lit(0)).alias("lost"))
    return s.withColumn("admitted", (F.col("lost") == 0) & (F.col("adapter") + slack >= F.col("base")))


def fastest_verified(runs: DataFrame) -> DataFrame:
    # Of equal latencies the smallest variant; rows that lack one of the two can't be the fastest.
    order = F.when(F.col("latency").isNotNull() & F.col("variant").isNotNull(), F.struct("latency", "variant"))
    return runs.filter("verified").agg(F.min_by("variant", order).alias("variant"), F.min("latency").alias("latency"))
