"""Measures of retrieval, ranking, preferences and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordered import running, scaled


def temporal_iou(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Intersection of [a, b] and [c, d] over their hull; 0 where the hull has no length."""
    inter = F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))
    hull = F.greatest(b, d) - F.least(a, c)
    return F.when(hull > 0, inter / hull).otherwise(0.0)


def retrieval_metrics(predicted: DataFrame, gold: DataFrame, k: int | None = None, threshold: float = 0.3) -> DataFrame:
    """(query_id, precision, recall, mrr, ndcg, mean_iou) of ranked spans (query_id, rank, start_sec, end_sec) against gold spans
    (query_id, gold_id, gold_start, gold_end). Queries with predictions or gold; all zeros without either."""
    pred = predicted if k is None else predicted.filter(F.col("rank") <= k)
    both = pred.join(gold, "query_id").withColumn("iou", temporal_iou(F.col("start_sec"), F.col("end_sec"), F.col("gold_start"), F.col("gold_end")))
    per_pred = both.groupBy("query_id", "rank").agg(F.max("iou").alias("iou"))
    hit = F.col("iou") >= threshold
    a = per_pred.groupBy("query_id").agg(F.avg(hit.cast("double")).alias("precision"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.col("iou") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count("*").alias("n_pred"))
    b = both.groupBy("query_id", "gold_id").agg(F.max("iou").alias("iou")).groupBy("query_id").agg(F.avg(hit.cast("double")).alias("recall"), F.avg("iou").alias("mean_iou"), F.count("*").alias("n_gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_pred", "n_gold").cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    scored = a.join(b, "query_id").select("query_id", "precision", "recall", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / ideal).alias("ndcg"), "mean_iou")
    everyone = predicted.select("query_id").union(gold.select("query_id")).distinct()
    return everyone.join(scored, "query_id", "left").fillna(0.0)


def gold_coverage(predicted: DataFrame, gold: DataFrame, share: float = 0.5) -> DataFrame:
    """(query_id, coverage): gold spans of which one prediction covers the share, over all gold spans of the query."""
    both = gold.join(predicted.select("query_id", "start_sec", "end_sec"), "query_id", "left")
    inter = F.greatest(F.lit(0.0), F.least("gold_end", "end_sec") - F.greatest("gold_start", "start_sec"))
    cover = F.when(F.col("start_sec").isNull(), 0.0).otherwise(inter / F.greatest(F.lit(1e-9), F.col("gold_end") - F.col("gold_start")))
    return both.groupBy("query_id", "gold_id").agg(F.max(cover).alias("c")).groupBy("query_id").agg(F.avg((F.col("c") >= share).cast("double")).alias("coverage"))


def gold_labels(spans: DataFrame, gold: DataFrame) -> DataFrame:
    """spans (query_id, segment_id, start_sec, end_sec) with `label` 1 where one touches a gold span."""
    hit = spans.join(gold, "query_id").filter(temporal_iou(F.col("start_sec"), F.col("end_sec"), F.col("gold_start"), F.col("gold_end")) > 0).select("query_id", "segment_id").distinct().withColumn("label", F.lit(1.0))
    return spans.join(hit, ["query_id", "segment_id"], "left").fillna(0.0, ["label"])


def pairwise_accuracy(rows: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(group, pairs, correct, accuracy) over positive-negative pairs of each group, equal scores being wrong.

    A pair is correct as often as negatives have a lower score: counts by score and a running sum over ranges of scores, not pairs."""
    per = rows.groupBy(*group, score).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) > 0, 0).otherwise(1)).alias("n"))
    below = running(scaled(per, score), group, F.col("place_"), [score], {"below": F.col("n")}, inclusive=False)
    out = below.withColumn("right", F.col("p") * F.col("below")).groupBy(*group).agg((F.sum("p") * F.sum("n")).alias("pairs"), F.sum("right").alias("correct"))
    return out.withColumn("accuracy", F.try_divide("correct", "pairs"))


def _running(per: DataFrame, score: str, columns: dict[str, str], descending: bool) -> DataFrame:
    """per with sums of columns over rows up to each score, itself included."""
    place = F.col("place_") * (-1 if descending else 1)
    return running(scaled(per, score), [], place, [F.desc(score) if descending else F.asc(score)], {name: F.col(c) for c, name in columns.items()}).drop("place_")


def binary_metrics(rows: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row: n, accuracy, balanced_accuracy, f1, roc_auc (null without both labels), positive and negative recall, average_precision.

    Everything comes from counts by distinct score, so ties count half and rows are summed before they are ordered."""
    per = rows.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))
    cum = _running(per, "s", {"p": "tp", "n": "fp"}, True)
    total = per.agg(F.sum("p").alias("P"), F.sum("n").alias("N"))
    hit = F.col("s") >= threshold
    sums = cum.agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("TP"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("FP"),
        F.sum(F.col("n") * (F.col("tp") - F.col("p")) + F.col("n") * F.col("p") / 2).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
    )
    r = total.join(F.broadcast(sums)).select("*")
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    P, N, TP, FP = (F.coalesce(F.col(c), F.lit(0)) for c in ("P", "N", "TP", "FP"))
    pr, nr = div(TP, P), div(N - FP, N)
    return r.select((P + N).alias("n"), div(TP + N - FP, P + N).alias("accuracy"), F.when((P > 0) & (N > 0), (pr + nr) / 2).otherwise(div(TP + N - FP, P + N)).alias("balanced_accuracy"), div(2 * TP, TP + FP + P).alias("f1"), F.try_divide(F.col("area"), P * N).alias("roc_auc"), pr.alias("positive_recall"), nr.alias("negative_recall"), div(F.col("ap"), P).alias("average_precision"))


def pick_threshold(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The threshold in use as a score that keeps every positive (label 1), then rejects most negatives, then is smallest."""
    per = rows.groupBy(F.col(score).alias("threshold")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))
    cum = _running(per, "threshold", {"p": "lost", "n": "rejected"}, False).withColumn("lost", F.col("lost") - F.col("p")).withColumn("rejected", F.col("rejected") - F.col("n"))
    return cum.orderBy(F.col("lost") > 0, F.desc("rejected"), "lost", "threshold").limit(1).select("threshold", "lost", "rejected")


def blend_grid(rows: DataFrame, group: list[str], base: str = "base", neural: str = "neural", steps: int = 20) -> DataFrame:
    """(weight, accuracy) for weights 0, 1/steps, ..., 1 of the neural score; the best comes first, of equal ones the smallest."""
    grid = rows.select(*group, "label", base, neural, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("w"))
    scored = grid.withColumn("score", F.round((1 - F.col("w") / steps) * F.col(base) + F.col("w") / steps * F.col(neural), 12))
    acc = pairwise_accuracy(scored, [*group, "w"]).groupBy("w").agg(F.sum("correct").alias("correct"), F.sum("pairs").alias("pairs"))
    return acc.select((F.col("w") / steps).alias("weight"), F.try_divide("correct", "pairs").alias("accuracy")).orderBy(F.desc("accuracy"), "weight")


def preference_statistics(pairs: DataFrame, beta: float = 0.1) -> DataFrame:
    """pairs (chosen_logp, rejected_logp, ref_chosen_logp, ref_rejected_logp) with margin, loss and gradients of the direct
    preference objective."""
    if beta <= 0:
        raise ValueError("beta must be positive")
    z = beta * ((F.col("chosen_logp") - F.col("rejected_logp")) - (F.col("ref_chosen_logp") - F.col("ref_rejected_logp")))
    out = pairs.withColumn("margin", z)
    loss = F.greatest(F.lit(0.0), -F.col("margin")) + F.log1p(F.exp(-F.abs("margin")))
    pull = F.when(F.col("margin") >= 0, F.exp(-F.col("margin")) / (1 + F.exp(-F.col("margin")))).otherwise(1 / (1 + F.exp(F.col("margin"))))
    return out.withColumn("loss", loss).withColumn("chosen_gradient", -beta * pull).withColumn("rejected_gradient", beta * pull)


def preference_rollup(stats: DataFrame, by: str = "negative_type") -> DataFrame:
    """Means by type and over all (a null type), by one rollup; flips: the policy prefers the chosen one, the reference does not."""
    flips = F.sum(((F.col("chosen_logp") > F.col("rejected_logp")) & (F.col("ref_chosen_logp") <= F.col("ref_rejected_logp"))).cast("long"))
    return stats.rollup(by).agg(F.count("*").alias("n"), F.avg("margin").alias("mean_margin"), F.avg("loss").alias("mean_loss"), F.sum((F.col("margin") > 0).cast("long")).alias("positive_margins"), flips.alias("flips"))


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r): correlation from centred sums; 0 where either side does not vary."""
    mean = rows.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    c = rows.join(F.broadcast(mean)).select((F.col(x) - F.col("mx")).alias("a"), (F.col(y) - F.col("my")).alias("b"))
    s = c.agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return s.select("n", F.coalesce(F.try_divide("ab", F.sqrt(F.col("aa") * F.col("bb"))), F.lit(0.0)).alias("r"))


def length_bias(pairs: DataFrame) -> DataFrame:
    """One row: preferences by sum and by token of policy log-probabilities, flips between them, lengths of chosen texts."""
    total = F.col("chosen_logp") > F.col("rejected_logp")
    per = F.col("chosen_logp") / F.greatest("chosen_tokens", F.lit(1)) > F.col("rejected_logp") / F.greatest("rejected_tokens", F.lit(1))
    delta = F.col("chosen_tokens") - F.col("rejected_tokens")
    return pairs.agg(F.count("*").alias("n"), F.sum(total.cast("long")).alias("by_sum"), F.sum(per.cast("long")).alias("by_token"), F.sum((delta > 0).cast("long")).alias("chosen_longer"), F.avg(delta).alias("mean_delta"), F.min(delta).alias("min_delta"), F.max(delta).alias("max_delta"))


def with_reference(pairs: DataFrame, reference: DataFrame, key: str = "pair_id") -> DataFrame:
    """pairs with the columns of their reference record and `error`: null, `missing` where there is no record, `repeated` where
    there are several (each pair still comes once, with the least of them), `incomplete` where one has a null.

    What an inner join would lose is a row with its reason, so a report can refuse to be made from part of the pairs."""
    others = [c for c in reference.columns if c != key]
    one = reference.groupBy(key).agg(F.count("*").alias("n_"), F.min(F.struct(*others)).alias("ref_"))
    out = pairs.join(one, key, "left")
    gap = F.array_contains(F.array(*(F.col(f"ref_.{c}").isNull() for c in others)), True)
    error = F.when(F.col("n_").isNull(), "missing").when(F.col("n_") > 1, "repeated").when(gap, "incomplete")
    return out.select(*(pairs[c] for c in pairs.columns), *(F.col(f"ref_.{c}").alias(c) for c in others), error.alias("error"))


def reference_bias(joined: DataFrame) -> DataFrame:
    """One row from rows of with_reference (chosen_logp, rejected_logp, chosen_tokens, rejected_tokens, reward_margin): how many
    pairs there are and lack a record, how often the longer answer is the chosen one, how often the reference prefers it by sum
    and by token, and the correlation of length and margin. Null figures while any pair has an error."""
    fine = F.col("error").isNull()
    delta = (F.col("chosen_tokens") - F.col("rejected_tokens")).cast("double")
    per = F.col("chosen_logp") / F.col("chosen_tokens") > F.col("rejected_logp") / F.col("rejected_tokens")
    share = lambda c: F.avg(F.when(fine, c.cast("double")))
    sums = joined.agg(F.count("*").alias("pairs"), F.count_if(~fine).alias("errors"), share(delta > 0).alias("chosen_longer"), share(F.col("chosen_logp") > F.col("rejected_logp")).alias("prefers_by_sum"), share(per).alias("prefers_by_token"), F.corr(F.when(fine, delta), F.when(fine, F.col("reward_margin"))).alias("r"))
    whole = F.col("errors") == 0
    return sums.select("pairs", "errors", *(F.when(whole, F.col(c)).alias(c) for c in ("chosen_longer", "prefers_by_sum", "prefers_by_token")), F.when(whole, F.coalesce("r", F.lit(0.0))).alias("length_margin_r"))


def peak_memory(performance: Column) -> Column:
    """The largest allocated amount over the devices of a run's report (JSON); 0 without devices, numbers in text count."""
    # Fixed value: where a report has its devices.
    devices = F.try_variant_get(F.try_parse_json(performance), "$.warm_pack_performance.cuda_memory.devices", "array<variant>")
    amounts = F.transform(devices, lambda v: F.coalesce(F.try_variant_get(v, "$.peak_allocated_mib", "double"), F.try_variant_get(v, "$.peak_allocated_mib", "string").try_cast("double"), F.lit(0.0)))
    return F.coalesce(F.array_max(amounts), F.lit(0.0))


def seed_statistics(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


# The steps of a run, in order.
STEPS = ["retrieve_segments", "build_context", "assess_evidence", "search_memory", "synthesize_answer", "verify_answer"]


def in_order(observed: Column, expected: list[str] = STEPS) -> Column:
    """Steps that a scan of the observed ones finds in order; it ends at one that the rest of the expected lacks."""
    want = F.array(*(F.lit(s) for s in expected))
    n = len(expected)

    def step(a: Column, x: Column) -> Column:
        at = F.array_position(F.slice(want, a["next"] + 1, F.lit(n)), x)
        return F.when(a["over"] | (at == 0), F.struct(a["next"].alias("next"), a["n"].alias("n"), F.lit(True).alias("over"))).otherwise(F.struct((a["next"] + at.cast("int")).alias("next"), (a["n"] + 1).alias("n"), F.lit(False).alias("over")))

    return F.aggregate(observed, F.struct(F.lit(0).alias("next"), F.lit(0).alias("n"), F.lit(False).alias("over")), step, lambda a: a["n"])


def harness_metrics(runs: DataFrame) -> DataFrame:
    """runs (run_id, actions, calls array<struct<name, ok>>, coverage, answer, verified) with seven parts of a run and `score`."""
    n = float(len(STEPS))
    want = F.array(*(F.lit(s) for s in STEPS))
    ok = F.when(F.size("calls") == 0, 0.0).otherwise(F.size(F.filter("calls", lambda c: F.coalesce(c["ok"], F.lit(True)))) / F.size("calls"))
    a = F.coalesce("answer", F.lit(""))
    lines = F.size(F.filter(F.split(a, "\n"), lambda x: F.startswith(F.ltrim(x), F.lit("- "))))
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    # Marks of an answer's structure and what each adds.
    structure = F.when(tx.strip(a) == "", 0.0).otherwise(part(F.contains(a, F.lit("问题：")), 0.35) + part(F.contains(a, F.lit("结论：")), 0.35) + part(F.contains(a, F.lit("timestamp=")), 0.20) + part(lines >= 2, 0.10))
    names = F.array_distinct(F.transform("calls", lambda c: c["name"]))
    traced = F.when(F.size("actions") == 0, 0.0).otherwise(F.size(F.array_intersect("actions", names)) / F.size(F.array_distinct("actions")))
    out = runs.select("run_id", (F.size(F.array_intersect(want, "actions")) / n).alias("plan_coverage"), ok.alias("tool_success"), (in_order(F.col("actions")) / n).alias("step_order"), F.coalesce("coverage", F.lit(0.0)).alias("binding"), structure.alias("structure"), F.col("verified").cast("double").alias("verification"), traced.alias("trace"))
    # Weights of the parts.
    weights = {"plan_coverage": 0.18, "tool_success": 0.18, "step_order": 0.12, "binding": 0.22, "structure": 0.12, "verification": 0.10, "trace": 0.08}
    return out.withColumn("score", sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)))


def agent_metrics(runs: DataFrame) -> DataFrame:
    """runs (run_id, kept, dropped, memory_hits, calls, ok_calls, coverage, verified) with `score`."""
    verified = F.col("verified").cast("double")
    coverage = F.when((F.coalesce("coverage", F.lit(0.0)) == 0) & F.col("verified"), 1.0).otherwise(F.coalesce("coverage", F.lit(0.0)))
    keep = F.col("kept") / F.greatest(F.lit(1), F.col("kept") + F.col("dropped"))
    memory = F.least(F.lit(1.0), F.col("memory_hits") / 3.0)
    success = F.coalesce(F.try_divide("ok_calls", "calls"), F.lit(0.0))
    # Weights of the parts.
    return runs.select("run_id", coverage.alias("coverage"), keep.alias("keep_rate"), memory.alias("memory_rate"), success.alias("tool_success"), (0.25 * verified + 0.25 * coverage + 0.20 * keep + 0.20 * success + 0.10 * memory).alias("score"))


def pack_metrics(packs: DataFrame) -> DataFrame:
    """packs (query_id, hits, selected, coverage, timeline, segments, clips) with `score`; zeros without segments."""
    some = F.col("segments") > 0
    of = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    hit, time, clip = of("hits", "selected"), of("timeline", "segments"), F.least("clips", "timeline") / F.greatest(F.lit(1), F.col("timeline"))
    out = packs.select("query_id", *(F.when(some, c).otherwise(0.0).alias(n) for n, c in (("hit_rate", hit), ("coverage", F.col("coverage")), ("timeline_coverage", time), ("clip_overlap", clip))))
    # Weights of the parts.
    return out.withColumn("score", 0.35 * F.col("hit_rate") + 0.25 * F.col("coverage") + 0.20 * F.col("timeline_coverage") + 0.20 * F.col("clip_overlap"))


def regression(cases: DataFrame) -> DataFrame:
    """cases (case_id, expected, sufficient, refused, verified, gold_hit, has_time, keywords_missing, forbidden_said) with the
    first error that applies, null if the case passes."""
    abstain = F.col("expected") == "abstain"
    error = (
        F.when(abstain & ~F.col("refused"), "overclaim").when(abstain, None).when(F.col("refused"), "false_refusal").when(~F.col("gold_hit"), "retrieval_miss").when(~F.col("has_time"), "missing_timestamp")
        .when(F.col("forbidden_said"), "forbidden_assertion").when(F.col("keywords_missing") > 0, "missing_keyword").when(~F.col("verified"), "verification_failed")
    )
    return cases.withColumn("error", error).withColumn("passed", F.col("error").isNull())


def checks_report(checks: DataFrame) -> DataFrame:
    """(report, total, passed, failures) of named checks (report, name, passed)."""
    return checks.groupBy("report").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name")))).alias("failures"))
