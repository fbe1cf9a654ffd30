"""Quality rules: fixed limits, then a decision list learnt from labelled statistics, all in Spark SQL functions.

Sequential covering: on two thirds of the labelled rows a rule for bad documents grows, one threshold condition at a time, by
the best information gain; on the last third it is pruned to the prefix with the best (p - n) / (p + n); a rule that is precise
enough there is added to the list and the rows it covers are set aside. Where it isn't, growth begins again from the best
condition on another side of a statistic, until none is left. The list becomes an ordered conditional expression.
Thresholds lie at quantiles, ever finer towards both ends as labelled rows allow, so what shows in a thin tail only is found.
Rows are summed by their statistics' quantile bins first; each step is one aggregation and brings a few counts to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_SPACES = "\t\n\x0b\x0c\r "
_SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Statistics that conditions may use.
FEATURES = ["n_words", "mean_word", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "distinct_share"]
BINS = 32
MAX_CONDITIONS = 3
LEAST_PRECISION, LEAST_COVERED = 0.9, 5


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(s: Column) -> Column:
        n = F.size(s)
        twin = F.filter(s, lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"])) | ((j < n - 1) & (s[F.least(j + 1, n - 1)]["h"] == x["h"])))
        places = F.sort_array(F.transform(twin, lambda x: x["i"]))
        return F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    def some(t: Column) -> Column:
        pairs = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(_let(pairs, covered))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(windows, some))


def statistics(docs: DataFrame, text_col: str = "text") -> list[Column]:
    """The counts of a text, as columns; a null text counts as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(F.translate(t, _SPACES, " " * len(_SPACES)), " "), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    size = F.length(t)
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    return [
        of_words.alias("of_words"),
        F.length(F.translate(t, _SPACES, "")).cast("long").alias("word_chars"),
        (size - F.length(F.translate(t, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (size - F.length(F.translate(t, _UPPER, ""))).cast("long").alias("n_upper"),
        (size - F.length(F.translate(t, "!?", ""))).cast("long").alias("n_marks"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the shares of FEATURES)."""
    raw = docs.select(F.col(id_col), *statistics(docs, text_col)).select(id_col, "of_words.*", "word_chars", "n_symbols", "n_upper", "n_marks", "n_dup_lines", "n_lines")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return raw.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "n_words").alias("symbol_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_marks", "n_words").alias("mark_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"), share("n_distinct", "n_words").alias("distinct_share"),
    )


def _gain(p1: int, n1: int, p0: int, n0: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else -1.0


def _levels(bins: int, rows: int, covered: int) -> list[float]:
    """Even quantiles, and halves of the outermost bins for as long as they hold enough rows."""
    out = {i / bins for i in range(1, bins)}
    tail = 0.5 / bins
    while tail * rows >= covered:
        out |= {tail, 1 - tail}
        tail /= 2
    return sorted(out)


def learn(labelled: DataFrame, bad_col: str = "bad", features: list[str] = FEATURES, bins: int = BINS, max_conditions: int = MAX_CONDITIONS, precision: float = LEAST_PRECISION, covered: int = LEAST_COVERED, fold_col: str = "fold") -> list[list[tuple[str, str, float]]]:
    """Rules for rows whose `bad_col` is true, each a list of (feature, "<=" or ">", threshold), from rows with features, bad_col
    and fold_col (true: grow, false: prune). No rule if a class is missing. All labelled rows count."""
    scratch = Scratch(labelled.sparkSession, "quality")
    levels = _levels(bins, labelled.count(), covered)
    at = labelled.agg(*(F.percentile_approx(f, levels, 100_000).alias(f) for f in features)).first()
    cuts = {f: sorted(set(at[f] or [])) for f in features}

    def binned_by(f: str) -> Column:
        edges = F.array(*(F.lit(float(c)) for c in cuts[f])).cast("array<double>")
        return F.size(F.filter(edges, lambda c: c < F.col(f)))

    # A value that many rows share is split from those below it by the greatest of these.
    spread = labelled.select(F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("x"), F.get(F.array(*(F.lit(float(c)) for c in cuts[f])).cast("array<double>"), binned_by(f)).alias("edge")) for f in features))).alias("v")).select("v.*")
    for r in spread.filter("x < edge").groupBy("f", "edge").agg(F.max("x").alias("x")).collect():
        cuts[r["f"]].append(r["x"])
    cuts = {f: sorted(set(c)) for f, c in cuts.items()}
    binned = labelled.select(*(binned_by(f).alias(f) for f in features), F.col(bad_col).alias("bad"), F.col(fold_col).alias("grow"))
    rows = scratch.save(binned.groupBy(*features, "bad", "grow").agg(F.count("*").alias("n")), "binned")

    def covers(rule) -> Column:
        out = F.lit(True)
        for f, op, i in rule:  # bin <= i holds for x <= cuts[i]
            out &= (F.col(f) <= i) if op == "<=" else (F.col(f) > i)
        return out

    def openings(rows_: DataFrame) -> list[tuple[float, tuple[str, str, int]]]:
        """The best condition on each side of each statistic with its gain, best first."""
        flat = rows_.select(F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("bin")) for f in features))).alias("x"), "bad", "n").groupBy("x.f", "x.bin").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("q")).collect()
        counts: dict[str, dict[int, tuple[int, int]]] = {}
        for r in flat:
            counts.setdefault(r["f"], {})[r["bin"]] = (r["p"], r["q"])
        if not counts:
            return []
        p0, n0 = (sum(x[i] for x in counts[features[0]].values()) for i in (0, 1))
        if not p0 or not n0:
            return []
        found: dict[tuple[str, str], tuple[float, int]] = {}
        for f in features:
            p = n = 0
            for i in range(len(cuts[f])):
                a, b = counts[f].get(i, (0, 0))
                p, n = p + a, n + b
                for op, x, y in (("<=", p, n), (">", p0 - p, n0 - n)):
                    gain = _gain(x, y, p0, n0)
                    if gain > max(1e-9, found.get((f, op), (0.0, 0))[0]):
                        found[f, op] = (gain, i)
        return sorted(((g, (f, op, i)) for (f, op), (g, i) in found.items()), key=lambda z: (-z[0], z[1]))

    def grown(left: DataFrame, first: tuple[str, str, int]):
        """The rule grown from a first condition and pruned, or None if it isn't good enough."""
        rule = [first]
        while len(rule) < max_conditions:
            next_ = openings(left.filter("grow").filter(covers(rule)))
            if not next_:
                break
            rule.append(next_[0][1])
        sums = left.filter(~F.col("grow")).agg(*(F.sum(F.when(covers(rule[: k + 1]) & (F.col("bad") == bad), F.col("n")).otherwise(0)).alias(f"{k}{bad}") for k in range(len(rule)) for bad in (True, False))).first()
        worth = [((sums[f"{k}True"] or 0), (sums[f"{k}False"] or 0), k) for k in range(len(rule))]
        p, n, k = max(worth, key=lambda x: ((x[0] - x[1]) / max(1, x[0] + x[1]), x[0], -x[2]))
        return rule[: k + 1] if p >= covered and p >= precision * (p + n) else None

    rules: list = []
    while True:
        left = rows
        for rule in rules:
            left = left.filter(~covers(rule))
        good = next((r for r in (grown(left, first) for _, first in openings(left.filter("grow"))) if r), None)
        if good is None:
            break
        rules.append(good)
    scratch.drop("binned")
    return [[(f, op, float(cuts[f][i])) for f, op, i in rule] for rule in rules]


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for f, op, t in rule:
            holds &= (F.col(f) <= t) if op == "<=" else (F.col(f) > t)
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) of every document.

    labels: (id, label_col), 0 for bad, 1 for good; other labels and nulls are not used, and of several labels of an id the
    lowest counts. Null and empty texts have counts of 0 and fail the base. Repeated rows are judged each. Without labels of
    both kinds there is no rule, and what passes the base is kept.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.save(measure(docs.select(id_col, text_col), id_col, text_col), "stats")
    marked = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("labelled_id")).agg(F.min(label_col).alias("label"))
    known = stats.filter("not base_failed").join(marked, stats[id_col] == F.col("labelled_id"))
    rules = learn(known.select(*FEATURES, (F.col("label") == 0).alias("bad"), (F.pmod(F.xxhash64(id_col), F.lit(3)) > 0).alias("fold")))
    ruled = stats.withColumn("rule", verdict(rules))
    return ruled.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels)
