"""Accuracy, word errors, percentiles and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The latency histogram's upper bounds, in milliseconds.
BOUNDS = (5, 10, 20, 30, 40, 50, 75, 100, 200, 400, 800)


def pair_up(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """One to one by key; a key on one side only fails the job."""
    g, p = gold.withColumn("_g", F.lit(True)), predicted.withColumn("_p", F.lit(True))
    both = g.join(p, key, "full")
    return both.where(F.when(F.col("_g").isNull() | F.col("_p").isNull(), F.raise_error(F.concat(F.lit("unmatched "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("_g", "_p")


def accuracy(rows: DataFrame, sets: Sequence[Sequence[str]], correct: Column, columns: Sequence[str], present: Column | None = None) -> DataFrame:
    """n, correct, accuracy for each grouping set, in one pass; columns outside a set are null.

    With ``present`` also present_n and present_accuracy, of the rows that have the field at all.
    """
    named = rows.select(*columns, correct.cast("int").alias("ok"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("there"))
    own = F.when(F.col("there"), F.col("ok"))
    more = [] if present is None else [F.count(own).alias("present_n"), F.avg(own).alias("present_accuracy")]
    return named.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns)).agg(F.count("*").alias("n"), F.sum("ok").alias("correct"), F.avg("ok").alias("accuracy"), *more)


def missing_scores(rows: DataFrame, by: str, gold: Column, predicted: Column) -> DataFrame:
    """Precision and recall of saying that a field is missing; denominators are 1 at least."""
    both = (gold.isNull() & predicted.isNull()).cast("int")
    n = rows.groupBy(by).agg(F.sum(both).alias("hit"), F.sum(predicted.isNull().cast("int")).alias("said"), F.sum(gold.isNull().cast("int")).alias("true"))
    return n.select(by, (F.col("hit") / F.greatest(F.lit(1), F.col("said"))).alias("missing_precision"), (F.col("hit") / F.greatest(F.lit(1), F.col("true"))).alias("missing_recall"))


def overlaps(rows: DataFrame, keys: Sequence[str], gold: str, predicted: str) -> DataFrame:
    """keys, gold_n, predicted_n, common: sizes of two arrays of tokens and of their multiset intersection; keys are unique.

    Tokens are counted by key, combined before the shuffle, so texts of any length take time in proportion.
    """
    side = lambda c, k: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.struct(t.alias("token"), F.lit(k).alias("gold")))
    both = rows.select(*keys, F.explode_outer(F.concat(side(F.col(gold), True), side(F.col(predicted), False))).alias("x"))
    n = lambda mine: F.count(F.when(F.col("x.gold") == mine, 1))
    counted = both.groupBy(*keys, F.col("x.token").alias("token")).agg(n(True).alias("g"), n(False).alias("p"))
    return counted.groupBy(*keys).agg(F.sum("g").alias("gold_n"), F.sum("p").alias("predicted_n"), F.sum(F.least("g", "p")).alias("common"))


def f1() -> Column:
    """Token F1 of what ``overlaps`` gives: 1 if both are empty, 0 if one is."""
    g, p = F.col("gold_n"), F.col("predicted_n")
    return F.when(g + p == 0, 1.0).when((g == 0) | (p == 0), 0.0).otherwise(2.0 * F.col("common") / (g + p))


def benchmark_scores(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """scope, field, n, accuracy, mean_f1, exact, specificity; ``rows`` has split, field, gold, f1 and exact.

    Scopes are all pages, all but those trained on, and each other split. ``accuracy`` is the part with an F1 of 0.9 at
    least; ``specificity`` that of pages without the field on which nothing was found, null without such pages.
    """
    scopes = F.array(F.lit("all"), F.when(F.col("split") != "train", "nontrain"), F.when(F.col("split").isin("validation", "test"), F.col("split")))
    each = rows.withColumn("scope", F.explode(F.filter(scopes, lambda s: s.isNotNull())))
    absent = F.coalesce(F.col("gold"), F.lit("")) == ""
    ok = lambda c: F.avg(c.cast("int"))
    return each.groupBy("scope", "field").agg(
        F.count("*").alias("n"), ok(F.col("f1") >= least).alias("accuracy"), F.avg("f1").alias("mean_f1"), ok(F.col("exact")).alias("exact"), F.avg(F.when(absent, (F.col("f1") == 1).cast("int"))).alias("specificity")
    )


def histogram(rows: DataFrame, value: str, bounds: Sequence[int] = BOUNDS) -> DataFrame:
    """le, n: rows at most as large as each bound, then all."""
    sums = rows.agg(*(F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{b}") for b in bounds), F.count(value).alias("all"))
    cells = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.coalesce(f"b{b}", F.lit(0)).alias("n")) for b in bounds), F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return sums.select(F.explode(cells).alias("c")).select("c.le", "c.n")


def latency_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, mean, median, p95; median and p95 at nearest ranks."""
    rank = lambda part: F.expr(f"percentile_disc({part}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), rank(0.5).alias("median"), rank(0.95).alias("p95"))


def split_counts(rows: DataFrame, split: str, label: str, wanted: dict[str, int]) -> DataFrame:
    """split, label, n; a split whose rows are not as many as wanted is an error."""
    total = rows.groupBy(split).agg(F.count("*").alias("total"))
    expected = F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv))
    wrong = F.coalesce(expected[F.col(split)] != F.col("total"), F.lit(False))
    checked = total.where(F.when(wrong, F.raise_error(F.concat(F.lit("wrong size of "), F.col(split))).cast("boolean")).otherwise(True))
    return rows.groupBy(split, label).agg(F.count("*").alias("n")).join(checked.select(split), split)


def nearest_rank(rows: DataFrame, by: str, value: str, part: float = 0.95) -> DataFrame:
    """by, value at rank ceil(n * part)."""
    return rows.groupBy(by).agg(F.expr(f"percentile_disc({part}) WITHIN GROUP (ORDER BY {value})").alias("p"))


def floor_index(rows: DataFrame, by: str, value: str, part: float = 0.95) -> DataFrame:
    """by, value at index floor(part * (n - 1)) of the sorted values: another definition.

    Equal values are counted together, and running counts give the index, so no group's values meet in an array.
    """
    from pyspark.sql import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(by).orderBy(value)))
    total = counts.groupBy(by).agg(F.sum("n").alias("total"))
    return upto.join(total, by).where(F.col("upto") > F.floor(F.lit(part) * (F.col("total") - 1))).groupBy(by).agg(F.min(value).alias("p"))


def choose_margin(rows: DataFrame, margins: Sequence[float], gain: str = "gain", fixed: str = "fixed_ok", kept: str = "kept_ok") -> DataFrame:
    """The margin with most correct rows, then fewest changes: a change is taken where the gain is above the margin."""
    each = rows.select("*", F.explode(F.array(*(F.lit(float(m)) for m in margins))).alias("margin"))
    changed = F.col(gain) > F.col("margin")
    sums = each.groupBy("margin").agg(F.sum(F.when(changed, F.col(fixed)).otherwise(F.col(kept)).cast("int")).alias("correct"), F.sum(changed.cast("int")).alias("changed"))
    return sums.orderBy(F.desc("correct"), "changed", "margin").limit(1)


def argmax_with_missing(rows: DataFrame, key: str, at: str, score: Column, missing: float) -> DataFrame:
    """key, chosen, share: the row with the highest score, the earliest of equals, or null if the missing score is higher.

    ``share`` is the softmax share of the choice among the rows and the missing one.
    """
    scored = rows.select(key, at, score.alias("s"))
    best = scored.groupBy(key).agg(F.max(F.struct(F.col("s"), (-F.col(at)).alias("order"))).alias("b"), F.max("s").alias("top"))
    top = F.greatest("top", F.lit(missing))
    total = scored.join(best, key).groupBy(key).agg(F.sum(F.exp(F.col("s") - top)).alias("sum"))
    none = F.col("b.s") < missing
    return best.join(total, key).select(key, F.when(~none, -F.col("b.order")).alias("chosen"), (F.when(none, F.exp(F.lit(missing) - top)).otherwise(F.exp(F.col("b.s") - top)) / (F.col("sum") + F.exp(F.lit(missing) - top))).alias("share"))
