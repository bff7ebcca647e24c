"""Counts, histograms, box statistics and error bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import checkpointed, prefix_sums

WITHIN = (50_000, 100_000, 200_000)


def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = (), approx: bool = False, within: Sequence[float] = WITHIN) -> DataFrame:
    """mae, rmse, sse, median_abs, max_abs, shares within bounds, n; of each group of ``by``.

    ``approx`` takes an approximate median, whose state does not grow with a group.
    """
    err = F.col(pred) - F.col(y)
    a = F.abs(err)
    median = F.percentile_approx(a, 0.5, 10_000) if approx else F.median(a)
    bundle = [F.avg(a).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.sum(err * err).alias("sse"), median.alias("median_abs"), F.max(a).alias("max_abs")]
    bundle += [F.avg((a <= t).cast("double")).alias(f"within_{int(t // 1000)}k") for t in within]
    return df.groupBy(*by).agg(*bundle, F.count("*").alias("n"))


def group_mean_fallback(df: DataFrame, key: str, y: str, train: Column, out: str) -> DataFrame:
    """The key's mean over train rows, for unseen keys the mean of all train rows."""
    sums = df.where(train).groupBy(key).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    means = sums.select(F.col(key).alias("__k"), (F.col("__s") / F.col("__n")).alias("__m"))
    whole = sums.agg((F.sum("__s") / F.sum("__n")).alias("__g"))
    joined = df.join(means, F.col(key) == F.col("__k"), "left").crossJoin(F.broadcast(whole))
    return joined.withColumn(out, F.coalesce("__m", "__g")).drop("__k", "__m", "__g")


def count_by_group(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def order_statistics(df: DataFrame, col: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by.., n, at): exact values of each group at ``shares`` of its sorted values, between two of them in proportion; nulls are left out.

    Values are counted first; prefix sums of the counts over range partitions
    give every value its ranks, and only values that hold a wanted rank go on,
    two for each share at most. So no task holds or sorts a group.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    counts = df.where(F.col(col).isNotNull()).groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(col).cast("double").alias("__x")).agg(F.count("*").alias("__c"))
    run = checkpointed(prefix_sums(counts, [*keys, "__x"], ["__c"]).select(*keys, "__x", (F.col("cum___c") - F.col("__c")).alias("__lo"), F.col("cum___c").alias("__hi")))
    groups = run.groupBy(*keys).agg(F.min("__lo").alias("__base"), F.max("__hi").alias("__end")).where("__end is not null")
    at = [F.lit(float(p)) * (F.col("__end") - F.col("__base") - 1) for p in shares]
    groups = groups.select(*[F.col(k).alias(f"{k}g") for k in keys], "__base", (F.col("__end") - F.col("__base")).alias("n"), F.array(*at).alias("__at"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}g"))
    joined = run.join(groups, same) if keys else run.crossJoin(F.broadcast(groups))
    wanted = F.array_distinct(F.flatten(F.transform("__at", lambda a: F.array(F.floor(a), F.ceil(a)))))
    held = F.filter(wanted, lambda r: (r >= F.col("__lo") - F.col("__base")) & (r < F.col("__hi") - F.col("__base")))
    found = joined.select(*keys, "n", "__at", "__x", F.explode(held).alias("__r"))
    found = found.groupBy(*keys, "n", "__at").agg(F.map_from_entries(F.collect_list(F.struct("__r", "__x"))).alias("__v"))
    value = lambda a: F.element_at("__v", F.floor(a)) * (1 - (a - F.floor(a))) + F.element_at("__v", F.ceil(a)) * (a - F.floor(a))
    return found.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "n", F.transform("__at", value).alias("at"))


def with_order(df: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Aggregates of ``df`` by ``by`` with the groups' order statistics ``at``, null for groups without values."""
    if not by:
        return df.crossJoin(F.broadcast(found.agg(F.first("at").alias("at"))))
    same = F.lit(True)
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__g_{b}"))
    return df.join(found.select(*[F.col(b).alias(f"__g_{b}") for b in by], "at"), same, "left").drop(*[f"__g_{b}" for b in by])


def mean_median(df: DataFrame, col: str) -> DataFrame:
    return with_order(df.agg(F.avg(col).alias("mean")), order_statistics(df, col, [0.5]), ()).select("mean", F.col("at")[0].alias("median"))


def hist_equal_width(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n) of equal bins over the column's range; the last is closed."""
    span = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    x = F.col(col)
    width = F.when(F.col("__hi") > F.col("__lo"), (F.col("__hi") - F.col("__lo")) / bins).otherwise(F.lit(1.0))
    b = F.least(F.floor((x - F.col("__lo")) / width), F.lit(bins - 1)).cast("int")
    d = df.where(x.isNotNull()).crossJoin(F.broadcast(span)).select(b.alias("bin"), "__lo", width.alias("__w"))
    return d.groupBy("bin", "__lo", "__w").agg(F.count("*").alias("n")).select("bin", (F.col("__lo") + F.col("bin") * F.col("__w")).alias("lo"), (F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("hi"), "n")


def hist_fixed_edges(df: DataFrame, col: str, lo: float, hi: float, width: float) -> DataFrame:
    """(bin, n); values outside are dropped, the last bin is closed."""
    last = round((hi - lo) / width) - 1
    b = F.least(F.floor((F.col(col) - lo) / width), F.lit(last)).cast("int")
    return df.where(F.col(col).between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def cap_pileup(df: DataFrame, col: str, cap: float | None = None, floor: float | None = None) -> DataFrame:
    """How many rows are exactly at the cap (default: the maximum), and at the floor or above."""
    values = df.groupBy(col).agg(F.count("*").alias("n"))
    top = values.agg(F.max(col).alias("top"))
    at = F.lit(cap) if cap is not None else F.col("top")
    return values.crossJoin(F.broadcast(top)).agg(F.max(at).alias("cap"), F.sum(F.when(F.col(col) == at, F.col("n")).otherwise(0)).alias("at_cap"), F.sum(F.when(F.col(col) >= (floor if floor is not None else F.lit(float("-inf"))), F.col("n")).otherwise(0)).alias("from_floor"))


def box_stats(df: DataFrame, col: str, by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """n, quartiles, whiskers at the furthest points within 1.5 spreads, outliers, mean.

    Exact quartiles are ``order_statistics``; ``approx`` takes sketches in one pass.
    """
    x = F.col(col)
    quart = df.groupBy(*by).agg(F.avg(x).alias("mean"), F.count(x).alias("n"), *([F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias("q")] if approx else []))
    if not approx:
        quart = with_order(quart, order_statistics(df, col, [0.25, 0.5, 0.75], by), by).withColumnRenamed("at", "q")
    quart = quart.select(*by, "n", "mean", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    joined = df.where(x.isNotNull()).select(*by, x.alias("__x"))
    joined = joined.join(quart, list(by)) if by else joined.crossJoin(F.broadcast(quart))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("__x").between(F.col("q1") - reach, F.col("q3") + reach)
    keys = [*by, "n", "mean", "q1", "median", "q3"]
    return joined.groupBy(*keys).agg(F.min(F.when(inside, F.col("__x"))).alias("lo_whisker"), F.max(F.when(inside, F.col("__x"))).alias("hi_whisker"), F.count_if(~inside).alias("outliers"))


def column_std_profile(df: DataFrame, feats: Sequence[str], train: Column, flag: float = 100) -> DataFrame:
    """Population deviation of each column over train rows, widest first."""
    one = df.where(train).agg(*[F.stddev_pop(c).alias(c) for c in feats])
    long = one.unpivot([], list(feats), "feature", "std")
    return long.withColumn("flagged", F.col("std") > flag).orderBy(F.desc("std"), "feature")


def group_feature_means(df: DataFrame, key: str, y: str, feats: Sequence[str], train: Column, top: int) -> DataFrame:
    t = df.where(train)
    n = t.groupBy(key).agg(F.count("*").alias("n"), F.avg(y).alias(f"mean_{y}"), *[F.avg(c).alias(f"mean_{c}") for c in feats])
    return n.orderBy(F.desc("n"), key).limit(top)


def subgroup_metrics(df: DataFrame, key: str, y: str, preds: Sequence[str], top: int = 10) -> DataFrame:
    """n and MAE of two predictions for the largest groups, and their difference."""
    a, b = preds
    mae = lambda p: F.avg(F.abs(F.col(p) - F.col(y)))
    g = df.groupBy(key).agg(F.count("*").alias("n"), mae(a).alias("mae_a"), mae(b).alias("mae_b"))
    return g.orderBy(F.desc("n"), key).limit(top).withColumn("delta", F.col("mae_b") - F.col("mae_a")).orderBy("mae_a", key)


def cv_summary(trials: DataFrame, by: Sequence[str] = ("model", "features"), value: str = "mae") -> DataFrame:
    sums = trials.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return with_order(sums, order_statistics(trials, value, [0.5, 0.05, 0.95], by), by).select(*by, "mean", *[F.col("at")[i].alias(c) for i, c in enumerate(("median", "p05", "p95"))], "n")


def cv_best_param(trials: DataFrame, group: str = "metric", param: str = "k", value: str = "mae") -> DataFrame:
    """The parameter of the least median over trials, the first of equals."""
    m = trials.groupBy(group, param).agg(F.median(value).alias("median"))
    w = Window.partitionBy(group).orderBy("median", param)
    return m.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def best_model_selection(metrics: DataFrame, by: Sequence[str], order_col: str, value: str = "mae") -> DataFrame:
    """The row of least error of each group, ties by place in the sweep."""
    w = Window.partitionBy(*by).orderBy(value, order_col)
    return metrics.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def comparison_pivot(metrics: DataFrame, row: str, col: str, value: str, values: Sequence[str]) -> DataFrame:
    """A row per variant with a column per model, its best, and a flag on the best of all."""
    wide = metrics.groupBy(row).pivot(col, list(values)).agg(F.min(value))
    best = F.least(*[F.col(v) for v in values])
    least = wide.agg(F.min(best).alias("__least"))
    return wide.crossJoin(F.broadcast(least)).select(row, *values, best.alias("best"), (best == F.col("__least")).alias("overall_best"))


def cluster_profile(df: DataFrame, cluster: str, y: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.avg(y).alias("mean"), F.median(y).alias("median"), F.count("*").alias("n")).orderBy("mean")


def sufficient_stats(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    a, b = F.col(x), F.col(y)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(key).distinct().orderBy(key)


def state_shares(df: DataFrame, state: str) -> DataFrame:
    """Count and percentage of each state."""
    c = df.groupBy(state).agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("__t")))).select(state, "n", (100.0 * F.col("n") / F.col("__t")).alias("percent"))
