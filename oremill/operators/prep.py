"""Splits, scaling and encoding; statistics come from train rows only."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oremill.functions.columns import hash28, hash_order

from .clean import fill_with_train_mean
from .ranking import distributed_rank
from .selection import thresholds, trial_hashes


def _name(rank: Column, n: Column, p_train: float, p_val: float) -> Column:
    a, b = F.bround(n * p_train), F.bround(n * p_val)
    return F.when(rank <= a, "train").when(rank <= a + b, "val").otherwise("test")


def split_exact(df: DataFrame, ident: str, seed: int = 42, p_train: float = 0.65, p_val: float = 0.15) -> DataFrame:
    """Adds ``split`` with rounded exact sizes, in the order of md5(seed:id)."""
    keyed = df.withColumn("__h", hash_order(seed, F.col(ident)))
    ranked = distributed_rank(keyed, ["__h", ident], "__r").crossJoin(F.broadcast(df.agg(F.count("*").alias("__n"))))
    return ranked.withColumn("split", _name(F.col("__r"), F.col("__n"), p_train, p_val)).drop("__h", "__r", "__n")


def split_hash(df: DataFrame, ident: str, seed: int = 42, p_train: float = 0.65, p_val: float = 0.15) -> DataFrame:
    """Adds ``split`` by a hash of the id; no shuffle, sizes are near the shares."""
    u = hash28(str(seed), F.col(ident).cast("string")) / F.lit(float(1 << 28))
    return df.withColumn("split", F.when(u < p_train, "train").when(u < p_train + p_val, "val").otherwise("test"))


def split_trials(df: DataFrame, ident: str, trials: int, p_train: float, p_val: float) -> DataFrame:
    """(trial, id, split) of train and val rows, exact sizes in each trial where ids are a key.

    A trial's sizes are two thresholds on its hashes, found by counts; a row then
    tells its own part in each trial, so the table is not copied or shuffled.
    """
    n = df.count()
    a, b = round(n * p_train), round(n * p_val)
    hashes = trial_hashes(trials, F.col(ident))
    last = thresholds(df, hashes, [(t, r) for t in range(trials) for r in (a, a + b)])[0].reshape(trials, 2).tolist()
    limits = F.from_json(F.lit(json.dumps(last)), "array<array<bigint>>")
    part = F.transform(F.arrays_zip(hashes.alias("h"), limits.alias("l")), lambda x: F.when(x["h"] <= x["l"][0], "train").when(x["h"] <= x["l"][1], "val"))
    return df.select(ident, F.posexplode(part).alias("trial", "split")).where("split is not null").select("trial", ident, "split")


def _scaled(df: DataFrame, feats: Sequence[str], train: Column, by: Sequence[str], shift, spread) -> DataFrame:
    stats = df.where(train).groupBy(*by).agg(*[f(c).alias(f"__{i}_{c}") for c in feats for i, f in enumerate((shift, spread))])
    out = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))
    width = lambda c: F.when(F.col(f"__1_{c}") < 1e-12, F.lit(1.0)).otherwise(F.col(f"__1_{c}"))
    return out.withColumns({c: (F.col(c) - F.col(f"__0_{c}")) / width(c) for c in feats}).select(*df.columns)


def zscore_fit_apply(df: DataFrame, feats: Sequence[str], train: Column, by: Sequence[str] = ()) -> DataFrame:
    """Train mean and population deviation; a constant column is divided by 1."""
    return _scaled(df, feats, train, by, F.avg, F.stddev_pop)


def minmax_fit_apply(df: DataFrame, feats: Sequence[str], train: Column, by: Sequence[str] = ()) -> DataFrame:
    """Train minimum and range, not clipped; a constant column maps to 0."""
    return _scaled(df, feats, train, by, F.min, lambda c: F.max(c) - F.min(c))


def geo_encode(df: DataFrame, geo: DataFrame, on: str, train: Column, fallback: dict[str, float], region: str, region_fill: int = -1) -> DataFrame:
    """Coordinates and region of the lookup, missing ones filled."""
    return fill_with_train_mean(df.join(geo, on, "left"), list(fallback), train, fallback, region, region_fill)


def region_relabel(cities: DataFrame, prices: DataFrame, cluster: str, key: str, y: str) -> DataFrame:
    """Cluster numbers by ascending unweighted mean of their cities' means; no price: 0."""
    means = prices.groupBy(key).agg(F.avg(y).alias("__m"))
    per = cities.join(means, key, "left").groupBy(cluster).agg(F.coalesce(F.avg("__m"), F.lit(0.0)).alias("mean"))
    return per.select(cluster, "mean", (F.row_number().over(Window.orderBy("mean", cluster)) - 1).alias("region"))


def zscore_groups(df: DataFrame, y: str, feats: Sequence[str]) -> DataFrame:
    """Of a small summary: y by its sample deviation, features by the population one + 1e-9."""
    cols = [y, *feats]
    one = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], F.stddev_samp(y).alias(f"__s_{y}"), *[(F.stddev_pop(c) + 1e-9).alias(f"__s_{c}") for c in feats])
    return df.crossJoin(F.broadcast(one)).withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}") for c in cols}).select(*df.columns)
