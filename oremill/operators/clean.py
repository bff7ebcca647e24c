"""Filters, corrections and fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.functions.columns import in_box

from .selection import random_sample

__all__ = ["random_sample"]

BOX = (32.0, 37.0, -121.0, -114.0)


def bbox_filter(df: DataFrame, lat: str, lon: str, box: tuple = BOX) -> DataFrame:
    return df.where(in_box(F.col(lat), F.col(lon), box))


def bbox_violations(df: DataFrame, lat: str, lon: str, box: tuple = BOX) -> DataFrame:
    """The others; a null coordinate counts as outside."""
    return df.where(~F.coalesce(in_box(F.col(lat), F.col(lon), box), F.lit(False)))


def keyed_overwrite(df: DataFrame, fixes: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Values of ``fixes`` where it has the key, else those of ``df``."""
    f = fixes.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in cols])
    out = df.join(f, key, "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns])


def conjunctive_pick(df: DataFrame, preds_in_order: Sequence[Column], ident: str) -> DataFrame:
    """The first row, by id, of the first condition that any row meets; one pass."""
    rank = F.coalesce(*[F.when(F.coalesce(p, F.lit(False)), F.lit(i)) for i, p in enumerate(preds_in_order)])
    return df.withColumn("priority", rank).where("priority is not null").orderBy("priority", ident).limit(1)


def residual_columns(df: DataFrame, y: str, pred: str) -> DataFrame:
    err = F.col(pred) - F.col(y)
    return df.withColumns({"err": err, "abs_err": F.abs(err), "side": F.when(err > 0, "over").otherwise("under")})


def dropna_subset(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def fill_with_train_mean(df: DataFrame, cols: Sequence[str], train: Column, fallback: dict[str, float], region: str | None = None, region_fill: int = -1) -> DataFrame:
    """Nulls become the mean over train rows, or the constant where there is none."""
    means = df.where(train).agg(*[F.avg(c).alias(f"__{c}") for c in cols])
    out = df.crossJoin(F.broadcast(means))
    filled = {c: F.coalesce(c, f"__{c}", F.lit(fallback[c])) for c in cols}
    if region:
        filled[region] = F.coalesce(region, F.lit(region_fill))
    return out.withColumns(filled).select(*df.columns)


def join_features(df: DataFrame, feats: DataFrame, on: str = "image_id") -> DataFrame:
    return df.join(feats, on, "left")


def join_city_lookup(df: DataFrame, geo: DataFrame, on: str) -> DataFrame:
    """A dimension table; Spark broadcasts it where its size is under the session's threshold."""
    return df.join(geo, on, "left")


def join_city_stats(geo: DataFrame, df: DataFrame, train: Column, key: str, y: str) -> DataFrame:
    """The lookup with each key's train mean and count; keys without a mean are dropped."""
    stats = df.where(train).groupBy(key).agg(F.avg(y).alias("mean_y"), F.count("*").alias("n"))
    return geo.join(stats, key, "left").fillna(0, subset=["n"]).dropna(subset=["mean_y"])


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """The most frequent values; ties by value."""
    return df.groupBy(key).count().orderBy(F.desc("count"), key).limit(n)


def semi_top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.join(top_groups(df, key, n), key, "left_semi")


def anti_cached(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return keys.select(key).distinct().join(cache, key, "left_anti")
