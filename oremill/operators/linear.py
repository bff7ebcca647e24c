"""Linear models from sums of products: the data are read once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prep import minmax_fit_apply


def constant_baseline(df: DataFrame, y: str, train: Column) -> DataFrame:
    return df.crossJoin(F.broadcast(df.where(train).agg(F.avg(y).alias("pred"))))


def gram(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group: sums of products of 1 and all columns, upper triangle, as g_i_j."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]]
    return df.groupBy(*by).agg(*[F.sum(x[i] * x[j]).alias(f"g_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))])


def solve(row, feats: Sequence[str], ridge: float) -> list[float]:
    """Normal equations with the ridge on the whole diagonal: intercept first."""
    d = len(feats) + 1
    a = np.zeros((d + 1, d + 1))
    for i in range(d + 1):
        for j in range(i, d + 1):
            a[i, j] = a[j, i] = row[f"g_{i}_{j}"] or 0.0
    return np.linalg.solve(a[:d, :d] + ridge * np.eye(d), a[:d, d]).tolist()


def predict_linear(df: DataFrame, feats: Sequence[str], weights: Sequence[float], out: str = "pred") -> DataFrame:
    return df.withColumn(out, sum((F.col(c) * F.lit(w) for c, w in zip(feats, weights[1:], strict=True)), F.lit(weights[0])))


def linear_fit_predict(df: DataFrame, feats: Sequence[str], y: str, train: Column, ridge: float = 1e-6, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(weights, predictions). With ``by``, a model for each group (a trial, say) from one aggregate."""
    spark, names = df.sparkSession, ["intercept", *feats]
    complete = train & ~F.array_contains(F.array(*[F.col(c).isNull() for c in [*feats, y]]), True)
    if not by:
        w = solve(gram(df.where(complete), [*feats, y]).head(), feats, ridge)
        return spark.createDataFrame(list(zip(names, w, strict=True)), "feature string, weight double"), predict_linear(df, feats, w)
    # a small row of sums per group
    grams = gram(df.where(complete), [*feats, y], by)
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*by).dtypes) + ", w array<double>"

    def work(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({**{c: pdf[c] for c in by}, "w": [solve(r, feats, ridge) for r in pdf.to_dict("records")]})

    fitted = grams.mapInPandas(work, schema)
    weights = fitted.select(*by, F.posexplode("w").alias("i", "weight")).withColumn("feature", F.element_at(F.array(*[F.lit(c) for c in names]), F.col("i") + 1)).drop("i")
    pred = sum((F.col(c) * F.col("w")[i + 1] for i, c in enumerate(feats)), F.col("w")[0])
    return weights, df.join(fitted, list(by)).withColumn("pred", pred).drop("w")


def linear_minmax(df: DataFrame, feats: Sequence[str], y: str, train: Column, ridge: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    return linear_fit_predict(minmax_fit_apply(df, feats, train), feats, y, train, ridge)


def slr_closed_form(df: DataFrame, x: str, y: str) -> DataFrame:
    """(beta, alpha, sse) of a line, from six sums about the means."""
    a, b = F.col(x), F.col(y)
    m = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    c = df.crossJoin(F.broadcast(m)).agg(F.sum((a - F.col("mx")) * (b - F.col("my"))).alias("cxy"), F.sum((a - F.col("mx")) * (a - F.col("mx"))).alias("cxx"), F.sum((b - F.col("my")) * (b - F.col("my"))).alias("cyy"), F.max("mx").alias("mx"), F.max("my").alias("my"))
    beta = F.col("cxy") / F.col("cxx")
    return c.select(beta.alias("beta"), (F.col("my") - beta * F.col("mx")).alias("alpha"), (F.col("cyy") - beta * F.col("cxy")).alias("sse"))


def sse_grid_search(stats: DataFrame, beta: float, alpha: float, n_grid: int = 200, tol: float = 5e-4, max_rounds: int = 50, span: float = 1.0) -> DataFrame:
    """(beta, alpha, sse, rounds): the least SSE on a mirrored log grid about the last centre, until it stays.

    Only the six sums are read again; a round is a grid of n_grid^2 rows.
    """
    spark = stats.sparkSession
    half = n_grid // 2
    step = F.when(F.col("id") == half, 0.0).otherwise(F.signum(F.col("id") - half) * span * F.pow(F.lit(10.0), -6 + 6 * F.abs(F.col("id") - half) / half))
    axis = spark.range(n_grid + 1).select(step.alias("d"))
    # six numbers
    s = stats.select("n", "sx", "sy", "sxx", "syy", "sxy").head()
    for round_ in range(1, max_rounds + 1):
        b, a = F.lit(beta) + F.col("b.d"), F.lit(alpha) + F.col("a.d")
        sse = s["syy"] + b * b * s["sxx"] + a * a * s["n"] - 2 * b * s["sxy"] - 2 * a * s["sy"] + 2 * a * b * s["sx"]
        grid = axis.alias("b").crossJoin(F.broadcast(axis.alias("a"))).select(b.alias("beta"), a.alias("alpha"), sse.alias("sse"))
        best = grid.agg(F.min_by(F.struct("beta", "alpha", "sse"), F.struct("sse", "beta", "alpha")).alias("m")).head()["m"]
        still = abs(best["beta"] - beta) < tol and abs(best["alpha"] - alpha) < tol
        beta, alpha = best["beta"], best["alpha"]
        if still:
            break
    return spark.createDataFrame([(beta, alpha, best["sse"], round_)], "beta double, alpha double, sse double, rounds int")


def predict_and_sse(df: DataFrame, beta: float, alpha: float, x: str, y: str) -> DataFrame:
    """Predictions rounded to cents, and their squared error."""
    pred = F.round(F.lit(beta) * F.col(x) + F.lit(alpha), 2)
    return df.agg(F.sum((pred - F.col(y)) * (pred - F.col(y))).alias("sse"), F.count("*").alias("n"))
