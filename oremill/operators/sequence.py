"""Markov transition tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transition_counts(df: DataFrame, seq: str, pos: str, state: str) -> DataFrame:
    """(state, next_state, n) over neighbours within a sequence."""
    order = [pos] if isinstance(pos, str) else list(pos)
    nxt = F.lead(state).over(Window.partitionBy(seq).orderBy(*order))
    return df.select(F.col(state).alias("state"), nxt.alias("next_state")).where("next_state is not null").groupBy("state", "next_state").agg(F.count("*").alias("n"))


def transition_matrix(df: DataFrame, seq: str, pos: str, state: str, states: Sequence | None = None, wide: bool = False) -> DataFrame:
    """Row-normalised shares with all pairs of states; a state without successor has nulls."""
    spark = df.sparkSession
    names = spark.createDataFrame([(s,) for s in states], f"state {dict(df.dtypes)[state]}") if states else df.select(F.col(state).alias("state")).where("state is not null").distinct()
    pairs = names.crossJoin(F.broadcast(names.select(F.col("state").alias("next_state"))))
    c = pairs.join(transition_counts(df, seq, pos, state), ["state", "next_state"], "left").fillna(0, subset=["n"])
    total = F.sum("n").over(Window.partitionBy("state"))
    m = c.select("state", "next_state", F.col("n").cast("long").alias("n"), F.try_divide(F.col("n").cast("double"), total).alias("p"))
    return m.groupBy("state").pivot("next_state", list(states) if states else None).agg(F.first("p")) if wide else m
