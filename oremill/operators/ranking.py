"""Global ranks and prefix sums without a single task, worst-case lists, split gains."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir (unset, on a local master: a temporary one)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame, **options: str) -> DataFrame:
    """The rows, computed once: written to the shared folder as Parquet and read again.

    A ``DataFrame.checkpoint`` keeps the size that was estimated for the plan
    that it replaces; where rounds join the last one's rows with each other, the
    estimate multiplies in each, until its digits alone keep the planner busy.
    What is read from files has their size. ``options`` are the writer's.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_in = path
    return out


def forget(*done: DataFrame) -> None:
    """Deletes the files of what ``checkpointed`` returned and nothing reads any more."""
    for df in done:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_in)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _ranged(df: DataFrame, order: Sequence[str], partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())


def prefix_sums(df: DataFrame, order: Sequence[str], values: Sequence[str], partitions: int | None = None, leads: Sequence[str] = ()) -> DataFrame:
    """Adds cum_<v>: the sum of v up to the row in the order of ``order``, and all_<v>: that of all rows; next_<c>: c in the row after.

    Columns of ``order`` must be a key, those of ``leads`` hold no null. Rows
    are range-partitioned, partitions' totals give each an offset, and the rest
    is a window within a partition. Both uses of the partitions must see the
    same ones, so they are written once to the checkpoint folder.
    """
    key = F.struct(*order)
    d = checkpointed(_ranged(df, order, partitions))
    totals = d.groupBy("__part").agg(F.min(key).alias("__first"), *[F.sum(v).alias(f"__t_{v}") for v in values], *[F.min_by(c, key).alias(f"__f_{c}") for c in leads])
    parts = Window.orderBy("__first")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = totals.select(
        "__part",
        *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__o_{v}") for v in values],
        *[F.sum(f"__t_{v}").over(Window.partitionBy()).alias(f"all_{v}") for v in values],
        *[F.lead(f"__f_{c}").over(parts).alias(f"__n_{c}") for c in leads],
    )
    rows = Window.partitionBy("__part").orderBy(*order)
    inside = rows.rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(F.broadcast(offsets), "__part")
    out = out.withColumns({f"cum_{v}": F.sum(v).over(inside) + F.col(f"__o_{v}") for v in values} | {f"next_{c}": F.coalesce(F.lead(c).over(rows), f"__n_{c}") for c in leads})
    return out.drop("__part", *[f"__o_{v}" for v in values], *[f"__n_{c}" for c in leads])


def distributed_rank(df: DataFrame, order: Sequence[str], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """Row numbers from 1 over the whole table; ``order`` must be a key."""
    ranked = prefix_sums(df.withColumn("__one", F.lit(1).cast("long")), order, ["__one"], partitions)
    return ranked.withColumnRenamed("cum___one", out).drop("__one", "all___one")


def worst_k_by_segment(df: DataFrame, segment: str, err: str, ident: str, k: int) -> DataFrame:
    w = Window.partitionBy(segment).orderBy(F.desc(err), ident)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def worst_k_overall(df: DataFrame, err: str, ident: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(err), ident).limit(k)


def largest_n(df: DataFrame, col: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(col), key).limit(n)


def running_split_gain(df: DataFrame, feat: str, y: str, min_leaf: int, by: Sequence[str] = ()) -> DataFrame:
    """(by.., thr, gain) of each cut between unequal values: how much the squared error falls.

    Rows are first summed by value, so a task orders a node's distinct values, not its rows.
    """
    v = df.where(F.col(feat).isNotNull()).groupBy(*by, F.col(feat).alias("value")).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("ss"))
    up = Window.partitionBy(*by).orderBy("value")
    run, whole = up.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    v = v.withColumns({"nl": F.sum("n").over(run), "sl": F.sum("s").over(run), "n_all": F.sum("n").over(whole), "s_all": F.sum("s").over(whole), "next": F.lead("value").over(up)})
    gain = F.col("sl") * F.col("sl") / F.col("nl") + (F.col("s_all") - F.col("sl")) * (F.col("s_all") - F.col("sl")) / (F.col("n_all") - F.col("nl")) - F.col("s_all") * F.col("s_all") / F.col("n_all")
    cut = v.where(F.col("next").isNotNull() & (F.col("nl") >= min_leaf) & (F.col("n_all") - F.col("nl") >= min_leaf))
    return cut.select(*by, ((F.col("value") + F.col("next")) / 2).alias("thr"), gain.alias("gain"))


def lead_lag_condition(df: DataFrame, seq: str, pos: str, state: str, given: str, side: str) -> DataFrame:
    """Shares of the states right after (or before) a given state."""
    w = Window.partitionBy(seq).orderBy(pos)
    near = F.lead(state).over(w) if side == "after" else F.lag(state).over(w)
    n = df.withColumn("__near", near).where((F.col(state) == given) & F.col("__near").isNotNull()).groupBy(F.col("__near").alias(state)).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("__t")))).select(state, "n", (F.col("n") / F.col("__t")).alias("share"))


def k_sweep_running_mean(neighbours: DataFrame, y: str, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by.., qid, k, pred) for every k from one ranked list of neighbours."""
    w = Window.partitionBy(*by, "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return neighbours.withColumn("pred", F.avg(y).over(w)).where(F.col("rank").isin(list(ks))).select(*by, "qid", F.col("rank").alias("k"), "pred")


def midpoint_thresholds(df: DataFrame, col: str) -> DataFrame:
    """Midpoints of neighbouring distinct values; one row per distinct value is ordered."""
    v = df.where(F.col(col).isNotNull()).select(F.col(col).alias("v")).distinct()
    return prefix_sums(v, ["v"], [], leads=["v"]).where("next_v is not null").select(((F.col("v") + F.col("next_v")) / 2).alias("thr"))


def union_splits(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.where(F.col("split").isin(list(names)))


def union_dedupe_last(a: DataFrame, b: DataFrame, key: str, version: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return a.unionByName(b).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def union_model_results(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
