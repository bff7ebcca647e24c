"""Mixing sources to target weights over a training run.

Each source has a weight and a schedule of relative weight over the progress of
training, 0 to 1. The schedule's integral gives the source's cumulative token
demand; its inverse turns the tokens that precede a document in its source's
random order into a training position, and documents are range-sorted by it.

Defined results: a null text has size 0; null sources are one source, ordered
last; a null ``doc_id`` takes part like any other; equal rows are all taken on
their own account; an empty table gives an empty one. Columns other than
``doc_id``, ``text`` and ``source`` are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import WORD

#: Relative weight over progress, by a source's place in the cycle of weights.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.25), (0.6, 1.0), (1.0, 2.0)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Progress at which a piecewise linear schedule has used up ``share`` (0 to 1) of its integral."""
    pieces = list(zip(knots, knots[1:], strict=False))
    used = share * F.lit(sum((u1 - u0) * (w0 + w1) / 2 for (u0, w0), (u1, w1) in pieces))
    found, done = [F.lit(float(knots[0][0]))], 0.0
    for (u0, w0), (u1, w1) in pieces:
        left = F.greatest(used - F.lit(done), F.lit(0.0))
        # 2 left / (w0 + sqrt(w0^2 + 2 slope left)): the root without cancellation
        down = F.lit(float(w0)) + F.sqrt(F.greatest(F.lit(float(w0 * w0)) + F.lit(2 * (w1 - w0) / (u1 - u0)) * left, F.lit(0.0)))
        found.append(F.when(left > 0, F.least(F.lit(u0) + F.when(down > 0, 2 * left / down).otherwise(0.0), F.lit(float(u1)))))
        done += (u1 - u0) * (w0 + w1) / 2
    return F.greatest(*found)


def source_targets(sizes: DataFrame, cycle: Sequence[float] = (1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> also rank, weight, target.

    The sum of all sizes is shared by weight. A source stops at ``cap`` times
    its size and what it leaves is shared by weight among the others: with
    sources in order of cap/weight, the level of the rest follows from running
    sums, so nothing is iterated. The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((F.col("rank") - 1) % len(cycle) + 1).cast("int"))
    t = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight)
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", level)
    # the first source, in this order, that the level doesn't overfill sets the level for all that follow
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return t.select("source", "source_size", "rank", "weight", target.alias("target"))


def mix(docs: DataFrame, cycle: Sequence[float] = (1.0, 2.0, 3.0), cap: float = 3.0, schedules: Sequence = SCHEDULES, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, positions; and the columns of ``keep``.

    A source's documents stand in the order of md5(doc_id). It is gone through
    whole as often as its target holds it; then documents are taken from the
    start while at least half of the next one fits. Running sums come in two
    steps, within 4096 blocks of each source and over the blocks' sums, so that
    a source with a third of all rows is spread over many tasks.
    """
    order = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    sized = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), order.alias("__h"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    # a key without nulls, so that the join's and the window's partitions are the same
    sized = sized.withColumn("__block", F.substring("__h", 1, 3)).withColumn("__key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    blocks = sized.groupBy("__key", "__block").agg(F.sum("size").alias("__sum"), F.first("source").alias("source"))
    targets = source_targets(blocks.groupBy("source").agg(F.sum("__sum").alias("source_size")), cycle, cap)
    earlier = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("__offset", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.__key", "o.__block", "o.__offset", "t.source_size", "t.target", "t.rank")
    d = sized.join(offsets, ["__key", "__block"])
    inside = Window.partitionBy("__key", "__block").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__before", F.col("__offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rest = F.col("target") - F.col("__rounds") * F.col("source_size")
    d = d.withColumn("__rounds", rounds)
    d = d.withColumn("copies", F.col("__rounds") + F.when((F.col("size") > 0) & (F.col("__before") + F.col("size") / 2 <= rest), 1).otherwise(0))
    place = lambda c: (c * F.col("source_size") + F.col("__before") + F.col("size") / 2) / F.col("target")

    def progress(c: Column) -> Column:
        out = inverse_demand(place(c), schedules[-1])
        for i, knots in enumerate(schedules[:-1]):
            out = F.when((F.col("rank") - 1) % len(schedules) == i, inverse_demand(place(c), knots)).otherwise(out)
        return out

    # one expression for all places: written out for each, the step's code is too long for Spark to compile
    positions = F.transform(F.slice(F.array(*[F.lit(c) for c in range(int(cap) + 1)]), 1, F.col("copies")), progress)
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"), *[F.col(f"__keep_{c}").alias(c) for c in keep if c not in ("doc_id", "source")])


def training_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """One row for each time a document is taken, range-sorted by its position in training."""
    return by_position(mixed.withColumn("position", F.explode("positions")).drop("positions"), partitions)


def by_position(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartitionByRange(partitions, "position", "doc_id").sortWithinPartitions("position", "doc_id")
