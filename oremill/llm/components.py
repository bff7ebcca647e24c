"""Connected components of links: smallest id reachable, by hooking and jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import HOT, cut, drop, labelled

#: Links up to which one task ends it (4 MB of ids).
SMALL = 1 << 18


def busy(rows: DataFrame, key: str, total: int) -> list[int]:
    """The keys of more than 1/HOT of the ``total`` rows, fewer than HOT."""
    return [r[0] for r in rows.groupBy(key).count().where(F.col("count") * HOT > total).select(key).collect()]


def looked_up(rows: DataFrame, key: str, labels: DataFrame, often: list[int]) -> DataFrame:
    """``rows`` with ``<key>_c``, the ``c`` of their key in ``labels`` (id, c) or null; of the keys ``often``, which are few, by broadcast."""
    found = labels.select(F.col("id").alias("__of"), F.col("c").alias(f"{key}_c"))
    out = rows.where(~F.col(key).isin(often)).join(found, F.col(key) == F.col("__of"), "left")
    if often:
        out = out.unionByName(rows.where(F.col(key).isin(often)).join(F.broadcast(found.where(F.col("__of").isin(often))), F.col(key) == F.col("__of"), "left"))
    return out.drop("__of")


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the links (a, b), ascending, and the least end that each reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        # of two roots the larger hooks on the least that it is linked with, then all jump to their root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (above := root[root])).any():
            root = above
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return ids, ids[root]


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b) -> (id, component) of every id that has a link.

    Up to ``small`` links, repeated ones counted, go to one task: rounds over so
    few would cost the driver far more, in plans, tasks and broadcasts. More go
    through rounds. Each takes the least of a node's label, its neighbours'
    labels and the label of its label, so long chains halve. Rounds end when no
    label changes. A round is one step, written to the checkpoint folder; the last
    round's are deleted; only the number of changes and the keys of more than
    1/HOT of the rows come to the driver. These keys are fewer than HOT, so
    their labels are broadcast and what asks for them need not meet in one task.

    Defined results: links of an id with itself and links with a null are none;
    repeated links count once; without links the result is empty.
    """
    given = cut(links.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    total = given.count()
    if not total:
        return given.select(F.col("a").alias("id"), F.col("b").alias("component"))
    if total <= small:

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(list(batches))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(t["a"].to_numpy(), t["b"].to_numpy())], ["id", "component"])

        out = cut(given.coalesce(1).mapInArrow(finish, "id long, component long"))
        drop(given)
        return out
    both = cut(given.unionByName(given.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    drop(given)
    total = both.count()
    asks, hubs = both.select(F.col("a").alias("id"), "b"), busy(both, "b", total)
    labels = cut(asks.groupBy("id").agg(F.min("b").alias("c")).select("id", F.least("id", "c").alias("c"), F.col("id").alias("was")))
    while True:
        shares = labels.groupBy("c").agg(F.count("*").alias("n"), F.count_if(F.col("c") != F.col("was")).alias("changed"))
        state = shares.agg(F.sum("changed").alias("changed"), F.collect_list(F.when(F.col("n") * HOT > total, F.col("c"))).alias("often")).first()
        if not state["changed"]:
            drop(both)
            return labels.select("id", F.col("c").alias("component"))
        near = looked_up(asks, "b", labels, hubs).select("id", F.col("b_c").alias("c"))
        above = looked_up(labels.select("id", F.col("c").alias("up")).where("id != up"), "up", labels, state["often"]).select("id", F.col("up_c").alias("c"))
        heard = near.unionByName(above).withColumn("was", F.lit(None).cast("long"))
        new = cut(labels.select("id", "c", F.col("c").alias("was")).unionByName(heard).groupBy("id").agg(F.min("c").alias("c"), F.max("was").alias("was")))
        drop(labels)
        labels = new


def ends_of(label: DataFrame, links: DataFrame, total: int, small: int = SMALL) -> DataFrame:
    """``links`` (a, b), of which there are ``total``, with the components of both ends in ``label`` as a_c and b_c; up to ``small`` links are joined as they are."""
    mine = label.select("id", F.col("component").alias("c"))
    out = links
    for end in ("a", "b"):
        out = looked_up(out, end, mine, busy(links, end, total) if total > small else [])
    return out


def apart_still(label: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose ends aren't in one component of ``label``; an id without a component is one of its own."""
    kept = ends_of(label, pairs, pairs.count())
    return kept.where(F.coalesce("a_c", "a") != F.coalesce("b_c", "b")).select("a", "b")


def merged(label: DataFrame, links: DataFrame, small: int = SMALL) -> DataFrame:
    """``components`` of the links behind ``label``, which is its result, and of ``links`` (a, b) besides.

    Up to ``small`` rows of both are one call of ``components``. Else only links
    between components of ``label`` are gone through, so rounds are few and
    small. Without links it is ``label`` itself; links with a null are none.
    """
    ends = links.where("a != b").select("a", "b")
    total = ends.count()
    if not total:
        return label
    if total <= small and total + label.count() <= small:
        return components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(ends), small)
    mine = label.select("id", F.col("component").alias("c"))
    ends = ends_of(label, ends, total, small)
    more = components(ends.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")), small)
    sizes = mine.groupBy("c").agg(F.count("*").alias("n"))
    whole = sizes.join(more.select(F.col("id").alias("c"), "component"), "c", "left").select("c", "n", F.coalesce("component", "c").alias("component"))
    old = labelled(mine, ["c"], whole, "n", mine.count()).select("id", "component")
    return cut(old.unionByName(more.join(mine, "id", "left_anti").select("id", "component")))
