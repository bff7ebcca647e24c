"""Order statistics without a sort: the n-th value by counts of its leading bits, pass by pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.functions.columns import hash_order

#: Bits of a hash that are used, and bits that a pass decides.
BITS, STEP = 60, 12


def hash60(seed: int | Column, key: Column) -> Column:
    """The first 60 bits of ``hash_order``, which is their order too."""
    return F.conv(F.substring(hash_order(seed, key), 1, BITS // 4), 16, 10).cast("long")


def trial_hashes(trials: int, key: Column) -> Column:
    """An array of a row's hashes, one a trial."""
    return F.transform(F.sequence(F.lit(0), F.lit(trials - 1)), lambda t: hash60(t.cast("string"), key))


def thresholds(df: DataFrame, values: Column, wanted: Sequence[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(least v, how many of the equal ones belong to it) so that ``rank`` rows are below v or among these, for each (place, rank) wanted.

    ``values`` is an array of numbers of 60 bits; a place is an index in it.
    Each pass counts the values that share the leading bits found so far by
    their next 12 bits, adds the counts up over tasks, and keeps the one bucket
    that holds the rank: 4,096 counts for each wanted come to the driver. Passes
    end when all of a bucket, or none, is wanted. A rank of 0 or less gives -1.
    """
    place, rest = np.array([w[0] for w in wanted], np.int64), np.array([w[1] for w in wanted], np.int64)
    found, low, done = np.full(len(wanted), -1, np.int64), np.zeros(len(wanted), np.int64), rest <= 0
    rows = df.select(values.alias("v"))
    for shift in range(BITS - STEP, -1, -STEP):
        open_ = np.flatnonzero(~done)
        if not len(open_):
            break
        shared = df.sparkSession.sparkContext.broadcast((place[open_], low[open_]))

        def count(batches: Iterator[pa.RecordBatch], shift: int = shift, shared=shared) -> Iterator[pa.RecordBatch]:
            at, prefix = shared.value
            total = np.zeros(len(at) << STEP, np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for k, p in enumerate(at):
                    own = v[:, p] >> shift
                    own = own[own >> STEP == prefix[k]] & ((1 << STEP) - 1)
                    total[k << STEP : k + 1 << STEP] += np.bincount(own, minlength=1 << STEP)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

        counts = np.zeros((len(open_), 1 << STEP), np.int64)
        for r in rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            counts[divmod(r["cell"], 1 << STEP)] = r["n"]
        below = np.cumsum(counts, axis=1)
        for k, w in enumerate(open_):
            bucket = min(int(np.searchsorted(below[k], rest[w])), (1 << STEP) - 1)
            rest[w] -= below[k][bucket] - counts[k][bucket]
            low[w] = (low[w] << STEP) + bucket
            # the whole bucket: its last value will do
            if counts[k][bucket] <= rest[w]:
                found[w], done[w] = ((low[w] + 1) << shift) - 1, True
    found[~done] = low[~done]
    return found, np.where(done, np.iinfo(np.int64).max, rest)


def random_sample(df: DataFrame, ident: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), the same in each run: those of the least md5(seed:id), by a plain filter.

    Of rows that share an id only as many as are still wanted are taken.
    """
    h = hash60(seed, F.col(ident))
    (last,), (equal,) = thresholds(df, F.array(h), [(0, n)])
    if equal == np.iinfo(np.int64).max:
        return df.where(h <= int(last))
    return df.where(h < int(last)).unionByName(df.where(h == int(last)).limit(int(equal)))
