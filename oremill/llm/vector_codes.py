"""Vector code compression: integer product codes, learned and assigned by equal-average search.

A vector's components become integers, floor(``SCALE`` * x), and are cut into
consecutive parts; part p has the components from floor(p * d / parts) to
floor((p + 1) * d / parts), which are equal where ``parts`` divides the length
d. Each position has a codebook of ``entries`` integer vectors, from the least
ids' parts at first. A round assigns every part to its nearest entry and moves
the entry to the floor of its parts' mean.

The nearest entry is searched among entries sorted by their component sum,
outward from the part's own sum. By Cauchy and Schwarz a squared distance is at
least the squared gap of the sums over the dimension, so a side is done when
that bound exceeds the best distance; at equality the search goes on, as an
entry of a lower number may be as near.

Each round is one scan; tasks return counts and sums of their parts by entry,
which Spark adds up, so the driver holds ``parts * entries`` small vectors
whatever the number of rows.

Defined results: rows whose vector is null or holds null or non-finite
components are dropped, and so are those of another length than most of the
starting rows have (the longer of equally frequent ones); of equal ids the
lesser vector starts first, null ids come last; repeated rows count and are
coded each; integers beyond +-2^30 / max(part length, sqrt(d)) are cut to that,
so that 64 bits hold all distances; an empty table gives an empty one and empty
codebooks; columns that are not asked for are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import column
from .tables import cut, labelled

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2


@dataclass
class Codebooks:
    bounds: list[int]  # part p has components bounds[p]:bounds[p + 1]
    entries: list[np.ndarray]  # of each part: (entries, part length), int64

    @property
    def size(self) -> int:
        return self.bounds[-1]

    def integers(self, x: np.ndarray) -> np.ndarray:
        most = (1 << 30) // max(1, max(np.diff(self.bounds), default=1), math.isqrt(self.size) + 1)
        return np.clip(np.floor(x * SCALE), -most, most).astype(np.int64)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row, the lowest index of equals."""
    n, k = x.shape
    at, best = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max // max(k, 1))
    if not k:
        return at, np.zeros(n, np.int64)
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    # a stop at both ends
    far = np.iinfo(np.int64).max
    sums, entries, own = sums[order], entries[order], x.sum(axis=1)
    high = np.searchsorted(sums, own)
    low, live = high - 1, np.arange(n)
    while len(live):
        lo, hi, mid = low[live], high[live], own[live]
        below = np.where(lo >= 0, mid - sums[np.maximum(lo, 0)], far)
        above = np.where(hi < len(sums), sums[np.minimum(hi, len(sums) - 1)] - mid, far)
        gap = np.minimum(below, above)
        on = gap < far
        on[on] = gap[on] * gap[on] <= k * best[live[on]]
        live, down = live[on], (below <= above)[on]
        tried = np.where(down, lo[on], hi[on])
        apart = x[live] - entries[tried]
        d2, index = np.einsum("ij,ij->i", apart, apart), order[tried]
        better = (d2 < best[live]) | ((d2 == best[live]) & (index < at[live]))
        best[live[better]], at[live[better]] = d2[better], index[better]
        low[live[down]] -= 1
        high[live[~down]] += 1
    return at, best


def finite(vector: str) -> tuple[Column, Column]:
    """The vector as doubles, and whether it is usable."""
    v = F.col(vector).cast("array<double>")
    return v, v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def matrix(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    return column(batch, name).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(batch.num_rows, size)


def usable(vectors: DataFrame, vector: str, size: int, keep: Sequence[str] = ()) -> DataFrame:
    v, ok = finite(vector)
    return vectors.where(ok & (F.size(v) == size)).select(*keep, v.alias("__v"))


def started(vectors: DataFrame, vec_id: str, vector: str, parts: int, entries: int) -> Codebooks:
    """Codebooks from the parts of the least ids' vectors."""
    v, ok = finite(vector)
    good = vectors.where(ok).select(F.col(vec_id).alias("id"), v.alias("v"))

    def least(rows: DataFrame) -> list[list[float]]:
        return [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]

    first = least(good)
    lengths = Counter(map(len, first))
    size = max(lengths, key=lambda n: (lengths[n], n)) if lengths else 0
    if len(lengths) > 1:
        first = least(good.where(F.size("v") == size))
    books = Codebooks([p * size // parts for p in range(parts + 1)], [])
    x = books.integers(np.array(first, float).reshape(len(first), size))
    books.entries = [x[:, a:b] for a, b in zip(books.bounds, books.bounds[1:], strict=False)]
    return books


def refined(vectors: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """One round: entries become the floor of their parts' mean, unused ones stay."""
    shared, width = vectors.sparkSession.sparkContext.broadcast(books), max(np.diff(books.bounds))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        total = [np.zeros((len(e), width + 1), np.int64) for e in b.entries]
        for batch in batches:
            x = b.integers(matrix(batch, "__v", b.size))
            for p, e in enumerate(b.entries):
                part = x[:, b.bounds[p] : b.bounds[p + 1]]
                at = nearest(part, e)[0]
                total[p][:, 0] += np.bincount(at, minlength=len(e))
                for j in range(part.shape[1]):
                    # a batch's sums are below 2^53, so doubles hold them
                    total[p][:, 1 + j] += np.bincount(at, part[:, j], len(e)).astype(np.int64)
        for p, t in enumerate(total):
            used = np.flatnonzero(t[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(list(t[used]), pa.list_(pa.int64()))], ["part", "entry", "s"])

    partial = usable(vectors, vector, books.size).mapInArrow(sums, "part int, entry int, s array<long>")
    new = [e.copy() for e in books.entries]
    for r in partial.groupBy("part", "entry").agg(F.array(*[F.sum(F.col("s")[j]) for j in range(width + 1)]).alias("s")).collect():  # a row an entry
        own = new[r["part"]].shape[1]
        new[r["part"]][r["entry"]] = np.array(r["s"][1 : own + 1], np.int64) // r["s"][0]
    return Codebooks(books.bounds, new)


def learn(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    if entries > 256:
        raise ValueError("a code is a byte a part: at most 256 entries")
    books = started(vectors, vec_id, vector, parts, entries)
    for _ in range(rounds if len(books.entries[0]) else 0):
        books = refined(vectors, vector, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding", keep: Sequence[str] = ("vec_id",)) -> DataFrame:
    """keep.., code (a byte a part), error (squared distance to the coded vector, as integers)."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    rows = usable(vectors, vector, books.size, keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = b.integers(matrix(batch, "__v", b.size))
            found = [nearest(x[:, lo:hi], e) for lo, hi, e in zip(b.bounds, b.bounds[1:], b.entries, strict=False)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = np.sum([f[1] for f in found], axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], [*batch.schema.names[:-1], "code", "error"])

    kind = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(work, ", ".join([*([kind] if kind else []), "code binary, error long"]))


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """Adds decoded: the vector that the code stands for."""
    tables = F.array(*[F.array(*[F.array(*[F.lit(v / SCALE) for v in row]) for row in e.tolist()]) for e in books.entries])
    parts = F.transform(F.sequence(F.lit(0), F.lit(len(books.entries) - 1)), lambda p: F.get(F.get("__t", p), F.conv(F.hex(F.col("code").substr(p + 1, F.lit(1))), 16, 10).cast("int")))
    return coded.withColumn("__t", tables).withColumn("decoded", F.flatten(parts)).drop("__t")


def with_group_error(coded: DataFrame, group: str = "label") -> DataFrame:
    """Adds <group>_error: the error summed over rows of an equal ``group``, nulls together. Frequent groups' sums are broadcast, so none meets in one task."""
    kept = cut(coded.withColumns({"__none": F.col(group).isNull(), "__of": F.coalesce(F.col(group).cast("string"), F.lit(""))}))
    sums = kept.groupBy("__none", "__of").agg(F.sum("error").alias(f"{group}_error"), F.count("*").alias("__n"))
    return labelled(kept, ["__none", "__of"], sums, "__n", kept.count()).drop("__none", "__of", "__n")
