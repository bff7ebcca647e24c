"""Embedding near-dedup: iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample (``SAMPLE`` vectors in the order of a
hash of their ids) so that signs of the rotated, centred vectors lose little;
the means are taken out, which balances the bits. The codes of several
independent starts, end to end, are cut into substrings, each the key of a
table. How wide and how many they are is sized on the sample: beside its vectors
partners are planted at just the cosine asked for, in random directions and
towards other vectors, and tables are added until no more than ``MISS`` of
either kind never meet, with narrower substrings where that cannot be had (at
width 0 all vectors meet). Whoever meets is first compared by all bits of the
codes, with a limit above the most that planted pairs differ in; vectors travel
only to places where they have somebody within it, and are compared there in
double precision.

Equal vectors are compared once. Tables' buckets that one vector has to itself
are dropped before any vector travels; a large bucket is cut into blocks and
each pair of blocks is a piece of work, so no task holds an unbounded group. A
pair counts in the first table where it meets, hence once. Pairs are counted
where they meet and never become rows.

Defined results: vectors that are null, zero, or hold null or non-finite
components, or whose length isn't the sample's most common one, link with
nothing but keep their row (component: own id); a null id links with nothing,
its component is null; equal rows are separate vectors that link with each
other; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import column
from .components import components
from .repeats import first_of
from .tables import cut

SAMPLE, BLOCK, BITS, ROUNDS = 20_000, 2048, 64, 25
#: Share of pairs at just the threshold that may never meet; vectors that a bucket is to have; bits of a code at least; tables at most.
MISS, BUCKET, LEAST_BITS, MOST_TABLES = 1e-3, 256, 192, 512
CLEAN = "vec_id long, vec binary, same binary"


def clean(vectors: DataFrame) -> DataFrame:
    """``CLEAN``: vec is null where the vector cannot link, else its components as doubles."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "v")
            vecs = [None if x is None else x.astype("<f8").tobytes() for x in lists.to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array(vecs, pa.binary())], ["vec_id", "vec"])

    packed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, v).alias("v")).mapInArrow(pack, "vec_id long, vec binary")
    return packed.withColumn("same", F.unhex(F.md5("vec")))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@dataclass
class Quantiser:
    size: int  # bytes of a vector
    mean: np.ndarray
    axes: np.ndarray  # (length, bits of all codes)
    width: int
    tables: int
    limit: int  # bits in which codes of near vectors may differ

    def bits(self, x: np.ndarray) -> np.ndarray:
        """Rows of unit vectors -> the bits of their codes."""
        return (x - self.mean) @ self.axes >= 0

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """Key of each row in each table."""
        return substrings(bits, self.width, self.tables)


def substrings(bits: np.ndarray, width: int, tables: int) -> np.ndarray:
    weights = (1 << np.arange(width)).astype(np.int64)
    return bits[:, : tables * width].reshape(len(bits), tables, width) @ weights


def planted(x: np.ndarray, cosine: float) -> list[np.ndarray]:
    """Partners of unit vectors at ``cosine``: in random directions, and towards other vectors of ``x``."""
    rng, out = np.random.default_rng(11), []
    for u in (rng.normal(size=x.shape), x[rng.permutation(len(x))]):
        u = u - np.einsum("ij,ij->i", u, x)[:, None] * x
        far = np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]
        y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * u / np.maximum(far, 1e-12)
        out.append(np.where(far > 1e-6, y, x))
    return out


def rotations(y: np.ndarray, codes: range) -> np.ndarray:
    """Iterative quantisation of the rows, once for each code."""
    bits, out = y.shape[1], []
    for seed in codes:
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ v).T
        out.append(r)
    return np.concatenate(out, axis=1)


def quantiser(sample: list[bytes], n: int, cosine: float) -> Quantiser:
    """Codes from the sample, and tables of them for ``n`` vectors and pairs of at least ``cosine``."""
    sizes = Counter(map(len, sample))
    if not sizes:
        return Quantiser(0, np.zeros(0), np.zeros((0, 0)), 0, 1, 0)
    size = max(sizes, key=lambda k: (sizes[k], k))
    x = unit(np.frombuffer(b"".join(v for v in sample if len(v) == size), "<f8").reshape(-1, size // 8))
    pairs = planted(x, cosine)
    mean = x.mean(axis=0)
    d = x.shape[1]
    axes = np.linalg.eigh((x - mean).T @ (x - mean))[1][:, ::-1][:, : min(BITS, d)]
    y = (x - mean) @ axes
    same = 1 - np.arccos(min(max(cosine, -1.0), 1.0)) / np.pi
    made = np.zeros((y.shape[1], 0))
    for width in range(min(30, max(0, round(np.log2(max(n, 1) / BUCKET)))), -1, -1):
        meet = same**width
        ideal = 1 if meet >= 1 - MISS else int(np.ceil(np.log(MISS) / np.log1p(-meet)))
        # half as many again, for data that bits lose more of
        most = min(MOST_TABLES, ideal + ideal // 2 + 1)
        codes = -(-max(LEAST_BITS, most * width) // y.shape[1])
        had = made.shape[1] // y.shape[1]
        if codes > had:
            made = np.concatenate([made, rotations(y, range(had, codes))], axis=1)
        all_axes = axes @ made
        own = (x - mean) @ all_axes >= 0
        others = [(z - mean) @ all_axes >= 0 for z in pairs]
        k = substrings(own, width, most)
        missed = np.stack([1 - np.maximum.accumulate(substrings(o, width, most) == k, axis=1).mean(axis=0) for o in others]).max(axis=0)
        enough = np.flatnonzero(missed <= MISS)
        if len(enough):
            tables = int(enough[0]) + 1
            used = y.shape[1] * -(-max(LEAST_BITS, tables * width) // y.shape[1])
            apart = [(o[:, :used] != own[:, :used]).sum(axis=1) for o in others]
            limit = max(int(np.ceil(max(a.max(), a.mean() + 6 * max(a.std(), 1)))) for a in apart)
            return Quantiser(size, mean, all_axes[:, :used], width, tables, limit)
    raise AssertionError("at width 0 all vectors meet")


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    vecs = column(batch, "vec")
    data = b"".join(v.as_buffer() for v in vecs)
    return column(batch, "vec_id").to_numpy(zero_copy_only=False), np.frombuffer(data, "<f8").reshape(len(vecs), -1)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def pieces(key: np.ndarray, i: np.ndarray, j: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(begin, end, split) of each sorted piece of work with company; split: rows of block i, 0 where i and j are one."""
    begin, _ = first_of(key, i, j)
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(key)], strict=True):
        across = i[lo] != j[lo]
        split = int(np.searchsorted(own[lo:hi], j[lo])) if across else 0
        if hi - lo > 1 and (0 < split < hi - lo or not across):
            yield lo, hi, split


def near_links(vectors: DataFrame, percent: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector: links are pairs found with cosine >= ``percent``."""
    all_ = cut(clean(vectors))
    classes = all_.where("vec is not null").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = cut(classes)
    sample = [bytes(r[0]) for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").collect()]
    q = quantiser(sample, classes.count(), percent)
    model = classes.sparkSession.sparkContext.broadcast(q)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, x = rows_of(batch)
                codes = np.packbits(model.value.bits(unit(x)), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "code"])

    def packed(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(c.as_buffer() for c in column(batch, "code")), np.uint8).reshape(batch.num_rows, -1)

    def keys(codes: np.ndarray) -> np.ndarray:
        q = model.value
        return q.keys(np.unpackbits(codes, axis=1, count=q.axes.shape[1]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k = keys(packed(batch))
                ids = column(batch, "vec_id").to_numpy(zero_copy_only=False)
                table = np.tile(np.arange(k.shape[1], dtype=np.int64), len(k))
                yield pa.RecordBatch.from_arrays([pa.array(table << 40 | k.reshape(-1)), pa.array(np.repeat(ids, k.shape[1]))], ["key", "vec_id"])

    usable = classes.where(F.octet_length("vec") == q.size).select(F.col("rep").alias("vec_id"), "copies", "vec")
    coded = cut(usable.select("vec_id", "vec").mapInArrow(encode, "vec_id long, code binary"))
    cells = cut(coded.mapInArrow(index, "key long, vec_id long"))
    shared = cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    placed = cells.join(shared, "key").join(coded, "vec_id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own"), "vec_id", "code").repartition("key", "i", "j")

    def company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks().to_batches()[0]
        ids, key, i, j, own = (column(t, c).to_numpy(zero_copy_only=False) for c in ("vec_id", "key", "i", "j", "own"))
        order = np.lexsort((ids, own, j, i, key))
        ids, key, i, j, own, codes = (a[order] for a in (ids, key, i, j, own, packed(t)))
        words = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)
        kept = np.zeros(len(ids), bool)
        for lo, hi, split in pieces(key, i, j, own):
            k, to = keys(codes[lo:hi])[:, : key[lo] >> 40], lo + split if split else hi
            for at in range(lo, to, 256):
                mine, start = slice(at, min(at + 256, to)), lo + split if split else at
                apart = sum(np.bitwise_count(words[mine, None, c] ^ words[None, start:hi, c]).astype(np.uint16) for c in range(words.shape[1]))
                a, b = np.nonzero(apart <= model.value.limit)
                a, b = a + at, b + start
                a, b = a[a != b], b[a != b]
                for part in range(0, len(a), 1 << 16):
                    p, r = a[part : part + (1 << 16)], b[part : part + (1 << 16)]
                    new = ~(k[p - lo] == k[r - lo]).any(axis=1)
                    kept[p[new]] = kept[r[new]] = True
        yield pa.RecordBatch.from_arrays([pa.array(a[kept]) for a in (key, i, j, own, ids)], ["key", "i", "j", "own", "vec_id"])

    met_by_code = cut(placed.mapInArrow(company, "key long, i int, j int, own int, vec_id long"))
    work = met_by_code.join(usable.join(coded, "vec_id"), "vec_id").repartition("key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks().to_batches()[0]
        ids, x = rows_of(t)
        x = unit(x)
        key, i, j, own, copies = (column(t, c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "own", "copies"))
        order = np.lexsort((ids, own, j, i, key))
        ids, key, i, j, own, copies, codes = (a[order] for a in (ids, key, i, j, own, copies, packed(t)))
        for lo, hi, split in pieces(key, i, j, own):
            v = x[order[lo:hi]]
            s = v[:split] @ v[split:].T if split else np.triu(v @ v.T, 1)
            a, b = np.nonzero(s >= percent)
            b = b + split
            if not len(a):
                continue
            k = keys(codes[lo:hi])[:, : key[lo] >> 40]
            first = ~(k[a] == k[b]).any(axis=1)
            a, b = a[first], b[first]
            if not len(a):
                continue
            n, c = hi - lo, copies[lo:hi]
            count = np.bincount(a, c[b], n) + np.bincount(b, c[a], n)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][some]), pa.array(count[some].astype(np.int64)), pa.array(ids[lo:hi][roots(n, a, b)[some]])], ["vec_id", "links", "root"])

    met = cut(work.mapInArrow(compare, "vec_id long, links long, root long"))
    counts = met.groupBy("vec_id").agg(F.sum("links").alias("links"))
    linked = components(met.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).distinct())
    of = classes.join(counts, classes.rep == counts.vec_id, "left").join(linked, classes.rep == linked.id, "left").select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = all_.where("vec is not null").join(of, "same").select("vec_id", "n_links", "component_id")
    out = out.unionByName(all_.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
