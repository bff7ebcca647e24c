"""Which fixed-width windows of units (words, bytes) also start earlier in the corpus.

Shared by substring and suffix-array dedup. Windows get bucket identifiers by
doubling: the identifier of 2n units is that of the pair of identifiers at i and
i + n, 64-bit values that every task computes alike, so sorting on them needs no
global ranks. Not every offset travels:

1. Each window is assigned to the least q-gram inside it (leftmost of equals);
   a run of windows with the same q-gram is one record: the q-gram's identifier,
   the identifier of the run's whole context, document, start, length. Equal
   windows have equal q-grams at equal offsets, so they meet in a q-gram bucket.
2. Records are dealt by q-gram and sorted. A q-gram seen once is done. Of records
   with equal contexts all but the first are repeats. The first of each context,
   where a q-gram has several, is left over.
3. Left-over runs are cut into pieces at fixed distances from their q-gram (for
   wide windows) and step 2 is used again on the pieces, with the longer string
   that all windows of a piece share in place of the q-gram.
4. Only windows of what is still left over are looked at one by one: dealt by
   their full identifier, all but the first of equal ones are repeats.

No bucket's rows have to meet in Python lists of pairs; a bucket's work is a
sort, so its cost does not grow with the square of a group. Records travel as
packed arrays, some thousand to a row. "Earlier" means smaller (doc_id, text
hash), then smaller start; places that are equal in all of these are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import SLICE, column, pair, slices, spread
from .tables import Sieve, cut, fanout, places, sieve

#: Windows looked at together, whose identifiers take some dozen arrays of 8 bytes each; what is longer goes in overlapping blocks.
BLOCK = 1 << 18
POSITION = np.uint64((1 << 24) - 1)


def levels(units: np.ndarray, *sizes: int) -> dict[int, np.ndarray]:
    """Bucket identifiers of the powers of two that ``identifiers`` of these sizes are made from."""
    needed, h, n, out = {1 << (s.bit_length() - 1) for s in sizes}, units, 1, {}
    while True:
        if n in needed:
            out[n] = h
        if 2 * n > max(needed):
            return out
        h = pair(h[: max(0, len(h) - n)], h[n:])
        n *= 2


def identifiers(by_size: dict[int, np.ndarray], size: int, count: int) -> np.ndarray:
    """Bucket identifiers of the windows of ``size`` at each of the first ``count`` offsets."""
    p = 1 << (size.bit_length() - 1)
    h = by_size[p]
    return h[:count] if p == size else pair(h[:count], h[size - p : size - p + count])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n, m = 1, a
    while 2 * n <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return m if n == width else np.minimum(m[: len(a) - width + 1], m[width - n :])


def windows(units: np.ndarray, first: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(offset, units, start offsets of whole windows, document of each) by blocks of a slice."""
    at = 0
    last = len(units) - width + 1
    while at < last:
        n = min(BLOCK, last - at)
        doc = np.searchsorted(first, np.arange(at, at + n), side="right") - 1 if len(first) > 2 else np.zeros(n, int)
        fits = np.flatnonzero(first[doc + 1] - np.arange(at, at + n) >= width)
        yield at, units[at : at + n + width - 1], fits, doc[fits]
        at += n


def runs(units: np.ndarray, first: np.ndarray, width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(q-gram, context, document, start in the document, windows, units before the q-gram) of each run."""
    for at, u, fits, doc in windows(units, first, width):
        if not len(fits):
            continue
        n = len(u) - width + 1
        by_size = levels(u, gram, width)
        grams = identifiers(by_size, gram, len(u) - gram + 1)
        whole = identifiers(by_size, width, n)
        key = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
        chosen = (sliding_min(key, width - gram + 1) & POSITION)[fits].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (fits[1:] != fits[:-1] + 1) | (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])]))
        count = np.diff(np.append(new, len(fits)))
        a, p = fits[new], chosen[new]
        shape = ((p - a) << 16 | count).astype(np.uint64)
        context = pair(pair(whole[a], whole[a + count - 1]), spread(shape))
        yield grams[p], context, doc[new], a + at - first[doc[new]], count, p - a


def deal(bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows of a bucket number and the packed columns of its records."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(edges)).tolist():
        lo, hi = edges[b], edges[b + 1]
        yield b, (hi - lo).tobytes() + b"".join(c[lo:hi].tobytes() for c in columns)


def gather(batches: Iterator[pa.RecordBatch], kinds: list[str]) -> list[np.ndarray]:
    """All records of a partition's packed rows, column by column."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for batch in batches:
        for cell in column(batch, "packed"):
            raw = memoryview(cell.as_buffer())
            n, at = int.from_bytes(raw[:8], "little"), 8
            for part, kind in zip(parts, kinds, strict=True):
                size = np.dtype(kind).itemsize
                part.append(np.frombuffer(raw, kind, n, at))
                at += n * size
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True)]


PACKED = "bucket int, packed binary"
KINDS = ["<u8", "<u8", "<i8", "<i8", "<u4", "<u2", "<u2"]


def packed_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "packed"])


LISTS = "doc_id long, row long, start array<int>, n array<int>, src array<long>, src_row array<long>, src_start array<int>, lead array<int>, open array<boolean>"


def by_document(doc, row, start, n, src, src_row, src_start, lead, left) -> pa.RecordBatch:
    """One row per document with lists of its runs of windows."""
    order = np.lexsort((start, row, doc))
    doc, row = doc[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])) if len(doc) else np.zeros(0, int)
    off = pa.array(np.append(new, len(doc)), pa.int32())
    lists = [pa.ListArray.from_arrays(off, pa.array(v[order].astype(k))) for v, k in ((start, np.int32), (n, np.int32), (src, np.int64), (src_row, np.int64), (src_start, np.int32), (lead, np.int32), (left, bool))]
    return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(row[new]), *lists], [f.split()[0] for f in LISTS.split(", ")])


def first_of(*same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: where a group starts, and the group of each record."""
    new = np.zeros(len(same[0]), bool)
    new[:1] = True
    for k in same:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def later(starts, group, doc, row, start) -> np.ndarray:
    """Records whose place isn't that of their group's first."""
    f = starts[group]
    return (doc != doc[f]) | (row != row[f]) | (start != start[f])


def sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records = gather(batches, KINDS)
    order = np.argsort(records[0], kind="stable")
    g = records[0][order]
    again = np.zeros(len(g), bool)
    again[1:] = g[1:] == g[:-1]
    again[:-1] |= again[1:]
    gram, context, doc, row, start, n, lead = (x[order[again]] for x in records)
    order = np.lexsort((start, row, doc, context, gram))
    gram, context, doc, row, start, n, lead = (x[order] for x in (gram, context, doc, row, start, n, lead))
    if not len(gram):
        return
    f, of = first_of(gram, context)
    repeat = later(f, of, doc, row, start)
    g, of_gram = first_of(gram)
    several = np.bincount(of_gram[f], minlength=len(g)) > 1
    left = ~repeat & several[of_gram]
    take = np.flatnonzero(repeat | left)
    s = f[of[take]]
    yield by_document(doc[take], row[take], start[take], n[take], doc[s], row[s], start[s], lead[take], left[take])


def sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole, doc, row, start = gather(batches, [KINDS[0], *KINDS[2:5]])
    order = np.lexsort((start, row, doc, whole))
    whole, doc, row, start = (x[order] for x in (whole, doc, row, start))
    if not len(whole):
        return
    f, of = first_of(whole)
    take = np.flatnonzero(later(f, of, doc, row, start))
    s = f[of[take]]
    yield by_document(doc[take], row[take], start[take], np.ones(len(take), int), doc[s], row[s], start[s], np.zeros(len(take), int), np.zeros(len(take), bool))


Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


KEYED = "doc_id long, row long, text string"


class Keyed:
    """Texts as ``KEYED``: row tells texts of one doc_id apart, by 64 bits of their hash; it is 0 for ids that only one row has.

    Which ids several rows have is told by a sieve; a row that passes it for
    nothing has a hash and no other row of its id. Rows with a null doc_id are
    left out. The sieves are looked at in the task that does the work on the
    texts, so a task has one Python worker and texts go to it once.
    """

    def __init__(self, docs: DataFrame):
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
        self.several = sieve(cut(own.groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id")))
        self.plain = own.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("row"), "text")

    def through(self, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, kept: Sieve | None = None, inside: bool = True) -> DataFrame:
        """``work`` on all texts; or on those whose doc_id passes ``kept``, as all that are in it do, and a few others; or, not ``inside``, on the rest."""
        context = self.plain.sparkSession.sparkContext
        several, wanted = context.broadcast(self.several), context.broadcast(kept)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, row, text, *at = batch.columns
                at = [a.to_numpy(zero_copy_only=False) for a in at]
                row = np.where(several.value.passes(at[0]) & several.value.passes(at[1]), row.to_numpy(zero_copy_only=False), 0)
                out = pa.RecordBatch.from_arrays([doc, pa.array(row), text], [f.split()[0] for f in KEYED.split(", ")])
                if len(at) > 2:
                    out = out.filter(pa.array((wanted.value.passes(at[2]) & wanted.value.passes(at[3])) == inside))
                yield out

        at = [at for s in (self.several, kept) if s for at in places("doc_id", s.log)]
        return self.plain.select("*", *[x.alias(f"__at{k}") for k, x in enumerate(at)]).mapInArrow(lambda batches: work(rows(batches)), schema)

    def rows(self, kept: Sieve | None = None) -> DataFrame:
        return self.through(lambda batches: batches, KEYED, kept)


def ids(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return column(rows, "doc_id").to_numpy(zero_copy_only=False).astype(np.int64), column(rows, "row").to_numpy(zero_copy_only=False).astype(np.int64)


class Open:
    """The left-over runs of a slice's rows, by position of their first window in the slice."""

    def __init__(self, rows: pa.RecordBatch, first: np.ndarray):
        lists = column(rows, "z")
        flat, per = lists.flatten(), np.diff(lists.offsets.to_numpy())
        self.start, self.n, self.lead = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        self.d = np.repeat(np.arange(len(per)), per)
        self.at = first[self.d] + self.start

    def spread_out(self, piece: int) -> None:
        """Cuts runs into pieces of windows whose distance to the q-gram has one quotient by ``piece``."""
        low = (self.lead - self.n + 1) // piece
        count = self.lead // piece - low + 1
        part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        d, start, n, lead, at = (np.repeat(x, count) for x in (self.d, self.start, self.n, self.lead, self.at))
        # windows of a piece have leads piece*q .. piece*q+piece-1; the first piece has the largest q
        q = np.repeat(self.lead // piece, count) - part
        skip = np.maximum(lead - (piece * q + piece - 1), 0)
        stop = np.minimum(lead - piece * q + 1, n)
        self.d, self.start, self.at, self.lead, self.n, self.shared = d, start + skip, at + skip, lead - skip, stop - skip, at + lead - piece * q

    def blocks(self, size: int) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(self.at, kind="stable")
        at, lo = self.at[order], 0
        while lo < len(at):
            hi = np.searchsorted(at, at[lo] + size)
            yield at[lo], order[lo:hi]
            lo = hi


def repeated_runs(docs: DataFrame, units: Units, width: int, gram: int, piece: int = 0, at_once: int = SLICE) -> tuple[Keyed, DataFrame]:
    """(texts, found): the texts with their keys, and ``LISTS`` of the runs of windows that also start earlier, and where.

    ``units`` makes hashes and the first unit of each row from a slice's bytes
    and offsets; slices have ``at_once`` bytes. Rows with a null doc_id or text have none. In ``found`` runs
    that are ``open`` are no results.
    """
    parts = fanout(docs, 1.5)
    buckets = 1 << max(8, (parts - 1).bit_length())
    own = Keyed(docs)

    def dealt(blocks):
        """The records of a slice's blocks, dealt together."""
        if blocks:
            first, *rest = (np.concatenate(x) for x in zip(*blocks, strict=True))
            yield packed_batch(list(deal((first & np.uint64(buckets - 1)).astype(np.int64), buckets, first, *rest)))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, limit=at_once):
                doc, row = ids(rows)
                yield from dealt([(grams, context, doc[d], row[d], start.astype("<u4"), n.astype("<u2"), lead.astype("<u2")) for grams, context, d, start, n, lead in runs(*units(data, off), width, gram)])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, limit=at_once):
                doc, row = ids(rows)
                u, first = units(data, off)
                o = Open(rows, first)
                o.spread_out(piece)
                blocks = []
                for base, k in o.blocks(BLOCK):
                    part = u[base : base + BLOCK + 2 * width]
                    by_size = levels(part, width, width - piece + 1)
                    whole = identifiers(by_size, width, len(part) - width + 1)
                    shared = identifiers(by_size, width - piece + 1, len(part) - width + piece)
                    a = o.at[k] - base
                    shape = ((o.shared[k] - o.at[k]) << 16 | o.n[k]).astype(np.uint64)
                    context = pair(pair(whole[a], whole[a + o.n[k] - 1]), spread(shape))
                    blocks.append((shared[o.shared[k] - base], context, doc[o.d[k]], row[o.d[k]], o.start[k].astype("<u4"), o.n[k].astype("<u2"), o.lead[k].astype("<u2")))
                yield from dealt(blocks)

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, limit=at_once):
                doc, row = ids(rows)
                u, first = units(data, off)
                o = Open(rows, first)
                o.spread_out(1)
                blocks = []
                for base, k in o.blocks(BLOCK):
                    part = u[base : base + BLOCK + width - 1]
                    whole = identifiers(levels(part, width), width, len(part) - width + 1)
                    blocks.append((whole[o.at[k] - base], doc[o.d[k]], row[o.d[k]], o.start[k].astype("<u4")))
                yield from dealt(blocks)

    def left_over(lists: DataFrame) -> DataFrame:
        """Texts that have left-over runs, with these; only such texts travel."""
        left = lists.where("exists(open, x -> x)").select("doc_id", "row", F.filter(F.arrays_zip("start", "n", "lead", "open"), lambda z: z["open"]).alias("z"))
        left = cut(left.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("z")).alias("z")))
        texts = own.rows(sieve(left.select(F.col("doc_id").alias("id"))))
        return texts.join(left.hint("shuffle_hash"), ["doc_id", "row"])

    found = cut(own.through(records, PACKED).repartition(parts, "bucket").mapInArrow(sort_contexts, LISTS))
    last, out = found, found.where("exists(open, x -> not x)")
    if piece:
        last = cut(left_over(found).mapInArrow(pieces, PACKED).repartition(parts, "bucket").mapInArrow(sort_contexts, LISTS))
        out = out.unionByName(last.where("exists(open, x -> not x)"))
    fine = cut(left_over(last).mapInArrow(singles, PACKED).repartition(parts, "bucket").mapInArrow(sort_windows, LISTS))
    return own, out.unionByName(fine)


def covered(first: np.ndarray, d: np.ndarray, start: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Units of a slice that lie in any window of the runs."""
    edge = np.zeros(first[-1] + 1, np.int32)
    at = first[d] + start
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n + width - 1, -1)
    return np.cumsum(edge)[:-1] > 0
