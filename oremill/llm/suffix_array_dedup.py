"""Removing byte strings that also start earlier, by bucket-pointer refinement.

Not all suffixes are sorted: of each window of ``width`` bytes only the suffix
at its least q-gram of 32 bytes travels, with the identifier of the run's whole
context, as ``repeats`` describes. A task computes the identifiers of its own
texts by doubling (32, 64, ``width`` bytes: that of a pair of identifiers at two
offsets), as 64-bit hashes that every task makes alike, not as ranks of a sort
that are handed back. Buckets of suffixes with an equal q-gram are sorted by
context and place; where a bucket has several contexts, its runs are cut into
pieces and sorted again by the longer string that a piece shares, and what is
still left window by window. What this finds is checked on the bytes: a run of
repeats and the place it repeats are digested (md5) where each of them is, and
every byte covered by a run goes only if the two digests are equal. What
travels for that is places and digests, and the texts of documents that have
runs or are referred to; all others stay where they are.

Defined results: a null text is empty; rows with a null doc_id keep all bytes
and are no source; rows of one doc_id are one document where their texts are
equal, else they are told apart by a hash of the text, in whose order the
earlier one is; a very long text is worked on alone, in overlapping blocks; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .batches import BYTE, column, slices
from .tables import cut, labelled, sieve

#: Bytes of text whose runs are digested or taken out together.
AT_ONCE = 1 << 18
OUT = "doc_id long, n_bytes long, spans array<struct<start:int,len:int>>, kept binary"


def as_bytes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE[data], off


def spans_of(gone: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of the maximal runs of removed units; rows are apart."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[first] = True
    begin = gone & (edge[:-1] | np.concatenate([[True], ~gone[:-1]]))
    end = gone & (edge[1:] | np.concatenate([~gone[1:], [True]]))
    b, e = np.flatnonzero(begin), np.flatnonzero(end)
    row = np.searchsorted(first, b, side="right") - 1
    return row, b - first[row], e - b + 1


def span_lists(row: np.ndarray, start: np.ndarray, length: np.ndarray, rows: int) -> pa.Array:
    off = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(off, pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], ["start", "len"]))


def run_lists(rows: pa.RecordBatch, name: str = "z") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, n) of the lists of runs; a null list is none."""
    lists = column(rows, name)
    per = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten() if lists.null_count == 0 else lists.fill_null([]).flatten()
    start, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    if lists.null_count:
        per = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, per)
    return np.repeat(np.arange(len(per)), per), start, n


#: Runs that go on from one to the next are joined, to at most so many windows.
LONGEST = 1 << 16
PLACED = "doc_id long, row long, start int, n int, src long, src_row long, src_start int"


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``PLACED`` of lists z of runs: those whose windows and sources go on are one run."""
    for batch in batches:
        lists = column(batch, "z")
        per = np.diff(lists.offsets.to_numpy())
        start, n, src, src_row, src_start = (lists.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
        d = np.repeat(np.arange(len(per)), per)
        order = np.lexsort((start, start - src_start, src_row, src, d))
        d, start, n, src, src_row, src_start = (x[order] for x in (d, start, n, src, src_row, src_start))
        same = lambda x: x[1:] == x[:-1]
        on = same(d) & same(src) & same(src_row) & same(start - src_start) & (start[1:] <= start[:-1] + n[:-1]) & same(start // LONGEST)
        new = np.flatnonzero(np.concatenate([[True], ~on])) if len(d) else np.zeros(0, int)
        stop = np.maximum.reduceat(start + n, new) if len(d) else new
        k = pa.array(d[new])
        cols = [column(batch, "doc_id").take(k), column(batch, "row").take(k)]
        cols += [pa.array(x.astype(t)) for x, t in ((start[new], np.int32), (stop - start[new], np.int32), (src[new], np.int64), (src_row[new], np.int64), (src_start[new], np.int32))]
        yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in PLACED.split(", ")])


def digested(width: int):
    """Rows of texts with lists z of (src_start, n): the digest of the bytes of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, limit=AT_ONCE):
                d, start, n = run_lists(rows)
                raw, at = data.tobytes(), off[d] + start
                sums = [hashlib.md5(raw[a:b]).digest() for a, b in zip(at.tolist(), (at + n + width - 1).tolist(), strict=True)]
                k = pa.array(d)
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id").take(k), column(rows, "row").take(k), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(sums, pa.binary())], ["src", "src_row", "src_start", "n", "sum"])

    return work


def with_sources(own: repeats.Keyed, found: DataFrame, width: int) -> DataFrame:
    """(doc_id, row, z): the runs of each document that are results, each with the digest of what it repeats."""
    z = F.filter(F.arrays_zip("start", "n", "src", "src_row", "src_start", "open"), lambda x: ~x["open"])
    lists = found.select("doc_id", "row", z.alias("z")).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("z")).alias("z"))
    runs = cut(lists.mapInArrow(joined, PLACED))
    place = ["src", "src_row", "src_start", "n"]
    asked = cut(runs.groupBy(*place).agg(F.count("*").alias("times")))
    by_text = asked.groupBy(F.col("src").alias("doc_id"), F.col("src_row").alias("row")).agg(F.collect_list(F.struct("src_start", "n")).alias("z"))
    texts = own.rows(sieve(asked.select(F.col("src").alias("id"))))
    sums = texts.join(by_text.hint("shuffle_hash"), ["doc_id", "row"]).mapInArrow(digested(width), "src long, src_row long, src_start int, n int, sum binary")
    sums = cut(asked.join(sums.distinct(), place))
    told = labelled(runs, place, sums, "times", runs.count())
    return told.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n", "sum")).alias("z"))


def dedup_bytes(docs: DataFrame, width: int = 100, gram: int = 32, piece: int = 9) -> DataFrame:
    """``OUT``: one row per document with its removed spans and its remaining bytes."""
    own, found = repeats.repeated_runs(docs, as_bytes, width, gram, piece, at_once=1 << 20)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, limit=AT_ONCE):
                d, start, n = run_lists(rows)
                at, raw = off[d] + start, data.tobytes()
                lists = column(rows, "z")
                sums = (lists.flatten() if lists.null_count == 0 else lists.fill_null([]).flatten()).field(2)
                true = np.array([hashlib.md5(raw[a:b]).digest() == s.as_py() for a, b, s in zip(at.tolist(), (at + n + width - 1).tolist(), sums, strict=True)], bool)
                gone = repeats.covered(off, d[true], start[true], n[true], width)
                left = data[~gone]
                kept_off = np.concatenate([[0], np.cumsum(~gone)])[off]
                kept = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer(kept_off.astype(np.int32).tobytes()), pa.py_buffer(left.tobytes())])
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(np.diff(off)), span_lists(*spans_of(gone, off), rows.num_rows), kept], ["doc_id", "n_bytes", "spans", "kept"])

    runs = cut(with_sources(own, found, width))
    bits = sieve(runs.select(F.col("doc_id").alias("id")))
    none = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("sum", pa.binary())]))

    def keep_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return keep(pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "text"), pa.array([[]] * b.num_rows, none)], ["doc_id", "text", "z"]) for b in batches)

    touched = own.rows(bits).join(runs.hint("shuffle_hash"), ["doc_id", "row"], "left").select("doc_id", "text", "z").mapInArrow(keep, OUT)
    judged = touched.unionByName(own.through(keep_all, OUT, bits, inside=False))
    rest = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start:int,len:int>>)").alias("spans"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"))
    return judged.unionByName(rest)
