"""Removing word windows that also start earlier, by suffix automata of reference shards.

``repeats`` finds which passages can be repeats and where each starts first, so
that a document need not be streamed past the whole corpus. The first places
are the reference. It is cut into shards of bounded size; a shard's passages,
in order of place, make one suffix automaton, sent whole to each task that
streams documents against it. The matching statistics of a streamed passage
give, word by word, the longest match; where it reaches ``width`` words and the
matched string's first place is earlier, the window's words go. Words, not
hashes, are compared here, so a hash that deceived the search removes nothing.

A shard that a large group of copies refers to is given several tasks, each
with the automaton and a part of the documents; their number follows from the
shard's count of words. Shards have at most about ``SHARD`` words unless one
block of a document exceeds that.

Defined results: a null or blank text has no words; rows with a null doc_id
keep all words and are no source; rows of one doc_id are one document where
their texts are equal, else a hash of the text orders them; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .batches import Words, column, slices
from .suffix_array_dedup import run_lists, span_lists, spans_of
from .tables import cut

#: Words of reference in a shard, words of documents in a task, windows of a run, words of a reference block.
SHARD, TASK, RUN, GRID = 100_000, 200_000, 4096, 64
OUT = "doc_id long, n_words long, spans array<struct<start:int,len:int>>, kept string"
RUNS = "doc_id long, row long, start int, n int, src long, src_row long, src_start int"
PASSAGE = "shard int, salt int, doc_id long, row long, start int, words binary"


class SuffixAutomaton:
    """Of several word sequences; ``first`` is where a state's strings end first, in order of feeding."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.fed = 0

    def _state(self, to: dict[bytes, int], link: int, length: int, first: int) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A copy of q for the strings of p and one word."""
        c = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def feed(self, words: list[bytes]) -> None:
        """Adds a sequence; no match runs across two of them."""
        last, nxt, link, length = 0, self.next, self.link, self.length
        for word in words:
            at = self.fed
            self.fed += 1
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
                continue
            new = self._state({}, 0, length[last] + 1, at)
            p = last
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
            last = new

    def matches(self, words: list[bytes], width: int) -> Iterator[tuple[int, int]]:
        """(i, first end) for each window of ``width`` words, ending at i, that was fed."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = size = 0
        for i, word in enumerate(words):
            to = nxt[state].get(word)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(word)
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            if size >= width:
                while length[link[state]] >= width:
                    state = link[state]
                    size = length[state]
                yield i, first[state]


def as_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = Words(data, off)
    return w.hash, w.first


def joined(w: Words, kept: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words with a space after each, and where each row's start."""
    n = np.where(kept, w.length, 0)
    at = np.flatnonzero(np.repeat(kept, w.length))
    inside = np.flatnonzero(_inside(w))[at]
    out = np.full(int(n.sum()) + int(kept.sum()), 32, np.uint8)
    out[np.arange(len(at)) + np.repeat(np.cumsum(kept) - 1, n)] = w.data[inside]
    return out.tobytes(), np.concatenate([[0], np.cumsum(n + kept)])[w.first]


def _inside(w: Words) -> np.ndarray:
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.start] += 1
    edge[w.start + w.length] -= 1
    return np.cumsum(edge)[:-1] > 0


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins runs whose windows and sources go on from one to the next; long ones are cut."""
    for batch in batches:
        lists = column(batch, "z")
        per = np.diff(lists.offsets.to_numpy())
        start, n, src, src_row, src_start = (lists.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
        d = np.repeat(np.arange(len(per)), per)
        order = np.lexsort((start, start - src_start, src_row, src, d))
        d, start, n, src, src_row, src_start = (x[order] for x in (d, start, n, src, src_row, src_start))
        same = lambda x: x[1:] == x[:-1]
        on = same(d) & same(src) & same(src_row) & same(start - src_start) & (start[1:] <= start[:-1] + n[:-1])
        new = np.flatnonzero(np.concatenate([[True], ~on])) if len(d) else np.zeros(0, int)
        stop = np.maximum.reduceat(start + n, new) if len(d) else new
        d, start, src, src_row, src_start = (x[new] for x in (d, start, src, src_row, src_start))
        total = stop - start
        count = -(-total // RUN)
        step = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * RUN
        d, start, src, src_row, src_start, total = (np.repeat(x, count) for x in (d, start, src, src_row, src_start, total))
        cols = [column(batch, "doc_id").take(pa.array(d)), column(batch, "row").take(pa.array(d))]
        cols += [pa.array(x.astype(k)) for x, k in ((start + step, np.int32), (np.minimum(RUN, total - step), np.int32), (src, np.int64), (src_row, np.int64), (src_start + step, np.int32))]
        yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in RUNS.split(", ")])


def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a list z of (start, words, shard, salt): the words of each, joined by spaces."""
    for batch in batches:
        for rows, data, off in slices(batch):
            w = Words(data, off)
            lists = column(rows, "z")
            per = np.diff(lists.offsets.to_numpy())
            start, n, shard, salt = (lists.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            d = np.repeat(np.arange(len(per)), per)
            raw, at = joined(w, np.ones(len(w), bool))[0], np.concatenate([[0], np.cumsum(w.length + 1)])
            a = w.first[d] + start
            b = np.minimum(a + n, w.first[d + 1])
            texts = [raw[x:y] for x, y in zip(at[a].tolist(), (at[b] - 1).tolist(), strict=True)]
            cols = [pa.array(shard.astype(np.int32)), pa.array(salt.astype(np.int32)), column(rows, "doc_id").take(pa.array(d)), column(rows, "row").take(pa.array(d)), pa.array(start.astype(np.int32)), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in PASSAGE.split(", ")])


def streamed(width: int):
    """Of a shard's reference and documents: the windows of the latter that start earlier in the former."""

    def work(reference: pa.Table, streams: pa.Table) -> pa.Table:
        reference = reference.sort_by([("doc_id", "ascending"), ("row", "ascending"), ("start", "ascending")])
        automaton, bounds = SuffixAutomaton(), []
        places = list(zip(*(reference[c].to_pylist() for c in ("doc_id", "row", "start")), strict=True))
        for cell in reference["words"]:
            bounds.append(automaton.fed)
            automaton.feed(cell.as_py().split(b" "))
        out: list[tuple[int, int, int, int]] = []
        for doc, row, start, cell in zip(*(streams[c].to_pylist() for c in ("doc_id", "row", "start")), streams["words"], strict=True):
            begin = size = -1
            for i, end in automaton.matches(cell.as_py().split(b" "), width):
                at = bisect_right(bounds, end) - 1
                d, r, s = places[at]
                if (d, r, s + end - width + 1 - bounds[at]) >= (doc, row, start + i - width + 1):
                    continue
                if i - width + 1 == begin + size:
                    size += 1
                    continue
                if size > 0:
                    out.append((doc, row, start + begin, size))
                begin, size = i - width + 1, 1
            if size > 0:
                out.append((doc, row, start + begin, size))
        kinds = [("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]
        return pa.table([pa.array([x[i] for x in out], k) for i, (_, k) in enumerate(kinds)], names=[c for c, _ in kinds])

    return work


def kept_words(width: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch):
                w = Words(data, off)
                gone = repeats.covered(w.first, *run_lists(rows), width)
                raw, at = joined(w, ~gone)
                texts = [raw[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(np.diff(w.first)), span_lists(*spans_of(gone, w.first), rows.num_rows), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "spans", "kept"])

    return keep


def dedup_words(docs: DataFrame, width: int = 20, gram: int = 10) -> DataFrame:
    """``OUT``: one row per document with its removed spans, in words, and its remaining words."""
    texts, found = repeats.repeated_runs(docs, as_words, width, gram)
    own = texts.rows()
    z = F.filter(F.arrays_zip("start", "n", "src", "src_row", "src_start", "open"), lambda x: ~x["open"])
    runs = cut(found.select("doc_id", "row", z.alias("z")).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("z")).alias("z")).mapInArrow(merged, RUNS))
    words = int(runs.agg(F.sum(F.col("n") + width)).head()[0] or 0)
    shards = max(64, math.ceil(words / SHARD))
    runs = runs.withColumn("shard", F.pmod(F.xxhash64("src", "src_row", F.floor(F.col("src_start") / (4 * RUN))), F.lit(shards)).cast("int"))
    salts = cut(runs.groupBy("shard").agg(F.ceil(F.sum(F.col("n") + width) / TASK).cast("int").alias("salts")))

    streams = runs.join(salts, "shard").select("doc_id", "row", F.struct("start", (F.col("n") + width - 1).alias("n"), "shard", F.pmod(F.xxhash64("doc_id", "row"), F.col("salts")).cast("int").alias("salt")).alias("z"))
    streams = streams.groupBy("doc_id", "row").agg(F.collect_list("z").alias("z"))
    streams = own.join(streams.hint("shuffle_hash"), ["doc_id", "row"]).mapInArrow(passages, PASSAGE)

    blocks = runs.select("shard", F.col("src").alias("doc_id"), F.col("src_row").alias("row"), F.explode(F.sequence(F.floor(F.col("src_start") / GRID).cast("int"), F.floor((F.col("src_start") + F.col("n") + width - 2) / GRID).cast("int"))).alias("b")).distinct()
    # neighbouring blocks make one passage
    blocks = blocks.groupBy("doc_id", "row", "shard").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    ends = lambda other: F.filter("bs", lambda b: ~F.array_contains("bs", b + other))
    blocks = blocks.select("doc_id", "row", F.transform(F.arrays_zip(ends(-1).alias("a"), ends(1).alias("e")), lambda x: F.struct((x["a"] * GRID).alias("start"), ((x["e"] - x["a"] + 1) * GRID).alias("n"), F.col("shard"), F.lit(0).alias("salt"))).alias("z"))
    blocks = blocks.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("z")).alias("z"))
    reference = own.join(blocks.hint("shuffle_hash"), ["doc_id", "row"]).mapInArrow(passages, PASSAGE)
    reference = reference.drop("salt").join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("shard", "salt", "doc_id", "row", "start", "words")

    sure = reference.groupBy("shard", "salt").cogroup(streams.groupBy("shard", "salt")).applyInArrow(streamed(width), "doc_id long, row long, start int, n int")
    gone = sure.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("z"))
    judged = own.join(gone.hint("shuffle_hash"), ["doc_id", "row"], "left").select("doc_id", "text", "z").mapInArrow(kept_words(width), OUT)
    none = F.expr("cast(null as array<struct<start:int,n:int>>)").alias("z")
    rest = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), "text", none).mapInArrow(kept_words(width), OUT)
    return judged.unionByName(rest)


