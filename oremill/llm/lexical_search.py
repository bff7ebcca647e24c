"""Ranked lexical search: every document is scored for every item, equal bags only once.

Of a document the search needs only its bag, the item terms that it holds with
how often, and the length weight m. One scan writes each document's length and
bag; document counts and frequencies are sums over that table. Documents of
equal (bag, m) have equal scores for all items, so they form a class: its key is
a hash, and bag and m are compared with it in the same grouping. A class keeps
its ``depth`` least ids, which is all that a list of ``depth`` can show. Classes
are scored against all items by an index from terms to items; a task keeps the
best ``depth`` classes of each item. Ranks then order the members of those.

Items are the query set. Their terms are sent to all tasks in blocks of at most
``ITEM_BYTES`` of text and ``ITEMS`` items, one pass over the documents a block.

Terms are maximal runs of ASCII letters, digits and any character beyond ASCII;
only A to Z are lower-cased.

Defined results: null texts have no term; documents without terms count in no
statistic; rows with a null id count in the statistics but cannot be named in a
result; equal ids are separate documents, equal items separate lists; an item
without terms, or whose terms no document holds, has no rows; a score of 0 is no
result; equal scores come by ascending id; empty tables give an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import Words, column, slices, spread_out
from .tables import cut, fanout

DEPTH, ITEM_BYTES, ITEMS = 10, 16 << 20, 50_000
#: Additions of a step, and cells of its table of scores.
ADDS, CELLS = 4 << 20, 8 << 20

BETWEEN = np.zeros(256, dtype=bool)
for lo, hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    BETWEEN[lo : hi + 1] = True


def terms_of(data: np.ndarray, off: np.ndarray) -> Words:
    return Words(data, off, lower=True, space=BETWEEN)


@dataclass
class Vocabulary:
    """Terms of a block of items in the order of their hash; that place is a term's number."""

    hash: np.ndarray
    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    #: items of term t are item[first[t]:first[t + 1]]
    first: np.ndarray
    item: np.ndarray
    ids: list

    def numbers(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(which words are terms of items, their numbers), compared byte by byte."""
        if not len(self.hash) or not len(w):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        word = np.flatnonzero((self.hash[at] == w.hash) & (self.length[at] == w.length))
        term = at[word]
        long = self.length[term]
        same = w.data[spread_out(w.start[word], long)] == self.data[spread_out(self.start[term], long)]
        ok = np.logical_and.reduceat(same, np.cumsum(long) - long) if len(word) else np.zeros(0, bool)
        return word[ok], term[ok]


def vocabulary(ids: list, texts: list[str | None]) -> Vocabulary:
    raw = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    w = terms_of(np.frombuffer(b"".join(raw), np.uint8), off)
    said = [w.data[s : s + n].tobytes() for s, n in zip(w.start.tolist(), w.length.tolist(), strict=True)]
    hashes = dict(zip(said, w.hash.tolist(), strict=True))
    terms = sorted(hashes, key=lambda t: hashes[t])
    if len(set(hashes.values())) < len(terms):
        raise ValueError("two terms of the items share a 64-bit hash")
    number = {t: k for k, t in enumerate(terms)}
    pairs = sorted({(number[t], int(i)) for t, i in zip(said, w.row, strict=True)})
    term, item = (np.array([p[k] for p in pairs], np.int64) for k in range(2))
    length = np.array([len(t) for t in terms], np.int64)
    return Vocabulary(np.array([hashes[t] for t in terms], np.uint64), np.frombuffer(b"".join(terms), np.uint8), np.cumsum(length) - length, length, np.searchsorted(term, np.arange(len(terms) + 1)), item, ids)


BAGS = "doc_id long, n long, bag binary"


def bags(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """``BAGS`` of every document: its number of terms, and (term, times) pairs of the items' terms in 32 bits each."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for rows, data, off in slices(batch):
                w = terms_of(data, off)
                word, term = v.numbers(w)
                key, times = np.unique(w.row[word] * max(len(v.hash), 1) + term, return_counts=True)
                row, term = np.divmod(key, max(len(v.hash), 1))
                pairs = np.stack([term, times], axis=1).astype("<u4")
                at = np.searchsorted(row, np.arange(rows.num_rows + 1))
                found = [pairs[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(np.diff(w.first)), pa.array(found, pa.binary())], ["doc_id", "n", "bag"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, BAGS)


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of all pairs of a batch's bags."""
    found = [b.as_buffer() for b in column(batch, "bag")]
    pairs = np.frombuffer(b"".join(found), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(found)), [b.size // 8 for b in found]), pairs[:, 0], pairs[:, 1]


def frequencies(kept: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term; a row a term comes to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            df += np.bincount(unpacked(batch)[1], minlength=terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    out = np.zeros(terms, np.int64)
    for r in kept.select("bag").mapInArrow(work, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def classes(kept: DataFrame, documents: int, length: int, depth: int) -> DataFrame:
    """(bag, m, ids): documents of equal bag and m, by their ``depth`` least ids.

    Ranks within a class are limited before the shuffle, so a class of very
    many copies sends ``depth`` rows from each task.
    """
    m = F.expr(f"10 + (90 * n * {documents}L) div {max(length, 1)}L")
    same = kept.where("doc_id is not null and octet_length(bag) > 0").select("doc_id", "bag", m.alias("m"))
    key = ["h", "m", "bag"]
    same = same.withColumn("h", F.xxhash64("bag", "m")).withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id")))
    return same.where(F.col("k") <= depth).groupBy(*key).agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).drop("h")


SCORED = "item int, score long, ids array<long>"


def scored(found: DataFrame, words: Vocabulary, weight: np.ndarray, depth: int) -> DataFrame:
    """``SCORED``: of each task the best ``depth`` classes of each item, by score, then least id."""
    shared = found.sparkSession.sparkContext.broadcast((words.first, words.item, len(words.ids), weight))
    # a term adds at most 10^6 times its weight; below 2^53 doubles add exactly
    heaviest = np.bincount(words.item, np.repeat(weight, np.diff(words.first)), len(words.ids)).max(initial=0) * 1e6
    exact = heaviest < 2**53

    def best(item: np.ndarray, score: np.ndarray, least: np.ndarray) -> np.ndarray:
        order = np.lexsort((least, -score, item))
        item = item[order]
        return order[np.arange(len(item)) - np.searchsorted(item, item) < depth]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, items, n, w = shared.value
        degree = np.diff(first)
        enough = np.ones(n, np.int64)
        item, score, least, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            row, term, times = unpacked(batch)
            m = column(batch, "m").to_numpy(zero_copy_only=False)
            own = column(batch, "ids").to_numpy(zero_copy_only=False)
            gain = w[term] * (1_000_000_000 * times // (1000 * times + 8 * m[row]))
            # rows up to which a step's additions fit
            adds = np.cumsum(np.bincount(row, degree[term], batch.num_rows))
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(adds, (adds[at - 1] if at else 0) + ADDS, side="right"))
                to = max(at + 1, min(to, at + max(1, CELLS // n)))
                a, b = np.searchsorted(row, (at, to))
                cell = np.repeat((row[a:b] - at) * n, degree[term[a:b]]) + items[spread_out(first[term[a:b]], degree[term[a:b]])]
                added = np.repeat(gain[a:b], degree[term[a:b]])
                if exact:
                    sums = np.bincount(cell, added, (to - at) * n).astype(np.int64)
                else:
                    sums = np.zeros((to - at) * n, np.int64)
                    np.add.at(sums, cell, added)
                sums = sums.reshape(to - at, n)
                r, i = np.nonzero(sums >= enough)
                item, score = np.concatenate([item, i]), np.concatenate([score, sums[r, i]])
                ids = np.concatenate([ids, own[at + r]])
                least = np.concatenate([least, np.array([x[0] for x in own[at:to]], np.int64)[r]])
                keep = best(item, score, least)
                item, score, least, ids = item[keep], score[keep], least[keep], ids[keep]
                last = np.flatnonzero(np.arange(len(item)) - np.searchsorted(item, item) == depth - 1)
                enough[item[last]] = score[last]
                at = to
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(score), pa.array(list(ids), pa.list_(pa.int64()))], ["item", "score", "ids"])

    return found.mapInArrow(work, SCORED)


def ranked(docs: DataFrame, words: Vocabulary, depth: int) -> DataFrame:
    """(item, rank, doc_id, score) for one block of items."""
    kept = cut(bags(docs, words))
    total = kept.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = frequencies(kept, len(words.hash))
    weight = np.array([math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
    best = scored(classes(kept, total["documents"], total["length"], depth), words, weight, depth)
    members = best.select("item", "score", F.explode("ids").alias("doc_id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, depth: int = DEPTH) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``depth`` best documents of each item with a score above 0."""
    spark, kind = docs.sparkSession, dict(items.dtypes)["item_id"]
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-size["bytes"] // ITEM_BYTES))
    out = None
    for block in range(blocks):
        # a block is bounded; its items come in a fixed order
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").toArrow().to_pylist()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or ""))
        if not rows:
            continue
        words = vocabulary([r["item_id"] for r in rows], [r["text"] for r in rows])
        names = F.broadcast(spark.createDataFrame(list(enumerate(words.ids)), f"item int, item_id {kind}"))
        part = ranked(docs, words, depth).join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
