"""Text quality from random-indexing word vectors and a two-layer network.

Words have ``UNITS`` units and word shapes ``SHAPES`` more, by their hashes, each
with a fixed sparse random index vector. A unit's context vector is the sum of
the index vectors of the words within two places of it, over the whole corpus.
A task sums the units that it meets and Spark adds up these sums by unit; the
table of all units' vectors, 9 MB whatever the corpus, is broadcast. A
document is the mean and the spread of its words' vectors.

The network (one hidden layer of tanh) is fitted with NumPy on the driver to
labelled documents, at most about ``SAMPLE`` of them by a hash of their ids;
a fifth of these is left aside to set the temperature that calibrates the
probabilities.

Defined results: a null or blank text has no words and is scored as such; a
null doc_id is scored, not learned from; of several labels of a document the
least counts; rows that share an id are learned from each, equal ones once;
equal texts get equal scores, and a very long text is worked on alone and whole;
without any label all scores are 0.5; an empty table gives an empty one; other
columns are passed through, but ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .batches import FINE, Words, column, slices
from .tables import cut, fanout, held_out
from .word_features import shapes

UNITS, SHAPES, DIM = 1 << 16, 1 << 10, 32
SAMPLE, HIDDEN, EPOCHS = 20_000, 24, 300


def index_vectors() -> np.ndarray:
    """A fixed sparse vector of -1, 0 and 1 for each unit."""
    draw = np.random.default_rng(11).integers(0, 8, size=(UNITS + SHAPES, DIM), dtype=np.int8)
    return (draw == 0).astype(np.int8) - (draw == 7).astype(np.int8)


def units(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The word unit and the shape unit of each word."""
    return (w.hash % np.uint64(UNITS)).astype(np.int64), (shapes(w) % np.uint64(SHAPES)).astype(np.int64) + UNITS


def added(index: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The units of a slice, and of each the sum of the index vectors around it and how often it occurs."""
    word, shape = units(w)
    own = index[word].astype(np.float32) + index[shape]
    around = np.zeros((len(own), DIM + 1), np.float32)
    around[:, DIM] = 1
    for k in (1, 2):
        near = (w.row[k:] == w.row[:-k])[:, None]
        around[k:, :DIM] += own[:-k] * near
        around[:-k, :DIM] += own[k:] * near
    found, sums = [], []
    for u in (word, shape):
        order = np.argsort(u, kind="stable")
        begin = np.flatnonzero(np.diff(u[order], prepend=-1))
        found.append(u[order][begin])
        sums.append(np.add.reduceat(around[order], begin, axis=0))
    return np.concatenate(found), np.concatenate(sums)


def contexts(docs: DataFrame) -> np.ndarray:
    """(units, DIM + 1): summed index vectors around each unit, and how often it occurs."""

    def packed(found: np.ndarray, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(found), 4096):
            k = found[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array([r.tobytes() for r in table[k]], pa.binary())], ["unit", "sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, table = index_vectors(), np.zeros((UNITS + SHAPES, DIM + 1), np.float32)
        for batch in batches:
            for _, data, off in slices(batch, limit=FINE):
                w = Words(data, off)
                if len(w):
                    found, sums = added(index, w)
                    table[found] += sums
        yield from packed(np.flatnonzero(table[:, DIM]), table)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((UNITS + SHAPES, DIM + 1), np.float64)
        for batch in batches:
            if batch.num_rows:
                unit = column(batch, "unit").to_numpy()
                part = np.frombuffer(b"".join(c.as_buffer() for c in column(batch, "sums")), np.float32).reshape(-1, DIM + 1)
                order = np.argsort(unit, kind="stable")
                begin = np.flatnonzero(np.diff(unit[order], prepend=-1))
                table[unit[order][begin]] += np.add.reduceat(part[order].astype(np.float64), begin, axis=0)
        # counts and sums of the corpus as 32-bit numbers: a share is all that is used of them
        yield from packed(np.flatnonzero(table[:, DIM]), table.astype(np.float32))

    kind = "unit int, sums binary"
    parts = docs.select("text").mapInArrow(add_up, kind).repartition(fanout(docs, 0.25), "unit").mapInArrow(total, kind)
    out = np.zeros((UNITS + SHAPES, DIM + 1), np.float32)
    # a table of fixed size comes to the driver
    got = parts.toArrow()
    for batch in got.to_batches():
        if batch.num_rows:
            out[column(batch, "unit").to_numpy()] = np.frombuffer(b"".join(c.as_buffer() for c in column(batch, "sums")), np.float32).reshape(-1, DIM + 1)
    return out


def word_vectors(table: np.ndarray) -> np.ndarray:
    """Context vectors a word, without what all have in common, of length 1."""
    often = table[:, DIM:]
    v = table[:, :DIM] / np.maximum(often, 1)
    v = v - (v * often).sum(axis=0, dtype=np.float64).astype(np.float32) / max(float(often.sum(dtype=np.float64)), 1)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) * (often > 0)).astype(np.float32)


def pooled(vectors: np.ndarray, w: Words, rows: int) -> np.ndarray:
    """(rows, 4 DIM): mean and standard deviation over words of their word and shape vectors."""
    out = np.zeros((rows, 4 * DIM))
    some = np.flatnonzero(np.diff(w.first) > 0)
    if len(some):
        word, shape = units(w)
        n = np.diff(w.first)[some][:, None]
        for k, u in enumerate((word, shape)):
            v = vectors[u]
            mean = np.add.reduceat(v, w.first[some], axis=0, dtype=np.float64) / n
            square = np.add.reduceat(v * v, w.first[some], axis=0, dtype=np.float64) / n
            out[some, 2 * k * DIM : (2 * k + 1) * DIM] = mean
            out[some, (2 * k + 1) * DIM : (2 * k + 2) * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the logistic loss; then the temperature that the fifth left aside likes best."""
    rng = np.random.default_rng(3)
    aside = rng.permutation(len(x)) % 5 == 0 if len(x) >= 50 else np.zeros(len(x), bool)
    a, t = x[~aside], y[~aside].astype(float)
    d = x.shape[1]
    net = Network(a.mean(axis=0), a.std(axis=0) + 1e-6, rng.normal(size=(d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), float(np.log((t.sum() + 1) / (len(t) - t.sum() + 1))))
    z = (a - net.mean) / net.scale
    names = ("w1", "b1", "w2", "b2")
    m, s = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    for step in range(1, EPOCHS + 1):
        h = np.tanh(z @ net.w1 + net.b1)
        gap = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -500, 500))) - t
        back = np.outer(gap, net.w2) * (1 - h * h)
        grads = {"w1": z.T @ back / len(t) + 1e-4 * net.w1, "b1": back.mean(axis=0), "w2": h.T @ gap / len(t) + 1e-4 * net.w2, "b2": gap.mean()}
        for k in names:
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            s[k] = 0.999 * s[k] + 0.001 * grads[k] ** 2
            setattr(net, k, getattr(net, k) - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8))
    if aside.any():
        g, t = net.logits(x[aside]), y[aside].astype(float)
        loss = lambda c: float(np.mean(np.logaddexp(0, g / c) - t * g / c))
        net.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return net


def features(docs: DataFrame, vectors, label: str) -> DataFrame:
    """(id, label, x): pooled vectors as bytes of doubles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, limit=FINE):
                x = pooled(vectors.value, Words(data, off), rows.num_rows)
                yield pa.RecordBatch.from_arrays([column(rows, "id"), column(rows, "label"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "x"])

    return docs.select("text", F.col("__id").alias("id"), F.col(label).cast("int").alias("label")).mapInArrow(work, "id long, label int, x binary")


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network | None]:
    """Word vectors of the whole corpus, and a network for ``labels`` (doc_id, quality)."""
    vectors = word_vectors(contexts(docs))
    told = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("__label"))
    number = told.count()
    if not number:
        return vectors, None
    share = F.lit(int(min(1.0, SAMPLE / number) * (1 << 30)))
    picked = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << 30)) < share
    sample = docs.where(F.col("doc_id").isNotNull()).where(picked("doc_id")).select(F.col("doc_id").cast("long").alias("__id"), "text").join(told.where(picked("__id")), "__id")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    # equal rows are one; repeated ids may still make it more than the sample, then a hash of whole rows thins it
    known = cut(features(sample.repartition(fanout(docs, 0.5)), shared, "__label").distinct())
    found = known.count()
    if found > 2 * SAMPLE:
        known = known.where(F.pmod(F.xxhash64("id", "x", "label"), F.lit(1 << 30)) < int(2 * SAMPLE / found * (1 << 30)))
    got = known.select("label", "x").toArrow()
    shared.destroy()
    if not got.num_rows:
        return vectors, None
    x = np.frombuffer(b"".join(c.as_buffer() for c in got["x"]), "<f8").reshape(got.num_rows, -1)
    y = got["label"].to_numpy()
    order = np.lexsort((*x.T[::-1], y))  # the same whatever the partitions
    return vectors, fit(x[order], y[order])


def score(docs: DataFrame, model: tuple[np.ndarray, Network | None]) -> DataFrame:
    """All columns of ``docs`` and ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.drop("score")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for batch in batches:
            for rows, data, off in slices(batch, limit=FINE):
                s = net.scores(pooled(vectors, Words(data, off), rows.num_rows)) if net else np.full(rows.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s)], [*rows.schema.names, "score"])

    return own.mapInArrow(work, StructType([*own.schema.fields, StructField("score", DoubleType())]))
