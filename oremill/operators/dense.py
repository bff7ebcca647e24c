"""Nearest neighbours by all pairs: blocks of rows meet in streams, cheap lower bounds leave few pairs to compare."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import checkpointed

#: Rows of a block at most, its bytes at about; rows of queries gone through at once; bytes of pairs compared at once; neighbours that a task holds at most, and rows that it returns at once.
ROWS, BYTES, STRIP, PAIRS, HELD, OUT = 4096, 1 << 20, 256, 1 << 18, 1 << 22, 1 << 16
#: Spark's setting for the bytes of rows that go to Python at once, its default, and what is put in its place.
BATCH_BYTES, BATCH_DEFAULT, BATCH_SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(2 << 20)
#: Rows of which a small strip of distances stays in the cache; columns up to which 16 bits hold a sum of gaps; size from which on 32 bits may overflow.
NARROW, WIDE, HUGE = 8, 1024, 1e15


def exact(q: np.ndarray, t: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances of rows of equal number, or of all that broadcasting pairs up."""
    gap = np.abs(q - t)
    if metric == "euclidean":
        return np.sqrt((gap * gap).sum(axis=-1))
    if metric == "manhattan":
        return gap.sum(axis=-1)
    if metric == "chebyshev":
        return gap.max(axis=-1)
    if metric == "minkowski":
        return (gap**p).sum(axis=-1) ** (1 / p)
    raise ValueError(metric)


class Products:
    """Squared euclidean distances less the query's own part, as one product of 32-bit matrices; they bound the other distances from below."""

    def __init__(self, q: np.ndarray, first: np.ndarray, metric: str, p: float):
        d = q.shape[1]
        self.middle = np.where(np.isfinite(q), q, 0).mean(axis=0)
        # what 32 bits can lose, as a share of both rows' squares
        self.eps = (d + 16) * 2.0**-22
        # of length 1 by the metric, the longest by squares
        self.wider = d ** (0.5 - 1 / p) if metric == "minkowski" and p > 2 else d**0.5 if metric == "chebyshev" else 1.0
        x = (q - self.middle).astype(np.float32)
        self.own = (x.astype(float) ** 2).sum(axis=1) * (1 - self.eps)
        self.left = np.concatenate([-2 * x, np.ones((len(x), 1), np.float32)], axis=1)

    def ready(self, t: np.ndarray) -> np.ndarray:
        x = (t - self.middle).astype(np.float32)
        return np.concatenate([x, ((x.astype(float) ** 2).sum(axis=1) * (1 - self.eps)).astype(np.float32)[:, None]], axis=1).T

    def scores(self, rows: slice, t: np.ndarray) -> np.ndarray:
        return self.left[rows] @ t

    def limit(self, rows: slice, most: np.ndarray) -> np.ndarray:
        square = (most * self.wider) ** 2
        return (square * (1 + 1e-5) - self.own[rows]).astype(np.float32)


class Gaps:
    """Sums of gaps, or largest gaps, of values cut to few bits; a value beyond the common range counts as its border, which only shortens."""

    def __init__(self, q: np.ndarray, first: np.ndarray, metric: str, p: float):
        d = q.shape[1]
        self.sums = metric == "manhattan"
        self.kind, self.total = (np.int16, np.uint16) if self.sums else (np.int8, np.int8)
        self.top = min(32767, 65535 // d) if self.sums else 127
        both = np.concatenate([q, first])
        both = np.where(np.isfinite(both), both, 0)
        self.low, high = np.quantile(both, (0.002, 0.998), axis=0)
        width = float((high - self.low).max())
        self.step = width / self.top if width > 0 else 1.0
        self.slack = d if self.sums else 1
        self.left = self.ready(q)

    def ready(self, t: np.ndarray) -> np.ndarray:
        at = np.clip((np.where(np.isfinite(t), t, 0) - self.low) / self.step, 0, self.top)
        return np.ascontiguousarray(np.rint(at).astype(self.kind).T)

    def scores(self, rows: slice, t: np.ndarray) -> np.ndarray:
        q = self.left[:, rows]
        out = np.zeros((q.shape[1], t.shape[1]), self.total)
        gap = np.empty((NARROW, t.shape[1]), self.kind)
        for at in range(0, len(out), NARROW):
            into = out[at : at + NARROW]
            g = gap[: len(into)]
            total = into.view(self.kind)
            for j in range(len(t)):
                np.subtract(q[j, at : at + NARROW, None], t[j], out=g)
                np.abs(g, out=g)
                if self.sums:
                    np.add(total, g, out=total)
                else:
                    np.maximum(total, g, out=total)
        return out

    def limit(self, rows: slice, most: np.ndarray) -> np.ndarray:
        most = np.where(np.isfinite(most), most, np.inf)
        return np.minimum(np.floor(most / self.step * (1 + 1e-9)) + self.slack + 1, np.iinfo(self.total).max).astype(self.total)


class Search:
    """The k nearest rows so far of a block of queries in one metric, ties by id; takes blocks of train rows one by one."""

    def __init__(self, q: np.ndarray, k: int, metric: str, p: float):
        self.q, self.k, self.metric, self.p = q, k, metric, p
        self.wild = ~(np.abs(q) < HUGE).all(axis=1)
        self.most, self.bounds = np.full(len(q), np.inf), None
        #: (row of the query, distance, id for ties, rows of the train table), the first part in order
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]] = []
        self.waiting = 0

    def pairs(self, i: np.ndarray, j: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, distance) of the given pairs, without what is beyond the bound."""
        out, step = [], max(1, PAIRS // (8 * t.shape[1]))
        for at in range(0, max(1, len(i)), step):
            a, b = i[at : at + step], j[at : at + step]
            if self.metric == "minkowski" and self.p == 3:
                gap = np.abs(self.q[a] - t[b])
                few = ~(np.einsum("ij,ij,ij->i", gap, gap, gap) > self.most[a] ** 3 * (1 + 1e-9))
                a, b = a[few], b[few]
            d = exact(self.q[a], t[b], self.metric, self.p)
            few = ~(d > self.most[a])
            out.append((a[few], b[few], d[few]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    @np.errstate(invalid="ignore", over="ignore")
    def add(self, t: np.ndarray, ids: np.ndarray, rows: pa.Table) -> None:
        if self.bounds is None:
            self.bounds = (Gaps if self.metric in ("manhattan", "chebyshev") and t.shape[1] <= WIDE else Products)(self.q, t, self.metric, self.p)
        ready, wild = self.bounds.ready(t), ~(np.abs(t) < HUGE).all(axis=1)
        for at in range(0, len(self.q), STRIP):
            part = slice(at, min(at + STRIP, len(self.q)))
            score = self.bounds.scores(part, ready)
            if self.k < len(t) and np.isinf(self.most[part]).any():
                # any k rows bound the k-th distance, those of the least bounds well
                some = np.argpartition(score, self.k - 1, axis=1)[:, : self.k]
                far = np.stack([exact(self.q[at + n], t[s], self.metric, self.p).max() for n, s in enumerate(some)])
                self.most[part] = np.fmin(self.most[part], far)
            open_ = ~(score > self.bounds.limit(part, self.most[part])[:, None])
            open_[self.wild[part]] = True
            open_[:, wild] = True
            i, j = np.divmod(np.flatnonzero(open_), len(t))
            i, j, d = self.pairs(i + at, j, t)
            if len(i):
                self.parts.append((i, d, ids[j], rows.take(pa.array(j))))
                self.waiting += len(i)
            if self.waiting > max(len(self.q) * self.k, 1 << 14):
                self.merge()

    def merge(self) -> None:
        if not self.parts:
            return
        i, d, ids = (np.concatenate(c) for c in list(zip(*self.parts, strict=True))[:3])
        rows = pa.concat_tables([p[3] for p in self.parts])
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, d, i))
        rank = np.arange(len(order)) - np.searchsorted(i[order], i[order])
        order = order[rank < self.k]
        i, d, rank = i[order], d[order], rank[rank < self.k]
        last = rank == self.k - 1
        self.most[i[last]] = np.fmin(self.most[i[last]], np.where(np.isnan(d[last]), np.inf, d[last]))
        self.parts, self.waiting = [(i, d, ids[order], rows.take(pa.array(order)).combine_chunks())], 0

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table | None]:
        """(row of the query, rank from 1, distance, train rows) in order."""
        self.merge()
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), None
        i, d, _, rows = self.parts[0]
        return i, (np.arange(len(i)) - np.searchsorted(i, i) + 1).astype(np.int32), d, rows


def _values(a: pa.Array) -> np.ndarray:
    """For the order of ids: numbers as they are, others as objects."""
    return a.to_numpy(zero_copy_only=False) if pa.types.is_integer(a.type) and not a.null_count else np.array([str(v) if v is None else v for v in a.to_pylist()], object)


def packed(rows: DataFrame, mark: str, by: Sequence[str], more: Sequence[str], limit: int) -> DataFrame:
    """(by.., ids, x, more..) of (id, x, by.., more..): up to ``limit`` rows of one group as one row, x as the bytes of its doubles; names begin with ``mark``."""
    kinds = dict(rows.dtypes)
    names = [*(f"{mark}b{i}" for i in range(len(by))), f"{mark}ids", f"{mark}x", *(f"{mark}c{i}" for i in range(len(more)))]
    types = [*(kinds[c] for c in by), f"array<{kinds['id']}>", "binary", *(f"array<{kinds[c]}>" for c in more)]

    def block(t: pa.Table, group: tuple) -> pa.RecordBatch:
        one = lambda c: t.column(c).combine_chunks()
        listed = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        x = one("x").flatten().to_numpy(zero_copy_only=False).astype(float)
        own = [pa.array([v], t.schema.field(c).type) for c, v in zip(by, group, strict=True)]
        return pa.RecordBatch.from_arrays([*own, listed(one("id")), pa.array([x.tobytes()], pa.binary()), *(listed(one(c)) for c in more)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, pa.Table] = {}
        for b in batches:
            if not b.num_rows:
                continue
            places: dict[tuple, list[int]] = {}
            if by:
                for n, group in enumerate(zip(*(b.column(c).to_pylist() for c in by), strict=True)):
                    places.setdefault(group, []).append(n)
            t = pa.Table.from_batches([b])
            for group, own in places.items() if by else [((), None)]:
                part = t if own is None else t.take(pa.array(own))
                part = pa.concat_tables([held.pop(group), part]) if group in held else part
                while part.num_rows >= limit:
                    yield block(part.slice(0, limit), group)
                    part = part.slice(limit)
                if part.num_rows:
                    held[group] = part
            if sum(p.num_rows for p in held.values()) > 16 * limit:
                for group, part in held.items():
                    yield block(part, group)
                held = {}
        for group, part in held.items():
            yield block(part, group)

    return rows.select("id", "x", *by, *more).mapInArrow(work, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def nearest(q: DataFrame, t: DataFrame, k: int, metrics: Sequence[str], p: float, by: Sequence[str], carry: Sequence[str], feats: int, number: int) -> DataFrame:
    """(by.., metric, qid, tid, d, carry.., rank) for queries (id, x, by..), ``number`` of them, and train rows (id, x, by.., carry..).

    Rows are packed in blocks. Each task holds a share of the queries and their
    k nearest so far, and the blocks of all train rows stream past it; so memory
    does not grow with either table, nothing but the packed rows is written, and
    tasks are as many as shares. A product of matrices, or gaps in few bits,
    gives each pair a lower bound of its distance; only pairs within the k-th
    distance so far are compared in full.
    """
    limit = max(64, min(ROWS, BYTES // (8 * max(1, feats))))
    share = max(16, min(limit, HELD // max(1, k)))
    tasks = max(-(-number // share), min(4 * q.sparkSession.sparkContext.defaultParallelism, -(-number // 256)), 1)
    kq, kt, conf = dict(q.dtypes), dict(t.dtypes), q.sparkSession.conf
    if conf.get(BATCH_BYTES, BATCH_DEFAULT) == BATCH_DEFAULT:
        # a pair of blocks or two; a setting of the session's own stays
        conf.set(BATCH_BYTES, BATCH_SMALL)
    # blocks of queries are made anew for each read of their shuffle, those of train rows once
    # small row groups, as a reader takes one whole
    left = checkpointed(packed(t, "t", by, carry, limit), **{"parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false"}).coalesce(1)
    right = packed(q.select("id", "x", *by).repartition(tasks, "id"), "q", by, (), share).hint("shuffle_replicate_nl")
    same = None
    for i in range(len(by)):
        equal = F.col(f"tb{i}").eqNullSafe(F.col(f"qb{i}"))
        same = equal if same is None else same & equal
    pairs = left.crossJoin(right) if same is None else left.join(right, same)
    names = [*by, "metric", "qid", "tid", "d", *carry, "rank"]
    schema = ", ".join([*(f"`{c}` {kq[c]}" for c in by), "metric string", f"qid {kq['id']}", f"tid {kt['id']}", "d double", *(f"`{c}` {kt[c]}" for c in carry), "rank int"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, tuple[tuple, pa.Array, list[Search]]] = {}
        types = None
        for b in batches:
            types = [b.schema.field(f"qb{i}").type for i in range(len(by))]
            for n in range(b.num_rows):
                one = lambda c, n=n, b=b: b.column(b.schema.get_field_index(c))[n]
                group, ids = tuple(one(f"qb{i}").as_py() for i in range(len(by))), one("qids").values
                key = (*group, ids[0].as_py())
                if key not in states:
                    x = np.frombuffer(one("qx").as_buffer(), float).reshape(len(ids), -1).copy()
                    kept = pa.concat_arrays([ids, ids.slice(0, 0)])
                    states[key] = (group, kept, [Search(x, k, m, p) for m in metrics])
                tids = one("tids").values
                x = np.frombuffer(one("tx").as_buffer(), float).reshape(len(tids), -1)
                rows = pa.table([tids, *(one(f"tc{i}").values for i in range(len(carry)))], names=["tid", *(f"c{i}" for i in range(len(carry)))])
                values = _values(tids)
                for s in states[key][2]:
                    s.add(x, values, rows)
        for key in list(states):
            group, ids, searches = states.pop(key)
            for s in searches:
                i, rank, d, rows = s.found()
                for at in range(0, len(i), OUT):
                    to = slice(at, at + OUT)
                    m = len(i[to])
                    own = [pa.array([v] * m, kind) for v, kind in zip(group, types, strict=True)]
                    near = rows.slice(at, m)
                    cols = [c.combine_chunks() for c in near.columns]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([s.metric] * m, pa.string()), ids.take(pa.array(i[to])), cols[0], pa.array(d[to]), *cols[1:], pa.array(rank[to])], names)

    return pairs.mapInArrow(meet, schema)
