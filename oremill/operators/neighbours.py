"""Nearest neighbours: cells around pivots or blocks of training rows, the k best of each, then of all."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oremill.functions.columns import distance

from .dense import exact
from .dense import nearest as dense_nearest
from .ranking import checkpointed, k_sweep_running_mean
from .selection import thresholds, trial_hashes

#: Pivots of a search at most; train rows, pivots and queries of the sample that tells whether cells leave out enough, and the share of pairs they may visit.
PIVOTS, TRIED, OPEN = 1024, (2048, 256, 64), 0.2
METRICS = ("euclidean", "manhattan", "chebyshev", "minkowski")


def pairwise_distance(df: DataFrame, ident: str, feats: Sequence[str], metric: str = "euclidean") -> DataFrame:
    """(a, b, d) of all pairs a < b of a small table, such as a summary by group."""
    x, y = df.alias("x"), df.alias("y")
    d = distance([F.col(f"x.{c}") for c in feats], [F.col(f"y.{c}") for c in feats], metric)
    return x.join(y, F.col(f"x.{ident}") < F.col(f"y.{ident}")).select(F.col(f"x.{ident}").alias("a"), F.col(f"y.{ident}").alias("b"), d.alias("d"))


def _distances(q: np.ndarray, t: np.ndarray, metric: str, p: float) -> np.ndarray:
    return exact(q[:, None, :], t[None, :, :], metric, p)


def _top(q: DataFrame, t: DataFrame, keys: Sequence[str], k: int, metrics: Sequence[str], p: float, by: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """(by.., metric, qid, tid, d, carry..): for each query (keys.., id, x) the k nearest train rows (keys.., id, x, carry..) of each key."""
    kq, kt = dict(q.dtypes), dict(t.dtypes)
    schema = ", ".join([*(f"{c} {kq[c]}" for c in by), "metric string", f"qid {kq['id']}", f"tid {kt['id']}", "d double", *(f"{c} {kt[c]}" for c in carry)])

    def nearest(qs: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, "metric", "qid", "tid", "d", *carry]
        if not len(qs) or not len(ts):
            return pd.DataFrame(columns=columns)
        ts = ts.sort_values("id", kind="stable")
        x, ids, out = np.stack(ts["x"].to_numpy()), ts["id"].to_numpy(), []
        take = min(k, len(ts))
        # query rows taken together, so that their gaps to all train rows stay within about 64 MB
        step = max(1, min(256, (8 << 20) // max(1, x.size)))
        for at in range(0, len(qs), step):
            part = qs.iloc[at : at + step]
            y = np.stack(part["x"].to_numpy())
            for metric in metrics:
                d = _distances(y, x, metric, p)
                # rows in order of id, so a stable sort breaks ties by id
                order = np.argsort(d, axis=1, kind="stable")[:, :take]
                rows = {"metric": metric, "qid": np.repeat(part["id"].to_numpy(), take), "tid": ids[order].ravel(), "d": np.take_along_axis(d, order, axis=1).ravel()}
                rows |= {c: np.repeat(part[c].to_numpy(), take) for c in by} | {c: ts[c].to_numpy()[order].ravel() for c in carry}
                out.append(pd.DataFrame(rows)[columns])
        return pd.concat(out)

    return q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(nearest, schema)


def _rows(df: DataFrame, ident: str, feats: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    # aliases: queries and train rows may come from one frame
    return df.select(F.col(ident).alias("id"), F.array(*[F.col(c).cast("double") for c in feats]).alias("x"), *[F.col(c).alias(c) for c in more])


def _block(n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


class Cells:
    """Train rows by their nearest pivot in one metric, with each cell's number of rows and radius.

    At most ``PIVOTS`` pivots are taken from the rows by hash, so what the driver
    holds and broadcasts is bounded. All four metrics obey the triangle
    inequality (Minkowski from p = 1 on), so a row of a cell is no nearer to a
    query than the pivot's distance less the radius.
    """

    def __init__(self, train: DataFrame, metric: str, p: float, number: int):
        self.metric, self.p, spark = metric, p, train.sparkSession
        taken = train.orderBy(F.xxhash64("id"), "id").limit(max(1, min(number, PIVOTS))).select("x").collect()
        self.pivots = np.unique(np.array([r["x"] for r in taken], float), axis=0)
        self.shared = spark.sparkContext.broadcast(self.pivots)
        self.count, self.radius = np.zeros(len(self.pivots), np.int64), np.zeros(len(self.pivots))
        names, kinds = train.columns, ", ".join(f"`{c}` {k}" for c, k in train.dtypes)

        def place(batches):
            for b in batches:
                if len(b):
                    d = self.to_pivots(np.stack(b["x"].to_numpy()))
                    cell = d.argmin(axis=1)
                    yield b.assign(cell=cell.astype(np.int32), far=d[np.arange(len(b)), cell])[[*names, "cell", "far"]]

        self.train = checkpointed(train.mapInPandas(place, f"{kinds}, cell int, far double"))
        for r in self.train.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row a pivot
            self.count[r["cell"]], self.radius[r["cell"]] = r["n"], r["far"]

    def __getstate__(self):
        return {c: getattr(self, c) for c in ("metric", "p", "shared", "count", "radius")}

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        # gaps of about 16 MB at once
        step = max(1, (2 << 20) // max(1, self.shared.value.size))
        return np.concatenate([_distances(x[i : i + step], self.shared.value, self.metric, self.p) for i in range(0, len(x), step)])

    def _first(self, d: np.ndarray, k: int) -> np.ndarray:
        """Which cells, nearest first, hold k rows for each query."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out & (self.count > 0)

    def visits(self, queries: DataFrame, k: int, bounded: bool) -> DataFrame:
        """(id, x, cell) of the cells that a query starts with; or, with its bound ``most`` known, of the others that can hold a nearer row."""

        def work(batches):
            # a query may go to every cell, so few at once
            step = max(1, (1 << 15) // max(1, len(self.count)))
            for b in (whole.iloc[at : at + step] for whole in batches for at in range(0, len(whole), step)):
                d = self.to_pivots(np.stack(b["x"].to_numpy()))
                seen = self._first(d, k)
                if bounded:
                    most = b["most"].to_numpy()[:, None]
                    # rounding of the distances must not lose a tie
                    seen = ~seen & (self.count > 0) & (d - self.radius <= most + 1e-9 * (1 + d))
                i, cell = np.nonzero(seen)
                yield pd.DataFrame({"id": b["id"].to_numpy()[i], "x": b["x"].to_numpy()[i], "cell": cell.astype(np.int32)})

        return queries.mapInPandas(work, f"id {dict(queries.dtypes)['id']}, x array<double>, cell int")

    def meet(self, visits: DataFrame, k: int, per_block: int, carry: Sequence[str]) -> DataFrame:
        """The k nearest rows of each visited cell; cells with many rows or visits are cut into pairs of blocks."""
        visits = checkpointed(visits)
        asked = np.zeros(len(self.count), np.int64)
        for r in visits.groupBy("cell").count().collect():  # a row a pivot
            asked[r["cell"]] = r["count"]
        sizes = F.array(*[F.struct(F.lit(int(max(1, -(-n // per_block)))).alias("q"), F.lit(int(max(1, -(-m // per_block)))).alias("t")) for n, m in zip(asked, self.count, strict=True)])
        of = F.get(sizes, F.col("cell"))
        split = lambda own, other: [F.pmod(F.xxhash64("id"), of[own]).cast("int").alias(f"{own}b"), F.explode(F.sequence(F.lit(0), of[other] - 1)).alias(f"{other}b")]
        q = visits.select("id", "x", "cell", *split("q", "t"))
        t = self.train.where(F.col("cell").isin([int(c) for c in np.flatnonzero(asked)])).select("id", "x", *carry, "cell", *split("t", "q"))
        return _top(q, t, ["cell", "qb", "tb"], k, (self.metric,), self.p, (), carry)

    def nearest(self, queries: DataFrame, k: int, per_block: int, carry: Sequence[str]) -> DataFrame:
        first = checkpointed(self.meet(self.visits(queries, k, False), k, per_block, carry))
        w = Window.partitionBy("qid").orderBy("d", "tid")
        kth = first.select("qid", "d", F.row_number().over(w).alias("n")).where(F.col("n") <= k).groupBy("qid").agg(F.when(F.count("*") == k, F.max("d")).otherwise(F.lit(float("inf"))).alias("most"))
        bound = queries.join(kth, queries.id == kth.qid).select("id", "x", "most")
        return first.unionByName(self.meet(self.visits(bound, k, True), k, per_block, carry))


def _open_share(q: DataFrame, t: DataFrame, k: int, metrics: Sequence[str], p: float, n: int) -> float:
    """Which share of pairs of query and train row cells would visit, by a sample; the most of all metrics."""

    def taken(df: DataFrame, m: int) -> tuple[list, np.ndarray]:
        rows = [(r["id"], v) for r in df.orderBy(F.xxhash64("id"), "id").limit(m).select("id", "x").collect() if np.isfinite(v := np.array(r["x"], float)).all()]
        return [r[0] for r in rows], np.array([r[1] for r in rows])

    (ids, x), (own, y) = taken(t, TRIED[0]), taken(q, TRIED[2])
    # a row says nothing about its neighbours by being its own
    same = np.array([[a == b for b in ids] for a in own], bool)
    if not len(y) or len(x) <= same.any():
        return 0.0
    k, shares = max(1, min(len(x) - int(same.any()), round(k * len(x) / n))), []
    near = lambda a, b, metric: np.concatenate([_distances(a[i : i + 64], b, metric, p) for i in range(0, len(a), 64)])
    for metric in metrics:
        d = near(x, x[: TRIED[1]], metric)
        cell = d.argmin(axis=1)
        count, radius = np.bincount(cell, minlength=d.shape[1]), np.zeros(d.shape[1])
        np.maximum.at(radius, cell, d[np.arange(len(x)), cell])
        most = np.partition(np.where(same, np.inf, near(y, x, metric)), k - 1, axis=1)[:, k - 1]
        shares.append(((near(y, x[: TRIED[1]], metric) - radius <= most[:, None]) @ count).mean() / len(x))
    return float(max(shares))


def _largest(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows of all groups, and of the largest."""
    r = df.groupBy(*by).count().agg(F.sum("count"), F.max("count")).first()
    return (r[0] or 0, r[1] or 0)


def knn_join(queries: DataFrame, train: DataFrame, ident: str, feats: Sequence[str], k: int, metrics: Sequence[str] = ("euclidean",), p: float = 3.0, by: Sequence[str] = (), per_block: int = 5000, carry: Sequence[str] = ()) -> DataFrame:
    """(by.., metric, qid, tid, d, rank, carry..): the k nearest train rows of each query, ties by train id.

    More than ``per_block`` train rows are dealt into cells around pivots. A
    query first meets the cells nearest to it that hold k rows; its k-th
    distance there bounds what it can miss, and it goes only to those other
    cells that the triangle inequality leaves open. Where a sample tells that
    cells leave out little, as in many columns without structure, and with
    ``by`` (a trial), where only rows of the same group meet, all pairs are
    gone through in blocks (``dense``). Groups of up to ``per_block`` rows are
    one pair of blocks each. ``ident`` is a key, with ``by`` within a group.
    """
    (nq, mq), (nt, mt) = _largest(queries, by), _largest(train, by)
    q, t = _rows(queries, ident, feats, by), _rows(train, ident, feats, [*by, *carry])
    if mt > per_block and (p >= 1 or "minkowski" not in metrics):
        if by or _open_share(q, t, k, metrics, p, nt) > OPEN:
            return dense_nearest(q, t, k, metrics, p, by, carry, len(feats), nq)
        q, found = checkpointed(q), None
        for metric in metrics:
            part = Cells(t, metric, p, -(-nt * 8 // per_block)).nearest(q, k, per_block, carry)
            found = part if found is None else found.unionByName(part)
    else:
        bq, bt = max(1, -(-mq // per_block)), max(1, -(-mt // per_block))
        q = q.withColumns({"qb": _block(bq), "tb": F.explode(F.sequence(F.lit(0), F.lit(bt - 1)))})
        t = t.withColumns({"tb": _block(bt), "qb": F.explode(F.sequence(F.lit(0), F.lit(bq - 1)))})
        found = _top(q, t, [*by, "qb", "tb"], k, metrics, p, by, carry)
    w = Window.partitionBy(*by, "metric", "qid").orderBy("d", "tid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_regress(queries: DataFrame, train: DataFrame, ident: str, feats: Sequence[str], y: str, k: int, metric: str = "euclidean", p: float = 3.0) -> DataFrame:
    """(qid, pred): the mean target of the k nearest."""
    return knn_join(queries, train, ident, feats, k, (metric,), p, carry=(y,)).groupBy("qid").agg(F.avg(y).alias("pred"))


def knn_k_sweep(queries: DataFrame, train: DataFrame, ident: str, feats: Sequence[str], y: str, ks: Sequence[int], metric: str = "euclidean") -> DataFrame:
    return k_sweep_running_mean(knn_join(queries, train, ident, feats, max(ks), (metric,), carry=(y,)), y, ks)


def knn_metric_sweep(queries: DataFrame, train: DataFrame, ident: str, feats: Sequence[str], y: str, metrics: Sequence[str], ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by.., metric, k, qid, pred): all distances of a pair of blocks in one pass."""
    return k_sweep_running_mean(knn_join(queries, train, ident, feats, max(ks), metrics, by=by, carry=(y,)), y, ks, [*by, "metric"])


def votes(neighbours: DataFrame, label: str, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by.., qid, k, pred): most frequent label among the first k, the smallest of equals."""
    keys = [*by, "qid", "k"]
    n = neighbours.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k").groupBy(*keys, label).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("__n"), label)
    return n.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*keys, F.col(label).alias("pred"))


def knn_classify(queries: DataFrame, train: DataFrame, ident: str, feats: Sequence[str], label: str, k: int, metric: str = "euclidean") -> DataFrame:
    return votes(knn_join(queries, train, ident, feats, k, (metric,), carry=(label,)), label, [k]).drop("k")


def membership(df: DataFrame, ident: str, trials: int, take: int) -> DataFrame:
    """Adds ``bits``: a packed bit a trial, set where the row is among the trial's ``take`` of least hash."""
    hashed = df.withColumn("__h", trial_hashes(trials, F.col(ident)))
    last = thresholds(hashed, F.col("__h"), [(t, take) for t in range(trials)])[0]
    kept = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                bits = np.packbits(h <= last, axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([r.tobytes() for r in bits], pa.binary())], [*b.schema.names[:-1], "bits"])

    return hashed.mapInArrow(pack, f"{kept}, bits binary")


def knn_grid_accuracy(df: DataFrame, ident: str, feats: Sequence[str], label: str, trials: int, ks: Sequence[int], metrics: Sequence[str], p_train: float = 0.75) -> DataFrame:
    """(metric, k, accuracy) over repeated splits, the mean over trials; ``ident`` is a key, rows without a label are left out.

    A row's part in all trials is a packed bitmap. Distances do not depend on
    the trial, so each row's neighbours are searched once, among all rows; in a
    trial its train neighbours are those whose bit is set, and votes are counted
    over all trials by products of bit matrices. A row that finds fewer than the
    largest k in some trial is searched again with twice as many neighbours.
    """
    df = df.where(F.col(label).isNotNull())
    n, most = df.count(), max(ks)
    take = round(n * p_train)
    rows = checkpointed(membership(df.select(ident, F.col(label).alias("__y"), *feats), ident, trials, take))
    truth = rows.select(F.col(ident).alias("qid"), F.col("__y").alias("y"), F.col("bits").alias("own"))
    wanted, asked, total = math.ceil(most / max(p_train, 1e-9)) + 3 * most + 16, rows, None

    def votes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            # lists become Python objects few at a time
            slices = (b.slice(at, 256) for at in range(0, b.num_rows, 256))
            for metric, qid, y, own, near in (r for s in slices for r in zip(*(s.column(i).to_pylist() for i in range(5)), strict=True)):
                tested = np.unpackbits(np.frombuffer(own, np.uint8), count=trials) == 0
                bits = np.stack([np.unpackbits(np.frombuffer(z["bits"], np.uint8), count=trials) for z in near])[:, tested]
                rank = np.cumsum(bits, axis=0, dtype=np.int32)
                if len(near) < n - 1 and bits.shape[1] and rank[-1].min() < most:
                    out.append((metric, qid, 0, 0, True))
                    continue
                names, code = np.unique(np.array([z["__y"] for z in near]), return_inverse=True)
                each = (np.arange(len(names))[:, None] == code).astype(np.float32)
                for k in ks:
                    # the least of equally frequent labels comes first
                    best = names[(each @ ((rank <= k) & (bits == 1))).argmax(axis=0)]
                    out.append((metric, qid, k, int((best == y).sum()), False))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), b.schema.field(1).type, pa.int32(), pa.int64(), pa.bool_()))], ["metric", "qid", "k", "right", "open"])

    kind = dict(truth.dtypes)["qid"]
    while True:
        # a row is its own nearest
        near = knn_join(asked, rows, ident, feats, min(wanted, n - 1) + 1, metrics, carry=("__y", "bits")).where("qid != tid")
        lists = near.groupBy("metric", "qid").agg(F.array_sort(F.collect_list(F.struct("rank", "__y", "bits"))).alias("near"))
        lists = lists.join(truth, "qid").select("metric", "qid", "y", "own", "near")
        got = checkpointed(lists.mapInArrow(votes_of, f"metric string, qid {kind}, k int, right long, open boolean"))
        part = got.where("not open")
        if total is not None:
            part = part.join(still, ["metric", "qid"], "left_semi")
        total = part if total is None else total.unionByName(part)
        still = got.where("open").select("metric", "qid") if wanted < n - 1 else None
        if still is None or not still.limit(1).count():
            break
        asked = rows.join(still.select(F.col("qid").alias(ident)).distinct(), ident, "left_semi")
        wanted *= 2
    return total.groupBy("metric", "k").agg((F.sum("right") / F.lit(trials * (n - take))).alias("accuracy"))
