"""k-means over keyed restarts, cuts of merge trees, cluster summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import agglomerate, single_link_cut, single_link_forest
from .ranking import checkpointed, distributed_rank, forget
from .selection import hash60

__all__ = ["agglomerate", "single_link_cut", "single_link_forest"]


def _vector(feats: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in feats])


def kmeans_assign(df: DataFrame, centroids: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Adds cluster and d2: the nearest centroid (cluster, center array), the lowest number of equals."""
    k = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("__k"))
    x = _vector(feats)
    d2 = F.transform("__k", lambda c: F.struct(F.aggregate(F.zip_with(c["center"], x, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("d2"), c["cluster"].alias("cluster")))
    out = df.crossJoin(F.broadcast(k)).withColumn("__b", F.array_min(d2))
    return out.withColumns({"cluster": F.col("__b.cluster"), "d2": F.col("__b.d2")}).drop("__k", "__b")


def kmeans_step(df: DataFrame, centroids: DataFrame, feats: Sequence[str]) -> DataFrame:
    """(cluster, center): the means of the clusters; an empty one keeps its center."""
    means = kmeans_assign(df, centroids, feats).groupBy("cluster").agg(F.array(*[F.avg(c) for c in feats]).alias("__m"))
    return centroids.join(F.broadcast(means), "cluster", "left").select("cluster", F.coalesce("__m", "center").alias("center"))


def kmeans_wcss(df: DataFrame, centroids: DataFrame, feats: Sequence[str]) -> DataFrame:
    return kmeans_assign(df, centroids, feats).agg(F.sum("d2").alias("wcss"))


def _packed(df: DataFrame, ident: str, feats: Sequence[str]) -> DataFrame:
    """(id, x), kept once for all rounds."""
    return checkpointed(df.select(F.col(ident).alias("id"), _vector(feats).alias("x")))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _starts(rows: DataFrame, k: int, seeds: Sequence[int]) -> dict[int, np.ndarray]:
    """The k rows of least hash for each seed, in one pass: a task keeps its own k, of which the k least stay."""
    hashed = rows.select("id", "x", F.array(*[hash60(s, F.col("id")) for s in seeds]).alias("h"))
    kind = dict(rows.dtypes)["id"]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [None] * len(seeds)
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for i in range(len(seeds)):
                some = pa.table({"seed": np.full(b.num_rows, i, np.int32), "h": h[:, i], "id": b.column(0), "x": b.column(1)})
                some = pa.concat_tables([held[i], some]) if held[i] is not None else some
                held[i] = some.sort_by([("h", "ascending"), ("id", "ascending")]).slice(0, k).combine_chunks()
        for t in held:
            if t is not None:
                yield from t.to_batches()

    w = Window.partitionBy("seed").orderBy("h", "id")
    found = hashed.mapInArrow(least, f"seed int, h long, id {kind}, x array<double>").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    # k rows a seed
    out: dict[int, list] = {s: [] for s in seeds}
    for r in found.orderBy("seed", "n").select("seed", "x").collect():
        out[list(seeds)[r["seed"]]].append(r["x"])
    return {s: np.array(x, float) for s, x in out.items()}


def _lloyd(rows: DataFrame, starts: dict, max_iter: int) -> tuple[dict, dict]:
    """Lloyd's rounds of all runs at once: each round is one pass over the kept rows with k x (d + 2) sums a run and task.

    (centers, wcss) by run. A run ends when its centers stay, and is left out from then on.
    """
    spark, x = rows.sparkSession, rows.select("x")
    centers, open_, cost = dict(starts), set(starts), {s: 0.0 for s in starts}
    for _ in range(max_iter + 1):
        runs = sorted(open_, key=str)
        shared = spark.sparkContext.broadcast([centers[s] for s in runs])

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((len(c), c.shape[1] + 2)) for c in shared.value]
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    p = _matrix(b.slice(at, 4096))
                    for c, part in zip(shared.value, sums, strict=True):
                        d2 = np.empty((len(p), len(c)))
                        for i, q in enumerate(c):
                            gap = p - q
                            d2[:, i] = np.einsum("ij,ij->i", gap, gap)
                        near = d2.argmin(axis=1)
                        one = np.zeros((len(c), len(p)))
                        one[near, np.arange(len(p))] = 1
                        part[:, 0] += one.sum(axis=1)
                        part[:, 1] += one @ d2[np.arange(len(p)), near]
                        part[:, 2:] += one @ p
            flat = np.concatenate([s.ravel() for s in sums])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "s"])

        total = np.zeros(sum(centers[s].size + 2 * len(centers[s]) for s in runs))
        got = x.mapInArrow(work, "place long, s double").groupBy("place").agg(F.sum("s").alias("s")).toArrow()
        total[got["place"].to_numpy()] = got["s"].to_numpy()
        at = 0
        for s in runs:
            c = centers[s]
            m = total[at : at + c.size + 2 * len(c)].reshape(len(c), -1)
            at += m.size
            used = m[:, 0] > 0
            new = c.copy()
            new[used] = m[used, 2:] / m[used, :1]
            cost[s], centers[s] = float(m[:, 1].sum()), new
            if np.abs(new - c).max(initial=0) < 1e-12:
                open_.discard(s)
        if not open_:
            break
    return centers, cost


def centroid_table(spark, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "cluster int, center array<double>")


def kmeans_fit(df: DataFrame, feats: Sequence[str], k: int, max_iter: int = 100, seed: int = 0, init: np.ndarray | None = None, ident: str = "id") -> tuple[DataFrame, DataFrame, float]:
    """(rows with cluster and d2, centroids, wcss) from k rows of least hash or a given start."""
    rows = _packed(df, ident, feats)
    start = {seed: np.asarray(init, float)} if init is not None else _starts(rows, k, [seed])
    centers, cost = _lloyd(rows, start, max_iter)
    forget(rows)
    table = centroid_table(df.sparkSession, centers[seed])
    return kmeans_assign(df, table, feats), table, float(cost[seed])


def kmeans_best_of_restarts(df: DataFrame, feats: Sequence[str], k: int, restarts: int = 20, ident: str = "id", max_iter: int = 100) -> tuple[DataFrame, float]:
    """(centroids, wcss) of the best of several starts, which run together."""
    rows = _packed(df, ident, feats)
    centers, cost = _lloyd(rows, _starts(rows, k, range(restarts)), max_iter)
    forget(rows)
    best = min(cost, key=lambda s: (cost[s], s))
    return centroid_table(df.sparkSession, centers[best]), float(cost[best])


def kmeans_k_sweep(df: DataFrame, feats: Sequence[str], ks: Sequence[int], restarts: int = 20, ident: str = "id", max_iter: int = 100) -> DataFrame:
    """(k, wcss): the best of the restarts for each k; all runs share each pass."""
    rows = _packed(df, ident, feats)
    starts = {f"{k}:{s}": c[:k] for s, c in _starts(rows, max(ks), range(restarts)).items() for k in ks}
    cost = _lloyd(rows, starts, max_iter)[1]
    forget(rows)
    best = {k: min(v for r, v in cost.items() if r.startswith(f"{k}:")) for k in ks}
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in best.items()], "k int, wcss double")


def kmeans_ml(df: DataFrame, feats: Sequence[str], k: int, seed: int = 0, max_iter: int = 100) -> DataFrame:
    """The same by Spark ML, which picks its own start: adds cluster."""
    rows = df.withColumn("__v", array_to_vector(_vector(feats)))
    model = KMeans(k=k, seed=seed, initMode="random", tol=0.0, maxIter=max_iter, featuresCol="__v", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("__v")


def kmeans_adjacency(edges: DataFrame, k: int, seed: int = 0, max_iter: int = 100) -> DataFrame:
    """(src, cluster): Lloyd's rounds on the rows of a weighted adjacency matrix, which stays a list of edges (src, dst, w).

    Repeated edges add up. Centres are sparse too, (cluster, dst, v); a row's
    products with all of them are a join by dst and a sum by src, and with the
    squared lengths give its distances. Starts are the k nodes of least hash,
    distances equal to nine places go to the lowest cluster, and an empty
    cluster keeps its centre. k lengths and counts come to the driver in a round.
    """
    e = checkpointed(edges.groupBy("src", "dst").agg(F.sum(F.col("w").cast("double")).alias("w")))
    own = checkpointed(e.groupBy("src").agg(F.sum(F.col("w") * F.col("w")).alias("xx")))
    first = [r["src"] for r in own.orderBy(hash60(seed, F.col("src")), "src").limit(k).select("src").collect()]
    at = F.array_position(F.array(*[F.lit(v) for v in first]), F.col("src")) - 1
    centers = checkpointed(e.where(F.col("src").isin(first)).select(at.cast("int").alias("cluster"), "dst", F.col("w").alias("v")))
    before, kept = None, []
    for _ in range(max_iter + 1):
        lengths = {r["cluster"]: r["cc"] for r in centers.groupBy("cluster").agg(F.sum(F.col("v") * F.col("v")).alias("cc")).collect()}
        dots = e.join(centers, "dst").groupBy("src", "cluster").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
        dots = dots.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "dot"))).alias("dots"))
        gap = F.array(*[F.struct(F.round(F.col("xx") + lengths.get(c, 0.0) - 2 * F.coalesce(F.element_at("dots", c), F.lit(0.0)), 9).alias("d2"), F.lit(c).alias("cluster")) for c in range(len(first))])
        after = checkpointed(own.join(dots, "src", "left").select("src", F.array_min(gap)["cluster"].alias("cluster")))
        kept.append(after)
        if before is not None and not after.join(before.withColumnRenamed("cluster", "was"), "src").where("cluster != was").limit(1).count():
            break
        counts = {r["cluster"]: r["count"] for r in after.groupBy("cluster").count().collect()}
        size = F.element_at(F.create_map(*[F.lit(v) for c in counts.items() for v in c]), F.col("cluster"))
        new = e.join(after, "src").groupBy("cluster", "dst").agg(F.sum("w").alias("v")).withColumn("v", F.col("v") / size)
        moved = checkpointed(new.unionByName(centers.where(~F.col("cluster").isin(list(counts)))))
        forget(centers)
        before, centers = after, moved
    forget(e, own, centers, *kept[:-1])
    return after


def cluster_members(df: DataFrame, cluster: str, ident: str, most: int = 1_000_000) -> DataFrame:
    """Sorted members and size of each cluster in a row; clusters of more than ``most`` members are an error before any is gathered."""
    largest = df.groupBy(cluster).count().agg(F.max("count")).head()[0] or 0
    if largest > most:
        raise ValueError(f"a cluster has {largest} members; take cluster_places")
    return df.groupBy(cluster).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(ident)).alias("members"))


def cluster_places(df: DataFrame, cluster: str, ident: str) -> DataFrame:
    """The same in long form for clusters of any size: (cluster, id, place), places from 1 on; ids are a key."""
    ranked = distributed_rank(df.select(cluster, ident), [cluster, ident], "__r")
    first = ranked.groupBy(F.col(cluster).alias("__c")).agg((F.min("__r") - 1).alias("__before"))
    return ranked.join(first, F.col(cluster).eqNullSafe(F.col("__c"))).select(cluster, ident, (F.col("__r") - F.col("__before")).alias("place"))


def cut_labels(merges: DataFrame, by: str, ks: Sequence[int]) -> DataFrame:
    """(by, k, i, root): the cluster of the i-th row of each dataset when k are left."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        m, out = len(pdf) + 1, []
        for k in ks:
            parent = list(range(2 * m))
            for r in pdf.head(max(0, m - k)).itertuples():
                parent[r.a] = parent[r.b] = m + r.step
            for i in range(m):
                p = i
                while parent[p] != p:
                    p = parent[p]
                out.append((pdf[by].iloc[0], k, i, p))
        return pd.DataFrame(out, columns=[by, "k", "i", "root"])

    return merges.groupBy(by).applyInPandas(cut, f"{by} {dict(merges.dtypes)[by]}, k int, i int, root int")


def cut_wcss(labelled: DataFrame, feats: Sequence[str], by: Sequence[str] = ("k",), cluster: str = "root") -> DataFrame:
    """(by.., wcss) from a long table of (k, cluster, row)."""
    per = labelled.groupBy(*by, cluster).agg(*[(F.var_pop(c) * F.count("*")).alias(c) for c in feats])
    return per.groupBy(*by).agg(F.sum(sum((F.col(c) for c in feats[1:]), F.col(feats[0]))).alias("wcss"))


def elbow_k(wcss: DataFrame) -> DataFrame:
    """The k furthest from the chord between the first and last (k, wcss); the first of equals."""
    ends = wcss.agg(F.min_by("wcss", "k").alias("w0"), F.max_by("wcss", "k").alias("w1"), F.min("k").alias("k0"), F.max("k").alias("k1"))
    dx, dy = F.col("k1") - F.col("k0"), F.col("w1") - F.col("w0")
    far = F.abs(dy * (F.col("k") - F.col("k0")) - dx * (F.col("wcss") - F.col("w0"))) / F.sqrt(dx * dx + dy * dy)
    return wcss.crossJoin(F.broadcast(ends)).withColumn("distance", far).agg(F.min_by("k", F.struct(-F.round("distance", 9), F.col("k"))).alias("k"))


def cluster_labels(df: DataFrame, root: str) -> DataFrame:
    """Adds label: 0-based numbers in the order of root ids; a row per root is ordered, in many tasks."""
    roots = distributed_rank(df.select(root).distinct(), [root], "label").withColumn("label", (F.col("label") - 1).cast("int"))
    return df.join(roots, root)


def purity(df: DataFrame, pred: str, truth: str) -> DataFrame:
    c = df.groupBy(pred, truth).agg(F.count("*").alias("c")).groupBy(pred).agg(F.max("c").alias("most"), F.sum("c").alias("all"))
    return c.agg((F.sum("most") / F.sum("all")).alias("purity"))
