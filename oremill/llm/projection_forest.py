"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue.

Equal vectors are one class, indexed once, with its ``k + 1`` least ids: no list
can show more of them. A tree splits a node's vectors (of length 1) at the
median of their projections on the line through two of them, drawn at random.
Trees grow in blocks of at most ``LEVELS`` levels. The first block is fitted to
a sample of ``SAMPLE`` classes on the driver and broadcast, which bounds both.
Where leaves of about ``LEAF`` classes need more levels, each cell of a block is
fitted anew, in a task of its own, to about ``SAMPLE`` of its classes; fitted
cells stay in a table, and what passes through one is dealt by hash.

A query goes through one queue for all trees: the entry of the least penalty is
taken, followed to its leaf, and each branch not taken is entered with the
penalty plus the squared distance to the split. How many leaves a query takes is
measured, not guessed: the exact neighbours of ``PROBES`` queries are found in
one pass over all classes, and the budget is the least number of leaves with
which ``GOAL`` of them are met. Vectors then travel to the leaves once a tree,
queries once a visit. Leaves are compared by matrix products, and whatever may
be among the best is ranked by its exact cosine, added up in a fixed order in
double precision. A query's own class is added without any search.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, neither do rows with a null id and vectors of another
length than most of the sample have; a row is known by its id, so equal rows are
one, an id's other vectors are no candidates of its own, and an id with several
vectors counts with the nearest; ties come by ascending id; fewer candidates
than ``k`` are all returned; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import column, spread, spread_out
from .repeats import first_of
from .tables import cut, fanout, labelled

K, TREES, LEAF, LEVELS, SAMPLE = 5, 6, 128, 10, 20_000
PROBES, GOAL, MOST = 128, 0.98, 1024
#: Rows of a cell that a task routes at once.
ROUTED = 1 << 16
#: Results that a task holds before it thins them out.
HELD = 1 << 18


@dataclass
class Tree:
    """A full tree: node i has the children 2i + 1 and 2i + 2."""

    normals: np.ndarray
    cuts: np.ndarray

    @property
    def inner(self) -> int:
        return len(self.cuts)

    def leaves(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Leaf of each row; a row right on a split takes a side by its id."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.inner.bit_length()):
            gap = np.einsum("ij,ij->i", x, self.normals[node]) - self.cuts[node]
            side = spread(ids.astype(np.uint64) + node.astype(np.uint64)) & np.uint64(1) == 1
            node = 2 * node + 1 + np.where(gap == 0, side, gap > 0)
        return node - self.inner


def grown(x: np.ndarray, levels: int, seed: int) -> Tree:
    """A tree of ``levels`` levels on the rows of ``x``."""
    rng, inner = np.random.default_rng(seed), (1 << levels) - 1
    normals, cuts = np.zeros((inner, x.shape[1])), np.zeros(inner)
    members = {0: np.arange(len(x))}
    for node in range(inner):
        own = members.pop(node)
        normal = np.zeros(x.shape[1])
        if len(own) > 1:
            normal = np.subtract(*x[rng.choice(own, 2, replace=False)])
        if not normal.any():
            normal = rng.normal(size=x.shape[1])
        normals[node] = normal / np.sqrt(normal @ normal)
        at = x[own] @ normals[node]
        cuts[node] = np.median(at) if len(own) else 0
        # equal projections are halved too
        order = np.argsort(at, kind="stable")
        members[2 * node + 1], members[2 * node + 2] = own[order[: len(own) // 2]], own[order[len(own) // 2 :]]
    return Tree(normals, cuts)


def walk(margins: list[list[float]], inner: int, limit: int, penalty: float = 0.0) -> list[tuple[float, int, int]]:
    """(penalty, tree, leaf) of the first ``limit`` leaves that the trees' shared queue gives; margins: a tree's distances to its splits."""
    queue, out = [(penalty, tree, 0) for tree in range(len(margins))], []
    while queue and len(out) < limit:
        penalty, tree, node = heapq.heappop(queue)
        while node < inner:
            gap = margins[tree][node]
            near = 2 * node + 1 + (gap > 0)
            heapq.heappush(queue, (penalty + gap * gap, tree, 4 * node + 3 - near))
            node = near
        out.append((penalty, tree, node - inner))
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles, times a power of two so that no square overflows; exact."""
    x = x.astype(float)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, added up in the order of components whatever the number of rows."""
    out = np.zeros(len(x))
    for c in range(x.shape[1]):
        out += x[:, c] * y[:, c]
    return out


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return dots(x, y) / (np.sqrt(dots(x, x)) * np.sqrt(dots(y, y)))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def doubles(batch: pa.RecordBatch, kind: str) -> np.ndarray:
    """The ``vec`` column as rows of doubles, scaled."""
    vecs = column(batch, "vec")
    return scaled(np.frombuffer(b"".join(v.as_buffer() for v in vecs), kind).reshape(len(vecs), -1))


def numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [column(batch, c).to_numpy(zero_copy_only=False) for c in names]


def members(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, same (a digest), vec of all usable rows."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # adding 0 makes -0 and 0 one
            vecs = [(x.astype(kind) + 0).tobytes() for x in column(batch, "v").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array(vecs, pa.binary())], ["vec_id", "vec"])

    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    return rows.mapInArrow(pack, "vec_id long, vec binary").select("vec_id", F.unhex(F.md5("vec")).alias("same"), "vec")


def best_of(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k best (score, vec_id) of each ``key`` as an array ``near`` of (s = -score, vec_id), an id once."""
    once = rows.repartition(key).groupBy(key, "vec_id").agg(F.max("score").alias("score"))
    return once.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("near"))


@dataclass
class Forest:
    kind: str  # of a stored component
    trees: list[Tree]
    levels: list[int]  # of each block
    cells: list[DataFrame]  # fitted cells of the blocks after the first: place, normals, cuts
    rows: int  # classes in all

    def places(self, classes: DataFrame, vec: bool) -> DataFrame:
        """(place, rep, vec, ids) of each class in each tree: place is the tree's number with the path after it."""
        forest = classes.sparkSession.sparkContext.broadcast((self.trees, self.kind))
        kept, top = ["rep", "vec", "ids"], self.levels[0]

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, kind = forest.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, (rep,) = unit(doubles(batch, kind)), numbers(batch, "rep")
                for t, tree in enumerate(trees):
                    place = (t + 1 << top) + tree.leaves(x, rep)
                    yield pa.RecordBatch.from_arrays([pa.array(place), *(column(batch, c) for c in kept)], ["place", *kept])

        out = classes.select(*kept).mapInArrow(route, "place long, rep long, vec binary, ids array<long>")
        for level, fitted in zip(self.levels[1:], self.cells, strict=True):
            out = self.through(out, fitted, self.routed(level), "place long, rep long, vec binary, ids array<long>")
        return out if vec else out.select("place", "rep")

    def routed(self, level: int):
        kind = self.kind

        def f(rows: pa.Table, tree: Tree) -> pa.Table:
            batch = rows.combine_chunks().to_batches()[0]
            place, rep = numbers(batch, "place", "rep")
            leaf = tree.leaves(unit(doubles(batch, kind)), rep)
            return pa.table({"place": (place << level) + leaf, **{c: rows[c] for c in ("rep", "vec", "ids")}})

        return f

    def through(self, rows: DataFrame, fitted: DataFrame, f, schema: str) -> DataFrame:
        """``f(rows of a cell, its tree)``; a cell's rows are dealt into pieces of about ROUTED, each with the fitted cell."""
        salts = max(1, math.ceil(self.rows / (1 << self.levels[0]) / ROUTED))
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int"))
        each = fitted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        names = [c.split()[0] for c in schema.split(", ")]

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({n: pa.array([], t) for n, t in zip(names, types, strict=True)})
            r = right.slice(0, 1).to_pylist()[0]
            cuts = np.frombuffer(r["cuts"], "<f8")
            return f(left, Tree(np.frombuffer(r["normals"], "<f8").reshape(len(cuts), -1), cuts)).select(names)

        types = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[c.split()[1]] for c in schema.split(", ")]
        return salted.groupBy("place", "__salt").cogroup(each.groupBy("place", "__salt")).applyInArrow(work, schema)

    def visits(self, queries: DataFrame, limit: int) -> DataFrame:
        """(place, rep, vec, position): the first ``limit`` leaves of each query in the shared queue's order."""
        forest = queries.sparkSession.sparkContext.broadcast((self.trees, self.kind))
        schema, own, top = "place long, rep long, vec binary, penalty double, position int", self.kind, self.levels[0]

        def listed(batch: pa.RecordBatch, found: list[list[tuple]], place) -> pa.Table:
            n = np.array([len(f) for f in found])
            flat = [v for f in found for v in f]
            at = pa.array(np.repeat(np.arange(len(found)), n))
            penalty, tree, leaf = (np.array([v[i] for v in flat]) for i in range(3))
            return pa.table({"place": place(np.repeat(np.arange(len(found)), n), tree.astype(np.int64), leaf.astype(np.int64)), "rep": column(batch, "rep").take(at), "vec": column(batch, "vec").take(at), "penalty": penalty.astype(float), "position": spread_out(np.ones(len(n), np.int64), n).astype(np.int32)})

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, kind = forest.value
            for whole in batches:
                for lo in range(0, whole.num_rows, 256):
                    batch = whole.slice(lo, 256)
                    x = unit(doubles(batch, kind))
                    margins = [(x @ t.normals.T - t.cuts).tolist() for t in trees]
                    found = [walk([m[i] for m in margins], trees[0].inner, limit) for i in range(len(x))]
                    yield from listed(batch, found, lambda i, tree, leaf: (tree + 1 << top) + leaf).to_batches()

        def deeper(level: int):
            def f(rows: pa.Table, tree: Tree) -> pa.Table:
                batch = rows.combine_chunks().to_batches()[0]
                margins = (unit(doubles(batch, own)) @ tree.normals.T - tree.cuts).tolist()
                place, penalty = numbers(batch, "place", "penalty")
                found = [walk([m], tree.inner, limit, p) for m, p in zip(margins, penalty.tolist(), strict=True)]
                return listed(batch, found, lambda i, _, leaf: (place[i] << level) + leaf)

            return f

        first = Window.partitionBy("rep").orderBy("penalty", "place")
        out = queries.select("rep", "vec").mapInArrow(search, schema)
        for level, fitted in zip(self.levels[1:], self.cells, strict=True):
            out = self.through(out, fitted, deeper(level), schema)
            out = out.withColumn("position", F.row_number().over(first)).where(F.col("position") <= limit)
        return out.drop("penalty")


def fitted(level: int, kind: str):
    """A tree of ``level`` levels on the rows of a cell."""

    def fit(cell: pa.Table) -> pa.Table:
        batch = cell.combine_chunks().to_batches()[0]
        place = int(numbers(batch, "place")[0][0])
        tree = grown(unit(doubles(batch, kind)), level, place)
        return pa.table({"place": [place], "normals": [tree.normals.tobytes()], "cuts": [tree.cuts.tobytes()]})

    return fit


def planted(classes: DataFrame, kind: str, size: int, trees: int, leaf: int, most: int, sample: np.ndarray) -> Forest:
    """A forest for all ``classes``, its first block fitted to ``sample``, rows of length 1."""
    rows = classes.count()
    depth = max(0, math.ceil(math.log2(max(rows, 1) / leaf)))
    levels = [min(most, depth)]
    while sum(levels) < depth:
        levels.append(min(most, depth - sum(levels)))
    # a tree without a split is the whole table
    forest = Forest(kind, [grown(sample, levels[0], t) for t in range(trees if depth else 1)], levels[:1], [], rows)
    for k, level in enumerate(levels[1:]):
        share = min(1.0, SAMPLE * (1 << sum(levels[: k + 1])) / max(rows, 1))
        picked = forest.places(classes, True).where(F.pmod(F.xxhash64("vec", F.lit(k)), F.lit(1 << 30)) < int(share * (1 << 30)))
        cells = cut(picked.groupBy("place").applyInArrow(fitted(level, kind), "place long, normals binary, cuts binary"))
        forest = Forest(kind, forest.trees, levels[: k + 2], [*forest.cells, cells], rows)
    return forest


def exact(probes: list[tuple[int, bytes]], classes: DataFrame, kind: str, k: int) -> DataFrame:
    """(rep, near): the k nearest other classes of each probe, by one pass over all of them."""
    if not probes:
        raise ValueError("no probe")
    shared = classes.sparkSession.sparkContext.broadcast(probes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array([p[0] for p in shared.value])
        q = unit(scaled(np.stack([np.frombuffer(p[1], kind) for p in shared.value])))
        for batch in batches:
            if not batch.num_rows:
                continue
            (rep,) = numbers(batch, "rep")
            s = q @ unit(doubles(batch, kind)).T
            s[own[:, None] == rep[None, :]] = -np.inf
            top = np.argpartition(-s, min(k, len(rep)) - 1, axis=1)[:, :k]
            i = np.repeat(np.arange(len(q)), top.shape[1])
            value = s[i, top.ravel()]
            ok = value > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(own[i][ok]), pa.array(rep[top.ravel()][ok]), pa.array(value[ok])], ["rep", "vec_id", "score"])

    return best_of(classes.select("rep", "vec").mapInArrow(work, "rep long, vec_id long, score double"), "rep", k)


def budget(forest: Forest, classes: DataFrame, queries: DataFrame, k: int, goal: float) -> int:
    """The least number of leaves with which ``goal`` of the probes' exact neighbours are met (all, if MOST leaves don't do)."""
    if len(forest.trees[0].cuts) == 0:
        return 1
    probes = [(r["rep"], bytes(r["vec"])) for r in queries.orderBy(F.xxhash64("vec"), "vec").limit(PROBES).select("rep", "vec").collect()]
    near = cut(exact(probes, classes, forest.kind, k).select(F.col("rep").alias("q"), F.explode("near.vec_id").alias("rep")))
    asked = queries.join(F.broadcast(near.select(F.col("q").alias("rep")).distinct()), "rep", "left_semi")
    at = forest.places(classes, False).join(F.broadcast(near), "rep").select("q", F.col("rep").alias("wanted"), "place")
    met = at.join(forest.visits(asked, MOST).select(F.col("rep").alias("q"), "place", "position"), ["q", "place"]).groupBy("q", "wanted").agg(F.min("position").alias("position"))
    wanted = near.count()
    # at most PROBES * k rows
    found = sorted(r[0] for r in met.select("position").collect())
    need = math.ceil(goal * wanted)
    if not need:
        return 1
    return found[need - 1] if need <= len(found) else MOST


def top(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, an id once, ties by id."""
    order = np.lexsort((-score, vec_id, query))
    new = np.ones(len(order), bool)
    new[1:] = (query[order][1:] != query[order][:-1]) | (vec_id[order][1:] != vec_id[order][:-1])
    order = order[new]
    order = order[np.lexsort((vec_id[order], -score[order], query[order]))]
    order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
    return query[order], vec_id[order], score[order]


def compared(index: DataFrame, visits: DataFrame, kind: str, k: int, parts: int) -> DataFrame:
    """(rep, vec_id, score): of each task's leaves the k best members of other classes for each query that takes some of them."""
    rows = index.select("place", "rep", "vec", "ids").unionByName(visits.select("place", "rep", "vec", F.lit(None).cast("array<long>").alias("ids")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks().to_batches()[0]
        place, rep, ids = numbers(whole, "place", "rep", "ids")
        asks = column(whole, "ids").is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((rep, asks, place))
        x = doubles(whole, kind)
        begin, _ = first_of(place[order])
        found, pending = [], 0
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
            here = order[lo:hi]
            split = int(np.searchsorted(asks[here], True))
            own, q = here[:split], here[split:]
            if not len(own) or not len(q):
                continue
            y = unit(x[own])
            for at in range(0, len(q), 1024):
                some = q[at : at + 1024]
                s = unit(x[some]) @ y.T
                s[rep[some][:, None] == rep[own][None, :]] = -np.inf
                # exact cosines differ from these by far less than 1e-9
                least = np.partition(s, -min(k, len(own)), axis=1)[:, -min(k, len(own))] - 1e-9
                a, b = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                score = cosine(x[some[a]], x[own[b]])
                many = np.array([len(ids[j]) for j in own[b]], np.int64)
                a, score = np.repeat(a, many), np.repeat(score, many)
                vec_id = np.concatenate([ids[j] for j in own[b]]) if len(b) else np.zeros(0, np.int64)
                found.append(top(rep[some[a]], vec_id, score, k))
                pending += len(found[-1][0])
                if pending > HELD:
                    # a query's leaves share its k places
                    found = [top(*map(np.concatenate, zip(*found, strict=True)), k)]
                    pending = len(found[0][0])
        if found:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, top(*map(np.concatenate, zip(*found, strict=True)), k))), ["rep", "vec_id", "score"])

    return rows.repartition(parts, "place").mapInArrow(work, "rep long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = K, trees: int = TREES, leaf: int = LEAF, levels: int = LEVELS, goal: float = GOAL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found for each row of ``vectors`` that ``queries`` (over vec_id) picks, by cosine."""
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = cut(members(vectors, kind))
    ranked = rows.select("same", "vec_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("same").orderBy("vec_id")))
    ids = ranked.where(F.col("n") <= k + 1).groupBy("same").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = rows.groupBy("same").agg(F.first("vec").alias("vec")).join(ids, "same")
    # an id may have several vectors, so classes have numbers of their own, given as they are written
    classes = cut(classes.select("same", "vec", "ids", F.monotonically_increasing_id().alias("rep")))
    sample = [bytes(r[0]) for r in classes.orderBy(F.xxhash64("same"), "same").limit(SAMPLE).select("vec").collect()]
    sizes = Counter(map(len, sample))
    size = max(sizes, key=lambda n: (sizes[n], n)) if sizes else 0
    usable = classes.where(F.octet_length("vec") == size)
    asked = rows.where(queries).select("vec_id", "same").distinct()
    asked = cut(asked.join(usable.select("same", "rep"), "same").select("vec_id", "rep"))
    counts = asked.groupBy("rep").agg(F.count("*").alias("n"))
    own = cut(usable.join(counts.select("rep"), "rep", "left_semi"))
    x = unit(scaled(np.frombuffer(b"".join(v for v in sample if len(v) == size), kind).reshape(-1, max(1, size // int(kind[-1]))))) if size else np.zeros((0, 1))
    forest = planted(usable, kind, size, trees, leaf, levels, x)
    visits = forest.visits(own, budget(forest, usable, own, k, goal))
    parts = fanout(usable, 2.0 * len(forest.trees))
    found = compared(forest.places(usable, True), visits, kind, k + 1, parts)

    def itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = doubles(batch, kind)
                yield pa.RecordBatch.from_arrays([column(batch, "rep"), column(batch, "ids"), pa.array(cosine(v, v))], ["rep", "ids", "score"])

    mine = own.select("rep", "vec", "ids").mapInArrow(itself, "rep long, ids array<long>, score double").select("rep", F.explode("ids").alias("vec_id"), "score")
    best = best_of(found.unionByName(mine), "rep", k + 2).join(counts, "rep")
    listed = labelled(asked, ["rep"], cut(best), "n", asked.count())
    near = F.slice(F.filter("near", lambda z: z["vec_id"] != F.col("vec_id")), 1, k)
    out = listed.select(F.col("vec_id").alias("query_id"), F.posexplode(near).alias("rank", "z"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("z.vec_id").alias("vec_id"), (-F.col("z.s")).alias("score"))
