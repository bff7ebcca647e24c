"""Decision trees grown level by level: one job a level for all open nodes.

A node table has node_id (root 1, children 2n and 2n+1), is_leaf, value, feat,
thr, n. Rows find their node from the table, so no row is rewritten between
levels; the table is small (at most 2^depth rows) and comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import checkpointed

NODES = "node_id long, is_leaf boolean, value double, feat string, thr double, n long"


#: Bins of a feature's values, by approximate quantiles over all rows.
BINS = 256


def bin_edges(df: DataFrame, feats: Sequence[str]) -> list[list[float]]:
    """Borders between the bins of each feature, from mergeable sketches of its values: at most BINS - 1 numbers each."""
    wide = df.select(*[F.col(f).cast("double").alias(f"__{i}") for i, f in enumerate(feats)])
    found = wide.approxQuantile(wide.columns, [i / BINS for i in range(1, BINS)], 1 / (2 * BINS))
    return [sorted(set(e)) for e in found]


def _counted(df: DataFrame, feats: Sequence[str], edges: list[list[float]] | None, by: Sequence[str], keep: Sequence[str], sums: Sequence[Column]) -> DataFrame:
    """(by.., place, bin, x, sums..) of each node's distinct values of each feature, kept; place is the feature's from 0."""
    shared = df.sparkSession.sparkContext.broadcast([np.array(e, float) for e in (edges if edges is not None else bin_edges(df, feats))])

    @F.pandas_udf("int")
    def bin_of(place: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int32)
        for p, e in enumerate(shared.value):
            mine = (place == p).to_numpy()
            out[mine] = np.searchsorted(e, x.to_numpy()[mine])
        return pd.Series(out)

    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.col(f).cast("double").alias("x")) for i, f in enumerate(feats)])
    long = df.select(*by, *keep, F.explode(cells).alias("__c")).select(*by, *keep, "__c.place", "__c.x").where("x is not null")
    return checkpointed(long.groupBy(*by, "place", "x").agg(*sums).withColumn("bin", bin_of("place", "x")))


def _bins(values: DataFrame, by: Sequence[str], names: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    """(by.., place, bin, b<name>, a<name>, s<name>, next..): sums before a bin, of all the node's and of the bin; the least value after it.

    A window here orders a node's bins of a feature, which are BINS at most.
    """
    per = values.groupBy(*by, "place", "bin").agg(*[F.sum(n).alias(f"s{n}") for n in names], F.min("x").alias("low"), F.max("x").alias("high"), *more)
    w = Window.partitionBy(*by, "place").orderBy("bin")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by, "place")
    return per.withColumns({f"b{n}": F.coalesce(F.sum(f"s{n}").over(before), F.lit(0)) for n in names} | {f"a{n}": F.sum(f"s{n}").over(whole) for n in names} | {"after": F.lead("low").over(w)})


def _cuts(values: DataFrame, bins: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Each distinct value in ``bins`` with l<name> and a<name>: sums up to it and of all the node's; next: the value after it. A window orders the values of one bin."""
    key = [*by, "place", "bin"]
    w = Window.partitionBy(*key).orderBy("x")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    v = values.join(bins.select(*key, "after", *[f"{p}{n}" for p in "ba" for n in names]), key)
    return v.withColumns({f"l{n}": F.sum(n).over(run) + F.col(f"b{n}") for n in names} | {"next": F.coalesce(F.lead("x").over(w), "after")}).where("next is not null")


def _best(cuts: DataFrame, feats: Sequence[str], by: Sequence[str], gain: Column) -> DataFrame:
    """(by.., feat, thr, gain): the largest gain, ties to the first feature, then the lowest cut."""
    g = cuts.select(*by, "place", ((F.col("x") + F.col("next")) / 2).alias("thr"), gain.alias("gain"))
    w = Window.partitionBy(*by).orderBy(F.desc("gain"), "place", "thr")
    name = F.element_at(F.array(*[F.lit(f) for f in feats]), F.col("place") + 1)
    return g.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*by, name.alias("feat"), "thr", "gain")


def _fall(nl: Column, sl: Column, n: Column, s: Column) -> Column:
    """How much the squared error falls when nl of n rows with the sum sl go left; a side without rows counts as 0."""
    left, right = F.when(nl > 0, sl * sl / nl).otherwise(0.0), F.when(n - nl > 0, (s - sl) * (s - sl) / (n - nl)).otherwise(0.0)
    return left + right - s * s / n


def best_split_regression(df: DataFrame, feats: Sequence[str], y: str, min_leaf: int, by: Sequence[str] = ("node_id",), edges: list[list[float]] | None = None) -> DataFrame:
    """(by.., feat, thr, gain): the largest fall of squared error; ties to the first feature, then the lowest cut.

    Values are summed by bin. The gain is known at each border between bins.
    Within a bin it is a convex function of the rows and the sum that go left,
    so the corners of all that these can be, given the least and greatest y of
    the bin, bound it. Only bins whose bound reaches the node's best border are
    looked into, value by value.
    """
    values = _counted(df, feats, edges, by, [y], [F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s"), F.min(y).alias("lo"), F.max(y).alias("hi")])
    bins = _bins(values, by, ["n", "s"], [F.min("lo").cast("double").alias("lo"), F.max("hi").cast("double").alias("hi")])
    at = lambda n, s: _fall(F.col("bn") + n, F.col("bs") + s, F.col("an"), F.col("as"))
    n, s, lo, hi = (F.col(c) for c in ("sn", "ss", "lo", "hi"))
    # rows that go left with the greatest y first, or with the least, until the rest is all of the other kind
    few, many = F.when(hi > lo, (s - n * lo) / (hi - lo)).otherwise(n), F.when(hi > lo, (n * hi - s) / (hi - lo)).otherwise(F.lit(0.0))
    bound = F.greatest(at(F.lit(0), F.lit(0.0)), at(n, s), at(few, few * hi), at(many, many * lo))
    end = F.when(F.col("after").isNotNull() & (F.col("bn") + n >= min_leaf) & (F.col("an") - F.col("bn") - n >= min_leaf), at(n, s))
    marked = bins.withColumns({"bound": bound, "end": end}).withColumn("least", F.max("end").over(Window.partitionBy(*by)))
    open_ = marked.where((F.col("bn") + n >= min_leaf) & (F.col("an") - F.col("bn") >= min_leaf) & (F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-9 * F.abs(F.col("least")) - 1e-12)))
    c = _cuts(values, open_, by, ["n", "s"]).where((F.col("ln") >= min_leaf) & (F.col("an") - F.col("ln") >= min_leaf))
    gain = F.col("ls") * F.col("ls") / F.col("ln") + (F.col("as") - F.col("ls")) * (F.col("as") - F.col("ls")) / (F.col("an") - F.col("ln")) - F.col("as") * F.col("as") / F.col("an")
    return _best(c, feats, by, gain).where("gain > 0")


def nodes_at(nodes: pd.DataFrame, x: pd.DataFrame, depth: int | None = None) -> np.ndarray:
    """The node that each row ends in, or has reached at ``depth``."""
    table = {int(r.node_id): r for r in nodes.itertuples()}
    at = np.ones(len(x), np.int64)
    for _ in range(64 if depth is None else depth):
        moved = False
        for n in np.unique(at):
            r = table.get(int(n))
            if r is None or r.is_leaf:
                continue
            rows = at == n
            v = x[r.feat].to_numpy(float)[rows]
            at[rows] = np.where(v <= r.thr, 2 * n, 2 * n + 1)
            moved = True
        if not moved:
            break
    return at


def with_node(df: DataFrame, nodes: pd.DataFrame, feats: Sequence[str], depth: int | None = None) -> DataFrame:
    """Adds node_id: a row's node, by a vectorised walk over the broadcast node table."""
    shared = df.sparkSession.sparkContext.broadcast(nodes)

    @F.pandas_udf("long")
    def walk(x: pd.DataFrame) -> pd.Series:
        return pd.Series(nodes_at(shared.value, x, depth))

    return df.withColumn("node_id", walk(F.struct(*[F.col(f).cast("double").alias(f) for f in feats])))


def _node_rows(df: DataFrame, nodes: dict[int, dict]) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, bool(v["is_leaf"]), v["value"], v.get("feat"), v.get("thr"), int(v["n"])) for k, v in sorted(nodes.items())], NODES)


def _frame(nodes: dict[int, dict]) -> pd.DataFrame:
    return pd.DataFrame([{"node_id": k, "is_leaf": v["is_leaf"], "feat": v.get("feat"), "thr": v.get("thr")} for k, v in nodes.items()])


def tree_fit_regression(df: DataFrame, feats: Sequence[str], y: str, max_depth: int = 10, min_leaf: int = 5) -> DataFrame:
    """CART: the node table. A node is a leaf at the depth's end, with too few rows, or with no error left."""
    own = df.select(*feats, F.col(y).cast("double").alias("__y")).dropna()
    # every level reads these rows
    own = checkpointed(own)
    edges = bin_edges(own, feats)
    nodes: dict[int, dict] = {}
    opened = {1}
    for depth in range(max_depth + 1):
        at = with_node(own, _frame(nodes), feats) if nodes else own.withColumn("node_id", F.lit(1).cast("long"))
        at = at.where(F.col("node_id").isin([int(n) for n in opened]))
        sums = at.groupBy("node_id").agg(F.count("*").alias("n"), F.avg("__y").alias("value"), (F.var_pop("__y") * F.count("*")).alias("sse"))
        if depth == max_depth:
            found = {r["node_id"]: r.asDict() | {"feat": None} for r in sums.collect()}
        else:
            split = best_split_regression(at, feats, "__y", min_leaf, edges=edges)
            found = {r["node_id"]: r.asDict() for r in sums.join(split, "node_id", "left").collect()}
        opened = set()
        for k, r in found.items():
            leaf = r["feat"] is None or r["n"] < 2 * min_leaf or r["sse"] < 1e-9
            nodes[k] = {"is_leaf": leaf, "value": r["value"], "n": r["n"]} | ({} if leaf else {"feat": r["feat"], "thr": r["thr"]})
            if not leaf:
                opened |= {2 * k, 2 * k + 1}
        if not opened:
            break
    return _node_rows(df, nodes)


def tree_predict(df: DataFrame, nodes: DataFrame, feats: Sequence[str], depth: int | None = None) -> DataFrame:
    """Adds pred: the mean of a row's leaf (or of its node at ``depth``)."""
    table = nodes.toPandas()
    out = with_node(df, table, feats, depth)
    return out.join(F.broadcast(nodes.select("node_id", F.col("value").alias("pred"))), "node_id", "left").drop("node_id")


def tree_depth_sweep(df: DataFrame, feats: Sequence[str], y: str, train, depths: Sequence[int], min_leaf: int) -> DataFrame:
    """(depth, and df's columns, pred): one fit to the largest depth, read at each depth."""
    nodes = tree_fit_regression(df.where(train), feats, y, max(depths), min_leaf)
    out = None
    for d in depths:
        p = tree_predict(df.where(~train), nodes, feats, d).withColumn("depth", F.lit(d))
        out = p if out is None else out.unionByName(p)
    return out


def _entropy(counts: Sequence[str], total) -> Column:
    terms = [F.when(F.col(c) > 0, -(F.col(c) / total) * F.log2(F.col(c) / total)).otherwise(0.0) for c in counts]
    return sum(terms[1:], terms[0])


def best_split_entropy(df: DataFrame, feats: Sequence[str], label: str, by: Sequence[str] = ("node_id",), classes: Sequence | None = None, edges: list[list[float]] | None = None) -> DataFrame:
    """(by.., feat, thr, gain): information gain in bits over midpoints of neighbouring values; the first of equals.

    Class counts up to a value are those of the bins before its own and a
    window within it.
    """
    classes = classes if classes is not None else sorted(r[0] for r in df.select(label).distinct().collect())
    names = [f"c{i}" for i in range(len(classes))]
    values = _counted(df, feats, edges, by, [label], [F.count_if(F.col(label) == c).alias(n) for c, n in zip(classes, names, strict=True)])
    v = _cuts(values, _bins(values, by, names), by, names)
    v = v.withColumns({f"r{n}": F.col(f"a{n}") - F.col(f"l{n}") for n in names})
    total = lambda p: sum((F.col(p + n) for n in names[1:]), F.col(p + names[0]))
    part = lambda p: total(p) / total("a") * _entropy([p + n for n in names], total(p))
    return _best(v, feats, by, F.round(_entropy(["a" + n for n in names], total("a")) - part("l") - part("r"), 12))


def tree_fit_entropy(df: DataFrame, feats: Sequence[str], label: str, max_depth: int | None = None, min_gain: float = 0.0) -> DataFrame:
    """(node_id, is_leaf, label, feat, thr, n): binary tree on gain; a leaf has its majority, ties to the smallest."""
    # every level reads these rows
    own = checkpointed(df.select(*feats, F.col(label).alias("__y")).dropna())
    edges = bin_edges(own, feats)
    classes = sorted(r[0] for r in own.select("__y").distinct().collect())
    nodes: dict[int, dict] = {}
    opened, depth = {1}, 0
    while opened:
        if depth > 61:
            raise ValueError("a tree of more than 61 levels: set max_depth or min_gain")
        at = with_node(own, _frame(nodes), feats) if nodes else own.withColumn("node_id", F.lit(1).cast("long"))
        at = at.where(F.col("node_id").isin([int(n) for n in opened]))
        counts = at.groupBy("node_id", "__y").agg(F.count("*").alias("c"))
        per = counts.groupBy("node_id").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.min_by("__y", F.struct(-F.col("c"), F.col("__y"))).alias("label"))
        rows = per.join(best_split_entropy(at, feats, "__y", classes=classes, edges=edges), "node_id", "left").collect()
        opened = set()
        for r in rows:
            leaf = r["kinds"] == 1 or r["feat"] is None or r["gain"] <= min_gain or (max_depth is not None and depth >= max_depth)
            nodes[r["node_id"]] = {"is_leaf": leaf, "label": r["label"], "n": r["n"], "feat": None if leaf else r["feat"], "thr": None if leaf else r["thr"]}
            if not leaf:
                opened |= {2 * r["node_id"], 2 * r["node_id"] + 1}
        depth += 1
    kind = dict(df.dtypes)[label]
    return df.sparkSession.createDataFrame([(k, v["is_leaf"], v["label"], v["feat"], v["thr"], v["n"]) for k, v in sorted(nodes.items())], f"node_id long, is_leaf boolean, label {kind}, feat string, thr double, n long")


def tree_classify(df: DataFrame, nodes: DataFrame, feats: Sequence[str]) -> DataFrame:
    out = with_node(df, nodes.toPandas(), feats)
    return out.join(F.broadcast(nodes.select("node_id", F.col("label").alias("pred"))), "node_id", "left").drop("node_id")


def id3_gain(df: DataFrame, attrs: Sequence[str], label: str, by: Sequence[str] = ("path",)) -> DataFrame:
    """(by.., attr, entropy, gain) of each categorical attribute, in bits."""
    c = df.unpivot([*by, label], list(attrs), "attr", "value").groupBy(*by, "attr", "value", label).agg(F.count("*").alias("c"))
    bits = lambda n, t: -(n / t) * F.log2(n / t)
    inner = c.withColumn("t", F.sum("c").over(Window.partitionBy(*by, "attr", "value"))).groupBy(*by, "attr").agg(F.sum(F.col("t") * bits(F.col("c"), F.col("t"))).alias("__w"), F.sum("c").alias("__n"))
    whole = c.groupBy(*by, "attr", label).agg(F.sum("c").alias("c")).withColumn("t", F.sum("c").over(Window.partitionBy(*by, "attr"))).groupBy(*by, "attr").agg(F.sum(bits(F.col("c"), F.col("t"))).alias("entropy"))
    return whole.join(inner, [*by, "attr"]).select(*by, "attr", "entropy", (F.col("entropy") - F.col("__w") / F.col("__n")).alias("gain"))


def id3_fit(df: DataFrame, attrs: Sequence[str], label: str) -> DataFrame:
    """(path, attr, value, leaf): a multiway tree level by level; each attribute once a path.

    Ties go to the first attribute, in a leaf to the smallest label. Rows carry
    their path as a column; all open paths are split by one job a level.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[label]
    rows = df.select(*[F.coalesce(F.col(a).cast("string"), F.lit("null")).alias(a) for a in attrs], F.col(label).alias("__y")).withColumn("path", F.lit(""))
    out = None
    for _ in range(len(attrs) + 1):
        counts = rows.groupBy("path", "__y").agg(F.count("*").alias("c"))
        per = counts.groupBy("path").agg(F.count("*").alias("kinds"), F.min_by("__y", F.struct(-F.col("c"), F.col("__y"))).alias("leaf"))
        gains = id3_gain(rows, attrs, "__y").where(~F.contains(F.concat("path", F.lit("=")), F.concat(F.lit("/"), "attr", F.lit("="))))
        place = F.array_position(F.array(*[F.lit(a) for a in attrs]), F.col("attr"))
        best = gains.groupBy("path").agg(F.min_by("attr", F.struct(-F.round("gain", 12), place)).alias("attr"))
        # a row per open path: the tree itself, which is small
        level = per.join(best, "path", "left").collect()
        done = [(r["path"], None, None, r["leaf"]) for r in level if r["kinds"] == 1 or r["attr"] is None]
        split = {r["path"]: r["attr"] for r in level if r["kinds"] > 1 and r["attr"] is not None}
        leaves = spark.createDataFrame(done, f"path string, attr string, value string, leaf {kind}")
        out = leaves if out is None else out.unionByName(leaves)
        if not split:
            break
        chosen = spark.createDataFrame(list(split.items()), "path string, attr string")
        rows = rows.join(F.broadcast(chosen), "path")
        value = F.element_at(F.create_map(*[x for a in attrs for x in (F.lit(a), F.col(a))]), F.col("attr"))
        rows = rows.withColumn("value", value)
        out = out.unionByName(rows.select("path", "attr", "value").distinct().withColumn("leaf", F.lit(None).cast(kind)))
        rows = rows.withColumn("path", F.concat("path", F.lit("/"), "attr", F.lit("="), "value")).drop("attr", "value")
    return out
