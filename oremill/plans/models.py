"""Queries of models, clusters, evaluation, sequences and images; and the flagship job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oremill.functions.columns import distance
from oremill.operators import cluster, evaluate, image, linear, neighbours, profile, sequence, tree
from oremill.operators.prep import minmax_fit_apply, region_relabel, split_hash, zscore_fit_apply
from oremill.operators.ranking import checkpointed, k_sweep_running_mean
from oremill.sources import tabular

from .base import L, listings, query, rounded, scratch, table, train_rows

S = SparkSession
FEATS = ["items", "qty", "disc", "tax"]
#: The components of a vector.
DIM = 64
EACH = [f"x{i + 1}" for i in range(DIM)]


def vectors(spark: S, d: str, n: int = DIM) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(f"x{i + 1}") for i in range(n)])


V = "V AS (SELECT vec_id AS id, label, " + ", ".join(f"embedding[{i}]::DOUBLE AS x{i}" for i in range(1, DIM + 1)) + " FROM embeddings)"
Q = V + ", Q AS (SELECT * FROM V WHERE id % 5 = 0), T AS (SELECT * FROM V WHERE id % 5 <> 0)"


def queries_and_train(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, d)
    return v.where("id % 5 = 0"), v.where("id % 5 != 0")


def sq(a: str, b: str) -> str:
    return " + ".join(f"({a}.x{i} - {b}.x{i}) * ({a}.x{i} - {b}.x{i})" for i in range(1, DIM + 1))


def dist(metric: str, a: str, b: str) -> str:
    gaps = [f"abs({a}.x{i} - {b}.x{i})" for i in range(1, DIM + 1)]
    return {"euclidean": f"sqrt({sq(a, b)})", "manhattan": " + ".join(gaps), "chebyshev": f"greatest({', '.join(gaps)})", "minkowski": "pow(" + " + ".join(f"pow({g}, 3)" for g in gaps) + ", 1 / 3.0::DOUBLE)"}[metric]


# Linear models


@query(f"{L} SELECT id, round((SELECT avg(price) FROM L WHERE split = 'train'), 3) AS pred FROM L WHERE split <> 'train'")
def constant_baseline(spark: S, d: str) -> DataFrame:
    return rounded(linear.constant_baseline(listings(spark, d), "price", train_rows()).where("split != 'train'").select("id", "pred"), pred=3)


#: The operators' ridge, on the whole diagonal, for two features x1 and x2 made by the given expressions.
SUMS = """, m AS (SELECT min(items) AS l1, max(items) - min(items) AS r1, min(qty) AS l2, max(qty) - min(qty) AS r2 FROM L WHERE split = 'train'),
x AS (SELECT id, split, (%s)::DOUBLE AS x1, (%s)::DOUBLE AS x2, price AS y FROM L, m),
s AS (SELECT count(*) + 1e-6::DOUBLE AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) + 1e-6::DOUBLE AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) + 1e-6::DOUBLE AS s22, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y FROM x WHERE split = 'train'),
c AS (SELECT *, s11 - s1 * s1 / n AS c11, s12 - s1 * s2 / n AS c12, s22 - s2 * s2 / n AS c22, s1y - s1 * sy / n AS c1y, s2y - s2 * sy / n AS c2y FROM s),
b AS (SELECT (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2, * FROM c),
w AS (SELECT b1, b2, (sy - b1 * s1 - b2 * s2) / n AS b0 FROM b)
"""


@query(f"{L} {SUMS % ('items', 'qty')} SELECT id, round(b0 + b1 * x1 + b2 * x2, 1) AS pred FROM x, w WHERE split = 'test'")
def linear_fit_predict(spark: S, d: str) -> DataFrame:
    _, pred = linear.linear_fit_predict(listings(spark, d), ["items", "qty"], "price", train_rows())
    return rounded(pred.where("split = 'test'").select("id", "pred"), pred=1)


@query(f"{L} {SUMS % ('(items - l1) / r1::DOUBLE', '(qty - l2) / r2::DOUBLE')} SELECT feature, round(weight, 1) AS weight FROM (SELECT 'items' AS feature, b1 AS weight FROM w UNION ALL SELECT 'qty', b2 FROM w UNION ALL SELECT 'intercept', b0 FROM w)")
def linear_minmax(spark: S, d: str) -> DataFrame:
    x = listings(spark, d).withColumns({"items": F.col("items").cast("double")})
    return rounded(linear.linear_minmax(x, ["items", "qty"], "price", train_rows())[0], weight=1)


@query("SELECT round(regr_slope(p_retailprice, p_size), 6) AS beta, round(regr_intercept(p_retailprice, p_size), 4) AS alpha, round((regr_syy(p_retailprice, p_size) - regr_sxy(p_retailprice, p_size) * regr_sxy(p_retailprice, p_size) / regr_sxx(p_retailprice, p_size)) / 1000, 2) AS sse FROM part")
def slr_closed_form(spark: S, d: str) -> DataFrame:
    s = linear.slr_closed_form(table(spark, d, "part"), "p_size", "p_retailprice").withColumn("sse", F.col("sse") / 1000)
    return rounded(s, beta=6, alpha=4, sse=2)


@query("""WITH RECURSIVE s AS (SELECT count(*)::DOUBLE AS n, sum(p_size)::DOUBLE AS sx, sum(p_retailprice) AS sy, sum(p_size * p_size)::DOUBLE AS sxx, sum(p_retailprice * p_retailprice) AS syy, sum(p_size * p_retailprice) AS sxy FROM part),
x AS (SELECT CASE WHEN i = 100 THEN 0 ELSE sign(i - 100) * pow(10.0::DOUBLE, -6 + 6 * abs(i - 100) / 100.0::DOUBLE) END AS d FROM range(201) r(i)),
g(beta, alpha, sse, rounds, still) AS (SELECT regr_slope(p_retailprice, p_size) + 0.05::DOUBLE, regr_intercept(p_retailprice, p_size) - 0.5::DOUBLE, NULL::DOUBLE, 0, false FROM part UNION ALL
 SELECT * FROM (SELECT c.b, c.a, syy + c.b * c.b * sxx + c.a * c.a * n - 2 * c.b * sxy - 2 * c.a * sy + 2 * c.a * c.b * sx AS sse, c.rounds + 1, abs(c.d1) < 5e-4 AND abs(c.d2) < 5e-4
   FROM (SELECT g.beta + p.d AS b, g.alpha + q.d AS a, p.d AS d1, q.d AS d2, rounds FROM g, x p, x q WHERE NOT still AND rounds < 50) c, s ORDER BY sse, c.b, c.a LIMIT 1))
SELECT round(beta, 4) AS beta, round(alpha, 3) AS alpha, round(sse, 0) AS sse, CAST(rounds AS INTEGER) AS rounds FROM g ORDER BY rounds DESC LIMIT 1""")
def sse_grid_search(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    start = linear.slr_closed_form(p, "x", "y").head()
    return rounded(linear.sse_grid_search(profile.sufficient_stats(p, "x", "y"), start["beta"] + 0.05, start["alpha"] - 0.5), beta=4, alpha=3, sse=0)


@query("SELECT round(sum((round(2.0::DOUBLE * p_size + 1000, 2) - p_retailprice) * (round(2.0::DOUBLE * p_size + 1000, 2) - p_retailprice)), 2) AS sse, count(*) AS n FROM part")
def predict_and_sse(spark: S, d: str) -> DataFrame:
    return rounded(linear.predict_and_sse(table(spark, d, "part"), 2.0, 1000.0, "p_size", "p_retailprice"), sse=2)


# Nearest neighbours


@query(f"WITH {V} SELECT a.id AS id, c.id AS center, round({dist('manhattan', 'a', 'c')}, 6) AS d FROM V a, V c WHERE c.id < 5", name="distance_expr")
def distances(spark: S, d: str) -> DataFrame:
    """Every vector, by all its components, to five of them as centers."""
    v = vectors(spark, d)
    gap = distance([F.col(f"a.{c}") for c in EACH], [F.col(f"c.{c}") for c in EACH], "manhattan")
    return v.alias("a").crossJoin(F.broadcast(v.where("id < 5")).alias("c")).select(F.col("a.id").alias("id"), F.col("c.id").alias("center"), F.round(gap, 6).alias("d"))


@query(f"{L}, g AS (SELECT nation, avg(price) AS price, avg(qty) AS qty FROM L GROUP BY 1) SELECT a.nation AS a, b.nation AS b, round(sqrt((a.price - b.price) * (a.price - b.price) + (a.qty - b.qty) * (a.qty - b.qty)), 3) AS d FROM g a JOIN g b ON a.nation < b.nation")
def pairwise_distance(spark: S, d: str) -> DataFrame:
    g = listings(spark, d).groupBy("nation").agg(F.avg("price").alias("price"), F.avg("qty").alias("qty"))
    return rounded(neighbours.pairwise_distance(g, "nation", ["price", "qty"]), d=3)


@query(f"WITH {Q} SELECT 'euclidean' AS metric, Q.id AS qid, T.id AS tid, round({dist('euclidean', 'Q', 'T')}, 6) AS d, CAST(row_number() OVER (PARTITION BY Q.id ORDER BY {dist('euclidean', 'Q', 'T')}, T.id) AS INTEGER) AS rank FROM Q, T QUALIFY rank <= 5")
def knn_join(spark: S, d: str) -> DataFrame:
    return rounded(neighbours.knn_join(*queries_and_train(spark, d), "id", EACH, 5), d=6)


@query("""SELECT m AS metric, qid, tid, round(d, 4) AS d, CAST(row_number() OVER (PARTITION BY m, qid ORDER BY d, tid) AS INTEGER) AS rank FROM (
            SELECT unnest(['euclidean', 'chebyshev']) AS m, s_suppkey AS qid, c_custkey AS tid, unnest([sqrt(power(s_acctbal - c_acctbal, 2) + power(100.0 * (s_nationkey - c_nationkey), 2)), greatest(abs(s_acctbal - c_acctbal), abs(100.0 * (s_nationkey - c_nationkey)))]) AS d
            FROM supplier, customer) QUALIFY rank <= 4""")
def knn_join_cells(spark: S, d: str) -> DataFrame:
    """Each supplier's nearest customers by balance and nation, by cells of customers around pivots."""
    rows = lambda name, c: table(spark, d, name).select(F.col(f"{c}key").alias("id"), F.col(f"{c[0]}_acctbal").cast("double").alias("x"), (F.col(f"{c[0]}_nationkey") * 100.0).alias("y"))
    near = neighbours.knn_join(rows("supplier", "s_supp"), rows("customer", "c_cust"), "id", ["x", "y"], 4, ("euclidean", "chebyshev"), per_block=512)
    return rounded(near, d=4)


NEAR = f"WITH {Q}, N AS (SELECT Q.id AS qid, T.x1 + T.x2 AS y, T.label, row_number() OVER (PARTITION BY Q.id ORDER BY {dist('euclidean', 'Q', 'T')}, T.id) AS rank FROM Q, T)"


@query(NEAR + " SELECT qid, round(avg(y), 5) AS pred FROM N WHERE rank <= 15 GROUP BY 1")
def knn_regress(spark: S, d: str) -> DataFrame:
    q, t = queries_and_train(spark, d)
    return rounded(neighbours.knn_regress(q, t.withColumn("y", F.col("x1") + F.col("x2")), "id", EACH, "y", 15), pred=5)


@query(NEAR + ", A AS (SELECT qid, rank, avg(y) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS m FROM N) SELECT qid, CAST(rank AS INTEGER) AS k, round(m, 5) AS pred FROM A WHERE rank IN (3, 5, 10, 20)", name="knn_k_sweep")
def k_sweep(spark: S, d: str) -> DataFrame:
    q, t = queries_and_train(spark, d)
    return rounded(neighbours.knn_k_sweep(q, t.withColumn("y", F.col("x1") + F.col("x2")), "id", EACH, "y", [3, 5, 10, 20]), pred=5)


@query(NEAR + ", A AS (SELECT qid, rank, avg(y) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS m FROM N WHERE rank <= 50) SELECT qid, CAST(rank AS INTEGER) AS k, round(m, 5) AS pred FROM A WHERE rank IN (1, 7, 50)", name="k_sweep_running_mean")
def running_mean(spark: S, d: str) -> DataFrame:
    q, t = queries_and_train(spark, d)
    near = neighbours.knn_join(q, t.withColumn("y", F.col("x1") + F.col("x2")), "id", EACH, 50, carry=("y",))
    return rounded(k_sweep_running_mean(near, "y", [1, 7, 50]), pred=5)


SWEEP = " UNION ALL ".join(f"SELECT '{m}' AS metric, Q.id AS qid, T.x1 + T.x2 AS y, row_number() OVER (PARTITION BY Q.id ORDER BY {dist(m, 'Q', 'T')}, T.id) AS rank FROM Q, T" for m in neighbours.METRICS)


@query(f"WITH {Q}, N AS ({SWEEP}), A AS (SELECT metric, qid, rank, avg(y) OVER (PARTITION BY metric, qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS m FROM N) SELECT metric, CAST(rank AS INTEGER) AS k, count(*) AS n, round(avg(m), 4) AS mean_pred FROM A WHERE rank IN (1, 3, 5, 15) GROUP BY 1, 2")
def knn_metric_sweep(spark: S, d: str) -> DataFrame:
    q, t = queries_and_train(spark, d)
    p = neighbours.knn_metric_sweep(q, t.withColumn("y", F.col("x1") + F.col("x2")), "id", EACH, "y", neighbours.METRICS, [1, 3, 5, 15])
    return p.groupBy("metric", "k").agg(F.count("*").alias("n"), F.round(F.avg("pred"), 4).alias("mean_pred"))


@query(NEAR + ", C AS (SELECT qid, label, count(*) AS c FROM N WHERE rank <= 9 GROUP BY 1, 2) SELECT qid, label AS pred FROM C QUALIFY row_number() OVER (PARTITION BY qid ORDER BY c DESC, label) = 1")
def knn_classify(spark: S, d: str) -> DataFrame:
    return neighbours.knn_classify(*queries_and_train(spark, d), "id", EACH, "label", 9)


GRID = " UNION ALL ".join(f"SELECT '{m}' AS metric, a.trial, a.id AS qid, a.label AS y, b.label, row_number() OVER (PARTITION BY a.trial, a.id ORDER BY {dist(m, 'a', 'b')}, b.id) AS rank FROM s a JOIN s b ON a.trial = b.trial AND NOT a.train AND b.train" for m in ("euclidean", "manhattan"))


@query(f"""WITH {V}, o AS (SELECT V.*, t AS trial, row_number() OVER (PARTITION BY t ORDER BY md5(t || ':' || id), id) AS r, count(*) OVER (PARTITION BY t) AS n FROM V, range(10) z(t)),
       s AS (SELECT *, r <= round_even(n * 0.75, 0) AS train FROM o), N AS ({GRID}),
       c AS (SELECT metric, trial, qid, y, k, label, count(*) AS c FROM N, (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k GROUP BY ALL),
       p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY metric, trial, qid, k ORDER BY c DESC, label) = 1),
       a AS (SELECT metric, trial, k, avg((label = y)::INT) AS a FROM p GROUP BY ALL) SELECT metric, k, round(avg(a), 6) AS accuracy FROM a GROUP BY 1, 2""")
def knn_grid_accuracy(spark: S, d: str) -> DataFrame:
    return rounded(neighbours.knn_grid_accuracy(vectors(spark, d), "id", EACH, "label", 10, [1, 3, 5], ["euclidean", "manhattan"]), accuracy=6)


@query()
def repeated_cv(spark: S, d: str) -> DataFrame:
    """Shuffle cross-validation of neighbours over metrics and k, the trial as a key; then the best k."""
    t = vectors(spark, d).crossJoin(spark.range(10).select(F.col("id").cast("int").alias("trial"))).withColumn("y", F.col("x1") + F.col("x2"))
    t = split_hash(t.withColumn("key", F.concat_ws("-", "trial", "id")), "key")
    t = minmax_fit_apply(t, EACH, train_rows(), ["trial"])
    p = neighbours.knn_metric_sweep(t.where("split = 'val'"), t.where(train_rows()), "id", EACH, "y", neighbours.METRICS, [1, 5, 15], ["trial"])
    truth = t.select("trial", F.col("id").alias("qid"), "y")
    m = p.join(truth, ["trial", "qid"]).groupBy("trial", "metric", "k").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"))
    return rounded(profile.cv_best_param(m), median=6)


# Trees

BEST = """WITH long AS (SELECT p_type AS node_id, p_retailprice AS y, 'size' AS feat, 1 AS place, p_size::DOUBLE AS x FROM part UNION ALL SELECT p_type, p_retailprice, 'bucket', 2, (p_partkey % 17)::DOUBLE FROM part),
g AS (SELECT node_id, feat, place, x, count(*)::DOUBLE AS c, sum(y) AS s FROM long GROUP BY ALL),
r AS (SELECT *, sum(c) OVER o AS nl, sum(s) OVER o AS sl, sum(c) OVER w AS n, sum(s) OVER w AS t, lead(x) OVER (PARTITION BY node_id, feat ORDER BY x) AS nx FROM g WINDOW o AS (PARTITION BY node_id, feat ORDER BY x ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY node_id, feat)),
k AS (SELECT node_id, feat, place, (x + nx) / 2 AS thr, sl * sl / nl + (t - sl) * (t - sl) / (n - nl) - t * t / n AS gain FROM r WHERE nx IS NOT NULL AND nl >= 5 AND n - nl >= 5)
SELECT node_id, feat, thr, round(gain / 1000, 2) AS gain FROM k WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY k.gain DESC, place, thr) = 1"""


def parts(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("node_id"), F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 17).cast("double").alias("bucket"), F.col("p_retailprice").alias("y"), F.col("p_type").alias("kind"))


@query(BEST)
def best_split_regression(spark: S, d: str) -> DataFrame:
    s = tree.best_split_regression(parts(spark, d).drop("id", "kind"), ["size", "bucket"], "y", 5)
    return rounded(s.withColumn("gain", F.col("gain") / 1000), gain=2)


def tree_sql(rows: str, depth: int, least: int) -> str:
    """A tree in SQL, three tables a level: r, where rows (id, size, bucket, y, train) are; b, each node's best cut; s, its nodes."""
    out = [f"r0 AS (SELECT *, 1 AS node_id FROM {rows})"]
    for i in range(depth + 1):
        stats = f"n{i} AS (SELECT node_id, count(*) AS n, avg(y) AS value, var_pop(y) * count(*) AS sse FROM r{i} WHERE train GROUP BY 1)"
        if i == depth:
            return ", ".join([*out, stats, f"s{i} AS (SELECT node_id, n, value, true AS is_leaf, NULL::VARCHAR AS feat, NULL::DOUBLE AS thr FROM n{i})"])
        cut = f"""b{i} AS (SELECT node_id, feat, (x + nx) / 2 AS thr, sl * sl / nl + (t - sl) * (t - sl) / (n - nl) - t * t / n AS gain FROM (
          SELECT *, sum(c) OVER o AS nl, sum(s) OVER o AS sl, sum(c) OVER w AS n, sum(s) OVER w AS t, lead(x) OVER (PARTITION BY node_id, place ORDER BY x) AS nx FROM (
            SELECT node_id, place, any_value(feat) AS feat, x, count(*)::DOUBLE AS c, sum(y) AS s FROM (SELECT node_id, y, unnest([1, 2]) AS place, unnest(['size', 'bucket']) AS feat, unnest([size, bucket]) AS x FROM r{i} WHERE train) GROUP BY node_id, place, x)
          WINDOW o AS (PARTITION BY node_id, place ORDER BY x ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY node_id, place))
          WHERE nx IS NOT NULL AND nl >= {least} AND n - nl >= {least} AND sl * sl / nl + (t - sl) * (t - sl) / (n - nl) - t * t / n > 0 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY gain DESC, place, thr) = 1)"""
        nodes = f"""s{i} AS (SELECT node_id, n, value, leaf AS is_leaf, CASE WHEN NOT leaf THEN feat END AS feat, CASE WHEN NOT leaf THEN thr END AS thr
          FROM (SELECT *, feat IS NULL OR n < {2 * least} OR sse < 1e-9 AS leaf FROM n{i} LEFT JOIN b{i} USING (node_id)))"""
        down = f"r{i + 1} AS (SELECT r.* EXCLUDE (node_id), 2 * node_id + CASE WHEN CASE s.feat WHEN 'size' THEN size ELSE bucket END <= thr THEN 0 ELSE 1 END AS node_id FROM r{i} r JOIN s{i} s USING (node_id) WHERE NOT s.is_leaf)"
        out += [stats, cut, nodes, down]
    raise AssertionError("the last level returns")


TREE = "WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS size, (p_partkey % 17)::DOUBLE AS bucket, p_retailprice AS y, true AS train FROM part), "
#: A row's prediction at depth d: the value of the deepest node that it reaches by then.
REACHED = lambda depth: "e AS (" + " UNION ALL ".join(f"SELECT id, y, train, {i} AS depth, value FROM r{i} JOIN s{i} USING (node_id)" for i in range(depth + 1)) + ")"


@query(TREE + tree_sql("p", 4, 10) + " SELECT CAST(node_id AS BIGINT) AS node_id, is_leaf, round(value, 4) AS value, feat, thr, n FROM (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(5)) + ")")
def tree_fit_regression(spark: S, d: str) -> DataFrame:
    return rounded(tree.tree_fit_regression(parts(spark, d), ["size", "bucket"], "y", 4, 10), value=4)


@query(TREE + tree_sql("p", 3, 10) + ", " + REACHED(3) + """, l AS (SELECT id, any_value(y) AS y, arg_max(value, depth) AS pred FROM e GROUP BY 1), d AS (SELECT pred - y AS e FROM l)
       SELECT round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse, round(sum(e * e), -2) AS sse, round(median(abs(e)), 3) AS median_abs, round(max(abs(e)), 3) AS max_abs,
        avg((abs(e) <= 50000)::INT) AS within_50k, avg((abs(e) <= 100000)::INT) AS within_100k, avg((abs(e) <= 200000)::INT) AS within_200k, count(*) AS n FROM d""")
def tree_predict(spark: S, d: str) -> DataFrame:
    p = parts(spark, d)
    out = tree.tree_predict(p, tree.tree_fit_regression(p, ["size", "bucket"], "y", 3, 10), ["size", "bucket"])
    return rounded(profile.regression_metrics(out, "y", "pred"), mae=3, rmse=3, sse=-2, median_abs=3, max_abs=3)


@query(TREE.replace("true AS train FROM part", "CAST('0x' || substr(md5('42:' || p_partkey), 1, 7) AS BIGINT) / 268435456.0::DOUBLE < 0.65 AS train FROM part") + tree_sql("p", 4, 10) + ", " + REACHED(4) + """, l AS (SELECT d.depth, id, any_value(y) AS y, arg_max(value, e.depth) AS pred FROM e JOIN (SELECT unnest([1, 2, 3, 4]) AS depth) d ON e.depth <= d.depth WHERE NOT train GROUP BY 1, 2)
       SELECT CAST(depth AS INTEGER) AS depth, round(avg(abs(pred - y)), 3) AS mae, count(*) AS n FROM l GROUP BY 1""")
def tree_depth_sweep(spark: S, d: str) -> DataFrame:
    p = split_hash(parts(spark, d), "id")
    s = tree.tree_depth_sweep(p, ["size", "bucket"], "y", train_rows(), [1, 2, 3, 4], 10)
    return rounded(profile.regression_metrics(s, "y", "pred", ["depth"]).select("depth", "mae", "n"), mae=3)


GAINS = """WITH b AS (SELECT x, count(*) FILTER (y = 0)::DOUBLE AS c0, count(*) FILTER (y = 1)::DOUBLE AS c1 FROM (SELECT n_chars::DOUBLE AS x, quality AS y FROM documents JOIN labels USING (doc_id)) GROUP BY 1),
r AS (SELECT *, sum(c0) OVER o AS l0, sum(c1) OVER o AS l1, sum(c0) OVER () AS a0, sum(c1) OVER () AS a1, lead(x) OVER (ORDER BY x) AS nx FROM b WINDOW o AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
e AS (SELECT (x + nx) / 2 AS thr, a0, a1, l0, l1, a0 - l0 AS r0, a1 - l1 AS r1 FROM r WHERE nx IS NOT NULL),
h AS (SELECT thr, -(a0 / (a0 + a1)) * log2(a0 / (a0 + a1)) - (a1 / (a0 + a1)) * log2(a1 / (a0 + a1)) AS h,
 (l0 + l1) / (a0 + a1) * (CASE WHEN l0 > 0 THEN -(l0 / (l0 + l1)) * log2(l0 / (l0 + l1)) ELSE 0 END + CASE WHEN l1 > 0 THEN -(l1 / (l0 + l1)) * log2(l1 / (l0 + l1)) ELSE 0 END) AS hl,
 (r0 + r1) / (a0 + a1) * (CASE WHEN r0 > 0 THEN -(r0 / (r0 + r1)) * log2(r0 / (r0 + r1)) ELSE 0 END + CASE WHEN r1 > 0 THEN -(r1 / (r0 + r1)) * log2(r1 / (r0 + r1)) ELSE 0 END) AS hr FROM e)
SELECT thr, round(h - hl - hr, 8) AS gain FROM h ORDER BY round(h - hl - hr, 12) DESC, thr LIMIT 1"""


def scored(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(table(spark, d, "labels"), "doc_id")


@query(GAINS)
def best_split_entropy(spark: S, d: str) -> DataFrame:
    s = tree.best_split_entropy(scored(spark, d).withColumn("node_id", F.lit(1)), ["score"], "quality")
    return rounded(s.select("thr", "gain"), gain=8)


@query()
def tree_fit_entropy(spark: S, d: str) -> DataFrame:
    x = vectors(spark, d)
    nodes = tree.tree_fit_entropy(x, EACH, "label", 4, 0.001)
    return evaluate.accuracy(tree.tree_classify(x, nodes, EACH), "label", "pred")


ATTRS = """WITH x AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(l_linenumber % 3 AS VARCHAR) AS line, l_returnflag AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
long AS (SELECT 'status' AS attr, status AS v, y FROM x UNION ALL SELECT 'priority', priority, y FROM x UNION ALL SELECT 'line', line, y FROM x)"""


def flags(spark: S, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), (F.col("l_linenumber") % 3).cast("string").alias("line"), F.col("l_returnflag").alias("y"))


@query(ATTRS + """, c AS (SELECT attr, v, y, count(*)::DOUBLE AS c FROM long GROUP BY ALL), i AS (SELECT attr, v, sum(c) AS t, -sum(c / t * log2(c / t)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY attr, v) AS t FROM c) GROUP BY attr, v),
w AS (SELECT attr, sum(t * h / 1.0) AS wh, sum(t) AS n FROM (SELECT attr, v, max(t0) AS t, max(h) AS h FROM (SELECT i.attr, i.v, h, (SELECT sum(c) FROM c WHERE c.attr = i.attr AND c.v = i.v) AS t0 FROM i) GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT attr, -sum(c / t * log2(c / t)) AS entropy FROM (SELECT attr, y, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY attr) AS t FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT attr, round(entropy, 8) AS entropy, round(entropy - wh / n, 8) AS gain FROM e JOIN w USING (attr)""")
def id3_gain(spark: S, d: str) -> DataFrame:
    g = tree.id3_gain(flags(spark, d).withColumn("path", F.lit("")), ["status", "priority", "line"], "y")
    return rounded(g.drop("path"), entropy=8, gain=8)


@query()
def id3_fit(spark: S, d: str) -> DataFrame:
    return tree.id3_fit(flags(spark, d), ["status", "line"], "y")


# Clusters

CENTERS = f"C AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cluster, {', '.join(EACH)} FROM V WHERE id < 4)"
ASSIGN = f"A AS (SELECT V.*, C.cluster, {sq('V', 'C')} AS d2 FROM V, C QUALIFY row_number() OVER (PARTITION BY V.id ORDER BY {sq('V', 'C')}, C.cluster) = 1)"


def centers(spark: S, d: str) -> DataFrame:
    return vectors(spark, d).where("id < 4").select(F.col("id").cast("int").alias("cluster"), F.array(*EACH).alias("center"))


@query(f"WITH {V}, {CENTERS}, {ASSIGN} SELECT id, cluster, round(d2, 6) AS d2 FROM A")
def kmeans_assign(spark: S, d: str) -> DataFrame:
    return rounded(cluster.kmeans_assign(vectors(spark, d), centers(spark, d), EACH).select("id", "cluster", "d2"), d2=6)


@query(f"WITH {V}, {CENTERS}, {ASSIGN} SELECT cluster, {', '.join(f'round(avg({c}), 6) AS c{c[1:]}' for c in EACH)} FROM A GROUP BY 1")
def kmeans_step(spark: S, d: str) -> DataFrame:
    s = cluster.kmeans_step(vectors(spark, d), centers(spark, d), EACH)
    return s.select("cluster", *[F.round(F.col("center")[i], 6).alias(f"c{i + 1}") for i in range(DIM)])


@query(f"WITH {V}, {CENTERS}, {ASSIGN} SELECT round(sum(d2), 4) AS wcss FROM A")
def kmeans_wcss(spark: S, d: str) -> DataFrame:
    return rounded(cluster.kmeans_wcss(vectors(spark, d), centers(spark, d), EACH), wcss=4)


#: Lloyd's rounds of several starts (rows of least hash) with a row a center and step; A: each row's cluster in the end.
LLOYD = """WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings),
st AS (SELECT s AS run, CAST(row_number() OVER (PARTITION BY s ORDER BY md5(s || ':' || id), id) - 1 AS INTEGER) AS cluster, x FROM v, range(%d) r(s) QUALIFY cluster < %d),
m(run, step, cluster, center, moved) AS (SELECT run, 0, cluster, x, true FROM st UNION ALL
 SELECT * FROM (WITH o AS (SELECT run, step, cluster, center FROM m WHERE step <= 100 QUALIFY bool_or(moved) OVER (PARTITION BY run)),
  a AS (SELECT o.run, v.id, v.x, o.cluster FROM v, o QUALIFY row_number() OVER (PARTITION BY o.run, v.id ORDER BY list_distance(v.x, o.center), o.cluster) = 1),
  u AS (SELECT run, cluster, i, avg(e) AS e FROM (SELECT run, cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a) GROUP BY ALL),
  n AS (SELECT run, cluster, list(e ORDER BY i) AS c FROM u GROUP BY ALL)
  SELECT o.run, o.step + 1, o.cluster, coalesce(n.c, o.center), coalesce(list_max([abs(n.c[i] - o.center[i]) FOR i IN range(1, len(o.center) + 1)]), 0) >= 1e-12 FROM o LEFT JOIN n USING (run, cluster))),
f AS (SELECT run, cluster, center FROM m QUALIFY step = max(step) OVER (PARTITION BY run)),
A AS (SELECT f.run, v.id, f.cluster, power(list_distance(v.x, f.center), 2) AS d2 FROM v, f QUALIFY row_number() OVER (PARTITION BY f.run, v.id ORDER BY list_distance(v.x, f.center), f.cluster) = 1)"""


@query(LLOYD % (1, 4) + " SELECT cluster, count(*) AS n, round(sum(d2), 3) AS wcss FROM A GROUP BY 1")
def kmeans_fit(spark: S, d: str) -> DataFrame:
    rows, _, _ = cluster.kmeans_fit(vectors(spark, d), EACH, 4)
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("d2"), 3).alias("wcss"))


@query(LLOYD % (20, 3) + ", b AS (SELECT run, sum(d2) AS w FROM A GROUP BY 1 ORDER BY w, run LIMIT 1) SELECT cluster, [round(e, 6) FOR e IN center] AS center, round(w, 3) AS wcss FROM f JOIN b USING (run)")
def kmeans_best_of_restarts(spark: S, d: str) -> DataFrame:
    table_, cost = cluster.kmeans_best_of_restarts(vectors(spark, d), EACH, 3)
    return table_.withColumns({"center": F.transform("center", lambda e: F.round(e, 6)), "wcss": F.round(F.lit(cost), 3)})


@query(" UNION ALL ".join(f"SELECT * FROM ({LLOYD % (20, k)} SELECT CAST({k} AS INTEGER) AS k, round(min(w), 3) AS wcss FROM (SELECT sum(d2) AS w FROM A GROUP BY run))" for k in range(1, 6)))
def kmeans_k_sweep(spark: S, d: str) -> DataFrame:
    return rounded(cluster.kmeans_k_sweep(vectors(spark, d), EACH, range(1, 6)), wcss=3)


@query()
def kmeans_ml(spark: S, d: str) -> DataFrame:
    return cluster.kmeans_ml(vectors(spark, d), EACH, 3).groupBy("cluster").agg(F.count("*").alias("n"))


TOGETHER = """WITH RECURSIVE e AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*)::DOUBLE AS w FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_suppkey <> b.l_suppkey GROUP BY 1, 2),
v AS (SELECT s.id, list(coalesce(w, 0) ORDER BY d.id) AS x FROM (SELECT DISTINCT src AS id FROM e) s CROSS JOIN (SELECT DISTINCT dst AS id FROM e) d LEFT JOIN e ON e.src = s.id AND e.dst = d.id GROUP BY 1),
""" + LLOYD.split("\n", 1)[1] % (1, 5)


@query(TOGETHER + " SELECT id AS src, cluster FROM A")
def kmeans_adjacency(spark: S, d: str) -> DataFrame:
    """Suppliers by how often they deliver to one order with each other supplier."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    both = li.withColumnRenamed("l_suppkey", "src").join(li.withColumnRenamed("l_suppkey", "dst"), "l_orderkey").where("src != dst")
    return cluster.kmeans_adjacency(both.groupBy("src", "dst").agg(F.count("*").alias("w")), 5)


@query("SELECT c_nationkey AS cluster, count(*) AS n, CAST(min(c_custkey) AS BIGINT) AS first, CAST(max(c_custkey) AS BIGINT) AS last FROM customer GROUP BY 1")
def cluster_members(spark: S, d: str) -> DataFrame:
    m = cluster.cluster_members(table(spark, d, "customer").withColumnRenamed("c_nationkey", "cluster"), "cluster", "c_custkey")
    return m.select("cluster", "n", F.col("members")[0].alias("first"), F.element_at("members", -1).alias("last"))


@query("SELECT c_nationkey AS cluster, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer")
def cluster_places(spark: S, d: str) -> DataFrame:
    return cluster.cluster_places(table(spark, d, "customer").select(F.col("c_nationkey").alias("cluster"), "c_custkey"), "cluster", "c_custkey")


NATIONS = """WITH RECURSIVE g AS (SELECT c_nationkey AS id, [avg(c_acctbal)::DOUBLE, count(*)::DOUBLE] AS x FROM customer GROUP BY 1), v AS (SELECT * FROM g),
""" + LLOYD.split("\n", 1)[1] % (1, 5)


@query(NATIONS + ", w AS (SELECT cluster, avg(x[1]) AS mean FROM A JOIN g USING (id) GROUP BY 1) SELECT cluster, round(mean, 4) AS mean, CAST(row_number() OVER (ORDER BY mean, cluster) - 1 AS INTEGER) AS region FROM w")
def geo_regions(spark: S, d: str) -> DataFrame:
    """Groups of customers' nations by mean balance and size, numbered by balance."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    summary = c.groupBy("nation").agg(F.avg("c_acctbal").alias("bal"), F.count("*").cast("double").alias("n"))
    rows, _, _ = cluster.kmeans_fit(summary, ["bal", "n"], 5, 100, ident="nation")
    return rounded(region_relabel(rows.select("nation", "cluster"), c, "cluster", "nation", "c_acctbal"), mean=4)


def summaries(spark: S, d: str) -> DataFrame:
    g = listings(spark, d).groupBy("seg", "nation").agg(F.avg("price").alias("price"), F.avg("qty").alias("qty"))
    return zscore_fit_apply(g.withColumn("split", F.lit("train")), ["price", "qty"], train_rows(), ["seg"]).drop("split")


#: The closest pair's merges by method and dataset, with a row a cluster and step; ``of`` holds its members.
MERGES = L.replace("WITH", "WITH RECURSIVE", 1) + """, g AS (SELECT seg, nation, avg(price) AS price, avg(qty) AS qty FROM L GROUP BY 1, 2),
z AS (SELECT seg, CAST(row_number() OVER (PARTITION BY seg ORDER BY nation) - 1 AS INTEGER) AS i, (price - avg(price) OVER w) / stddev_pop(price) OVER w AS x, (qty - avg(qty) OVER w) / stddev_pop(qty) OVER w AS y, CAST(count(*) OVER w AS INTEGER) AS m FROM g WINDOW w AS (PARTITION BY seg)),
s(method, seg, step, id, of, a, b, height) AS (
 SELECT method, seg, 0, i, [{'x': x, 'y': y}], NULL::INTEGER, NULL::INTEGER, NULL::DOUBLE FROM z, (SELECT unnest(['single', 'complete', 'average', 'centroid']) AS method)
 UNION ALL
 SELECT * FROM (WITH p AS (
   SELECT u.method, u.seg, u.step, u.id AS a, v.id AS b, u.of || v.of AS of, flatten([[sqrt(power(k.x - l.x, 2) + power(k.y - l.y, 2)) FOR l IN v.of] FOR k IN u.of]) AS d,
    sqrt(power(list_avg([k.x FOR k IN u.of]) - list_avg([l.x FOR l IN v.of]), 2) + power(list_avg([k.y FOR k IN u.of]) - list_avg([l.y FOR l IN v.of]), 2)) AS c
   FROM s u JOIN s v ON u.method = v.method AND u.seg = v.seg AND u.id < v.id),
  h AS (SELECT *, CASE method WHEN 'single' THEN list_min(d) WHEN 'complete' THEN list_max(d) WHEN 'average' THEN list_avg(d) ELSE c END AS height FROM p),
  t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY method, seg ORDER BY height, a, b) = 1)
  SELECT t.method, t.seg, t.step + 1, (SELECT max(m) FROM z WHERE z.seg = t.seg) + t.step, t.of, t.a, t.b, t.height FROM t
  UNION ALL SELECT s.method, s.seg, s.step + 1, s.id, s.of, NULL, NULL, NULL FROM s JOIN t ON s.method = t.method AND s.seg = t.seg AND s.id <> t.a AND s.id <> t.b))"""


@query(MERGES + " SELECT seg, CAST(step - 1 AS INTEGER) AS step, a, b, round(height, 6) AS height, CAST(len(of) AS INTEGER) AS size, method FROM s WHERE a IS NOT NULL")
def agglomerate(spark: S, d: str) -> DataFrame:
    out = None
    for m in ("single", "complete", "average", "centroid"):
        part = cluster.agglomerate(summaries(spark, d), "seg", "nation", ["price", "qty"], m).withColumn("method", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return rounded(out, height=6)


@query(MERGES + """, c AS (SELECT seg, CAST((SELECT max(m) FROM z WHERE z.seg = s.seg) - step AS INTEGER) AS k, len(of) * (list_var_pop([e.x FOR e IN of]) + list_var_pop([e.y FOR e IN of])) AS w FROM s WHERE method = 'average')
       SELECT seg, k, round(sum(w), 5) AS wcss FROM c WHERE k <= 10 GROUP BY 1, 2""")
def cut_wcss(spark: S, d: str) -> DataFrame:
    s = summaries(spark, d)
    cuts = cluster.cut_labels(cluster.agglomerate(s, "seg", "nation", ["price", "qty"], "average"), "seg", range(1, 11))
    numbered = s.withColumn("i", F.row_number().over(Window.partitionBy("seg").orderBy("nation")) - 1)
    return rounded(cluster.cut_wcss(cuts.join(numbered, ["seg", "i"]), ["price", "qty"], ["seg", "k"]), wcss=5)


@query("""WITH c AS (SELECT k, floor((p_size - 1) * k / 50) AS bin, p_retailprice AS y FROM part, range(1, 11) r(k)),
          w AS (SELECT k, sum(e) AS wcss FROM (SELECT k, (var_pop(y) * count(*))::DOUBLE AS e FROM c GROUP BY k, bin) GROUP BY k),
          e AS (SELECT min_by(wcss, k) AS w0, max_by(wcss, k) AS w1 FROM w)
          SELECT CAST(k AS BIGINT) AS k FROM w, e ORDER BY round(abs((w1 - w0) * (k - 1) - 9 * (wcss - w0)) / sqrt(81 + (w1 - w0) * (w1 - w0)), 9) DESC, k LIMIT 1""")
def elbow_k(spark: S, d: str) -> DataFrame:
    """Parts in 1 to 10 groups by size: how many, by the fall of the squared error of their prices."""
    c = table(spark, d, "part").select(F.col("p_retailprice").alias("y"), "p_size", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("k"))
    e = c.groupBy("k", F.floor((F.col("p_size") - 1) * F.col("k") / 50).alias("bin")).agg((F.var_pop("y") * F.count("*")).alias("e"))
    return cluster.elbow_k(e.groupBy("k").agg(F.sum("e").alias("wcss")))


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_nationkey * 7 % 25) - 1 AS INTEGER) AS label FROM customer")
def cluster_labels(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 7 % 25).alias("root"))
    return cluster.cluster_labels(c, "root").select("c_custkey", "label")


@query(f"WITH {V}, {CENTERS}, {ASSIGN}, k AS (SELECT cluster, label, count(*) AS n FROM A GROUP BY 1, 2) SELECT round(sum(m) / sum(t), 8) AS purity FROM (SELECT cluster, max(n) AS m, sum(n) AS t FROM k GROUP BY 1)")
def purity(spark: S, d: str) -> DataFrame:
    return rounded(cluster.purity(cluster.kmeans_assign(vectors(spark, d), centers(spark, d), EACH), "cluster", "label"), purity=8)


def places(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"))


NEARBY = """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_size AS x, p_partkey % 97 AS y FROM part),
e AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS w FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4)"""


@query(NEARBY + ", r AS (SELECT id, id AS c FROM p UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id) SELECT id, min(c) AS component FROM r GROUP BY 1")
def single_link_cut(spark: S, d: str) -> DataFrame:
    """All parts by size and the rest of their key, in groups no nearer to each other than 2."""
    return cluster.single_link_cut(places(spark, d), "id", ["x", "y"], 2.0)


#: Merges up to a height are as many as rows less components; distances here are roots of 0, 1, 2 and 4.
LEVEL = "r{n} AS (SELECT {n} AS n, id, id AS c FROM p UNION SELECT {n}, e.b, r{n}.c FROM r{n} JOIN e ON e.a = r{n}.id WHERE w * w < {n} + 0.5)"


@query(NEARBY + ", " + ", ".join(LEVEL.format(n=n) for n in (0, 1, 2, 4)) + """, c AS (SELECT n AS square, count(DISTINCT c) AS left_ FROM (""" + " UNION ALL ".join(f"SELECT n, id, min(c) AS c FROM r{n} GROUP BY 1, 2" for n in (0, 1, 2, 4)) + """) GROUP BY 1)
       SELECT * FROM (SELECT round(sqrt(square), 6) AS height, coalesce(lag(left_) OVER (ORDER BY square), (SELECT count(*) FROM p)) - left_ AS n FROM c) WHERE n > 0""")
def single_link_forest(spark: S, d: str) -> DataFrame:
    """How many of the parts' single-linkage merges up to a height of 2 there are at each height."""
    forest = cluster.single_link_forest(places(spark, d), "id", ["x", "y"], 2.0)
    return forest.groupBy(F.round("w", 6).alias("height")).agg(F.count("*").alias("n"))


# Classification measures

SC = "s AS (SELECT n_chars::DOUBLE AS score, quality AS y FROM documents JOIN labels USING (doc_id))"
COUNTS = f"WITH {SC}, c AS (SELECT count(*) FILTER (score > 1500 AND y = 1) AS tp, count(*) FILTER (score > 1500 AND y <> 1) AS fp, count(*) FILTER (score <= 1500 AND y <> 1) AS tn, count(*) FILTER (score <= 1500 AND y = 1) AS fn FROM s)"
MCC = "(tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0)"
RATES = f"""CASE WHEN tp + fp + tn + fn = 0 THEN 0 ELSE (tp + tn)::DOUBLE / (tp + fp + tn + fn) END AS acc, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS prec,
 CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS rec, {MCC} AS mcc, CASE WHEN fp + tn = 0 THEN 0 ELSE fp::DOUBLE / (fp + tn) END AS fpr"""
SWEEPS = f"""WITH {SC}, g AS (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM s GROUP BY 1),
r AS (SELECT (score + lead(score) OVER (ORDER BY score)) / 2 AS t, sum(pos) OVER o AS fn, sum(neg) OVER o AS tn, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW o AS (ORDER BY score ROWS UNBOUNDED PRECEDING)),
k AS (SELECT t, (p - fn)::DOUBLE AS tp, (n - tn)::DOUBLE AS fp, tn::DOUBLE AS tn, fn::DOUBLE AS fn FROM r WHERE t IS NOT NULL), m AS (SELECT t, tp, fp, tn, fn, {RATES} FROM k)"""


@query(COUNTS + " SELECT * FROM c")
def confusion_counts(spark: S, d: str) -> DataFrame:
    return evaluate.confusion_counts(scored(spark, d), "score", "quality", 1500)


@query(COUNTS + f" SELECT round(acc, 8) AS acc, round(prec, 8) AS prec, round(rec, 8) AS rec, round(CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END, 8) AS f1 FROM (SELECT {RATES} FROM c)")
def classification_metrics(spark: S, d: str) -> DataFrame:
    m = evaluate.classification_metrics(evaluate.confusion_counts(scored(spark, d), "score", "quality", 1500))
    return rounded(m.select("acc", "prec", "rec", "f1"), acc=8, prec=8, rec=8, f1=8)


@query(COUNTS + f" SELECT round({MCC}, 8) AS mcc FROM c", name="mcc")
def matthews(spark: S, d: str) -> DataFrame:
    return rounded(evaluate.classification_metrics(evaluate.confusion_counts(scored(spark, d), "score", "quality", 1500)).select("mcc"), mcc=8)


@query(SWEEPS + " SELECT t, tp, fp, tn, fn, round(acc, 8) AS acc, round(prec, 8) AS prec, round(rec, 8) AS rec, round(mcc, 8) AS mcc, round(fpr, 8) AS fpr FROM m")
def threshold_sweep(spark: S, d: str) -> DataFrame:
    s = evaluate.threshold_sweep(scored(spark, d), "score", "quality").select("t", *[F.col(c).cast("double").alias(c) for c in ("tp", "fp", "tn", "fn")], "acc", "prec", "rec", "mcc", "fpr")
    return rounded(s, acc=8, prec=8, rec=8, mcc=8, fpr=8)


@query(SWEEPS + " SELECT t, round(fpr, 8) AS fpr, round(rec, 8) AS tpr FROM m")
def roc_points(spark: S, d: str) -> DataFrame:
    return rounded(evaluate.roc_points(evaluate.threshold_sweep(scored(spark, d), "score", "quality")), fpr=8, tpr=8)


@query(SWEEPS + " SELECT t, round(rec, 8) AS recall, round(prec, 8) AS precision FROM m")
def pr_points(spark: S, d: str) -> DataFrame:
    return rounded(evaluate.pr_points(evaluate.threshold_sweep(scored(spark, d), "score", "quality")), recall=8, precision=8)


@query(SWEEPS + ", z AS (SELECT (lead(fpr) OVER o - fpr) * rec AS l, (lead(fpr) OVER o - fpr) * (rec + lead(rec) OVER o) / 2 AS q FROM m WINDOW o AS (ORDER BY t)) SELECT round(abs(sum(l)), 7) AS auc, round(abs(sum(q)), 7) AS auc_trapezoid FROM z")
def auc_left_riemann(spark: S, d: str) -> DataFrame:
    return rounded(evaluate.auc_left_riemann(evaluate.threshold_sweep(scored(spark, d), "score", "quality")), auc=7, auc_trapezoid=7)


@query(f"WITH {SC} SELECT round(avg((y = CASE WHEN score > 1500 THEN 1 ELSE 0 END)::INT), 8) AS accuracy, count(*) AS n FROM s")
def accuracy(spark: S, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("pred", (F.col("score") > 1500).cast("int"))
    return rounded(evaluate.accuracy(s, "quality", "pred"), accuracy=8)


# Sequences

NEXT = "WITH x AS (SELECT event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS next_state FROM events), c AS (SELECT state, next_state, count(*) AS n FROM x WHERE next_state IS NOT NULL GROUP BY 1, 2)"


@query(NEXT + " SELECT * FROM c")
def transition_counts(spark: S, d: str) -> DataFrame:
    return sequence.transition_counts(table(spark, d, "events"), "user_id", "ts", "event_type")


@query(NEXT + ", s AS (SELECT DISTINCT event_type AS state FROM events), m AS (SELECT a.state, b.state AS next_state, coalesce(n, 0) AS n FROM s a CROSS JOIN s b LEFT JOIN c ON c.state = a.state AND c.next_state = b.state) SELECT state, next_state, n, round(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY state), 0), 8) AS p FROM m")
def transition_matrix(spark: S, d: str) -> DataFrame:
    return rounded(sequence.transition_matrix(table(spark, d, "events"), "user_id", "ts", "event_type"), p=8)


# Images

CELLS = "WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS v FROM embeddings)"
POOL = CELLS + " SELECT vec_id, CAST((p // 8) // 2 AS INTEGER) AS i, CAST((p % 8) // 2 AS INTEGER) AS j, round(avg(v), 6) AS v FROM x GROUP BY 1, 2, 3"


@query(POOL)
def array_grid_pool(spark: S, d: str) -> DataFrame:
    return rounded(image.array_grid_pool(table(spark, d, "embeddings"), "vec_id", "embedding", 8, 8, 4), v=6)


@query(POOL)
def array_grid_batch(spark: S, d: str) -> DataFrame:
    return rounded(image.array_grid_batch(table(spark, d, "embeddings"), "vec_id", "embedding", 8, 8, 4), v=6)


@query(CELLS + """, g AS (SELECT vec_id, p // 8 AS y, p % 8 AS x, v FROM x) SELECT c.vec_id, CAST(c.y AS INTEGER) AS y, CAST(c.x AS INTEGER) AS x, round(sum(n.v * CASE n.x - c.x WHEN -1 THEN -1 WHEN 1 THEN 1 ELSE 0 END * CASE WHEN n.y = c.y THEN 2 ELSE 1 END), 5) AS v
          FROM g c JOIN g n ON c.vec_id = n.vec_id AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1 WHERE c.y BETWEEN 1 AND 6 AND c.x BETWEEN 1 AND 6 GROUP BY 1, 2, 3""")
def array_grid_conv(spark: S, d: str) -> DataFrame:
    return rounded(image.array_grid_conv(table(spark, d, "embeddings"), "vec_id", "embedding", 8, 8, image.SOBEL_X.tolist()), v=5)


def pictures(spark: S, d: str) -> DataFrame:
    """Embeddings as 8 x 8 pictures with 0 to 255 in each channel."""
    level = lambda x, s: F.least(F.greatest((x.cast("double") * s + 0.5) * 255, F.lit(0.0)), F.lit(255.0))
    rgb = F.flatten(F.transform("embedding", lambda x: F.array(level(x, 1.0), level(x, 0.5), level(x, -1.0))))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), rgb.alias("rgb"))


#: Pictures in SQL: a row per pixel with its channels and its grey.
PIX = """WITH e AS (SELECT vec_id AS image_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS v FROM embeddings),
c AS (SELECT image_id, p // 8 AS y, p % 8 AS x, least(greatest((v + 0.5) * 255, 0), 255)::DOUBLE AS r, least(greatest((v * 0.5 + 0.5) * 255, 0), 255)::DOUBLE AS g, least(greatest((0.5 - v) * 255, 0), 255)::DOUBLE AS b FROM e),
px AS (SELECT *, r * 0.299::FLOAT::DOUBLE + g * 0.587::FLOAT::DOUBLE + b * 0.114::FLOAT::DOUBLE AS gray, greatest(r, g, b) AS top, least(r, g, b) AS low FROM c)"""


def edges_sql(name: str, rows: str, first: str, height: int) -> str:
    """(image_id, v): mean size of the Sobel gradient over ``height`` rows of pixels from ``first``."""
    return f"""{name}f AS (SELECT a.image_id, a.y, a.x, sum(n.gray * (n.x - a.x) * CASE WHEN n.y = a.y THEN 2 ELSE 1 END) AS gx, sum(n.gray * (n.y - a.y) * CASE WHEN n.x = a.x THEN 2 ELSE 1 END) AS gy
 FROM {rows} a JOIN {rows} n ON a.image_id = n.image_id AND abs(n.y - a.y) <= 1 AND abs(n.x - a.x) <= 1 WHERE a.y BETWEEN {first} + 1 AND {first} + {height} - 2 AND n.y BETWEEN {first} AND {first} + {height} - 1 AND a.x BETWEEN 1 AND 6 GROUP BY 1, 2, 3),
{name} AS (SELECT image_id, sum(sqrt(gx * gx + gy * gy)) / ({height} * 8.0) AS v FROM {name}f GROUP BY 1)"""


def kernel(spark: S, d: str, names: list[str], f, places: int = 3) -> DataFrame:
    out = image.pixel_kernel(pictures(spark, d), names, f)
    return rounded(out, **{c: places for c in names})


@query(f"{PIX}, {edges_sql('ed', 'px', '0', 8)} SELECT image_id, round(avg(r), 3) AS mean_r, round(avg(g), 3) AS mean_g, round(avg(b), 3) AS mean_b, round(avg(gray), 3) AS brightness, round(stddev_pop(gray), 3) AS contrast, round(any_value(v), 3) AS edge_density FROM px JOIN ed USING (image_id) GROUP BY 1")
def color_stats(spark: S, d: str) -> DataFrame:
    return kernel(spark, d, image.BASIC[:6], image.color_stats)


@query(f"{PIX}, {edges_sql('ed', 'px', '0', 8)} SELECT image_id, round(v, 3) AS edge_density FROM ed")
def edge_density(spark: S, d: str) -> DataFrame:
    return kernel(spark, d, ["edge_density"], lambda a: [image.edge_density(image.gray_of(a))])


@query(f"{PIX} SELECT image_id, " + ", ".join(f"round(avg(({c} >= {64 * i} AND {c} {'<' if i < 3 else '<='} {64 * (i + 1)})::INT), 6) AS hist_{c}_{i}" for c in "rgb" for i in range(4)) + " FROM px GROUP BY 1")
def channel_hist(spark: S, d: str) -> DataFrame:
    return kernel(spark, d, image.BASIC[6:], image.channel_hist, 6)


@query(f"""{PIX}, {edges_sql('et', 'px', '0', 2)}, {edges_sql('eb', 'px', '6', 2)} SELECT image_id, round(avg(gray) FILTER (y < 2), 3) AS sky_brightness, round(avg(b) FILTER (y < 2) / (avg(r) FILTER (y < 2) + 1e-6::DOUBLE), 3) AS sky_blue_ratio,
       round(avg((g > r + 8 AND g > b + 8)::INT), 3) AS green_fraction, round(avg((top - low) / (top + 1e-6::DOUBLE)), 3) AS saturation_mean, round((avg(r * r) + avg(g * g) + avg(b * b)) / 3 - power((avg(r) + avg(g) + avg(b)) / 3, 2), 3) AS pixel_variance,
       round(avg((gray < 80)::INT) FILTER (y BETWEEN 2 AND 4 AND x BETWEEN 2 AND 4), 3) AS center_dark_ratio, round(coalesce(any_value(et.v), 0), 3) AS edge_top, round(coalesce(any_value(eb.v), 0), 3) AS edge_bottom
       FROM px LEFT JOIN et USING (image_id) LEFT JOIN eb USING (image_id) GROUP BY 1""")
def region_stats(spark: S, d: str) -> DataFrame:
    return kernel(spark, d, image.REGIONS, image.region_stats)


@query(f"{PIX} SELECT image_id, sqrt(count(*)) AS side, round(avg(r), 3) AS mean_r, round(avg(g), 3) AS mean_g, round(avg(b), 3) AS mean_b FROM px WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY 1")
def center_crop(spark: S, d: str) -> DataFrame:
    return kernel(spark, d, ["side", "mean_r", "mean_g", "mean_b"], lambda a: [image.center_crop(a).shape[0], *image.center_crop(a).mean(axis=(0, 1))])


@query(f"{PIX}, f AS (SELECT image_id, 128 / greatest(avg(gray), 1e-6) AS f FROM px GROUP BY 1) SELECT image_id, round(avg(least(greatest(r * f, 0), 255)), 2) AS mean_r, round(avg(least(greatest(g * f, 0), 255)), 2) AS mean_g, round(avg(least(greatest(b * f, 0), 255)), 2) AS mean_b FROM px JOIN f USING (image_id) GROUP BY 1")
def brightness_normalize(spark: S, d: str) -> DataFrame:
    return kernel(spark, d, ["mean_r", "mean_g", "mean_b"], lambda a: image.brightness_normalize(a).mean(axis=(0, 1)), 2)


@query(f"""{PIX}, h AS (SELECT image_id, top, top - low AS span, CASE WHEN top = low THEN 0 WHEN top = b THEN (r - g) / (top - low) + 4 WHEN top = g THEN (b - r) / (top - low) + 2 ELSE (g - b) / (top - low) + CASE WHEN g < b THEN 6 ELSE 0 END END / 6 AS hue FROM px)
       SELECT image_id, round(avg(hue % 1.0), 4) AS hue_mean, round(stddev_pop(hue % 1.0), 4) AS hue_std, round(avg(CASE WHEN top > 0 THEN span / top ELSE 0 END), 4) AS sat_mean, round(avg(top / 255), 4) AS val_mean FROM h GROUP BY 1""")
def hsv_stats(spark: S, d: str) -> DataFrame:
    return kernel(spark, d, image.HSV, image.hsv_stats, 4)


@query(f"""{PIX}, w AS (SELECT i, j, z / sum(z) OVER (PARTITION BY i) AS z FROM (SELECT i, j, greatest(0, 1 - abs(j + 0.5 - (i + 0.5) * 2) / 2)::DOUBLE AS z FROM range(4) a(i), range(8) b(j)))
       SELECT image_id, v.i * 4 + h.i AS cell, round(sum(gray * v.z * h.z), 2) AS gray FROM px JOIN w v ON v.j = y JOIN w h ON h.j = x GROUP BY 1, 2""")
def resize_bilinear(spark: S, d: str) -> DataFrame:
    """Halved pictures, a row for each pixel's grey."""
    wide = image.pixel_kernel(pictures(spark, d), [f"g{i}" for i in range(16)], lambda a: image.gray_of(image.resize_bilinear(a, 4)).ravel())
    cells = F.posexplode(F.array(*[F.col(f"g{i}") for i in range(16)])).alias("cell", "gray")
    return rounded(wide.select("image_id", cells).withColumn("cell", F.col("cell").cast("long")), gray=2)


POOLS = {"sobel_x": "abs(gx)", "sobel_y": "abs(gy)", "bright": "gray", "blue_dom": "b / greatest(r + g + b, 1e-6)", "green_dom": "g / greatest(r + g + b, 1e-6)", "red_dom": "r / greatest(r + g + b, 1e-6)"}


@query(f"{PIX}, {edges_sql('ed', 'px', '0', 8)}, f AS (SELECT px.*, coalesce(gx, 0) AS gx, coalesce(gy, 0) AS gy FROM px LEFT JOIN edf USING (image_id, y, x)) SELECT image_id, " + ", ".join(f"round(avg({e}) FILTER (y // 2 = {i} AND x // 2 = {j}), 3) AS {m}_{i}{j}" for m, e in POOLS.items() for i in range(4) for j in range(4)) + " FROM f GROUP BY 1")
def filter_bank_pool(spark: S, d: str) -> DataFrame:
    return kernel(spark, d, image.SPATIAL, image.filter_bank_pool)


@query()
def image_features(spark: S, d: str) -> DataFrame:
    out = image.pixel_features(pictures(spark, d))
    return out.select("image_id", *[F.round(c, 3).alias(c) for c in out.columns if c != "image_id"])


#: Header of an 8 x 8 bitmap of 24 bits: the signature, a size that is large enough and where pixels begin, then 40 bytes on the picture.
BITMAP = [66, 77, 0, 1, *[0] * 6, 54, 0, 0, 0, 40, 0, 0, 0, 8, 0, 0, 0, 8, 0, 0, 0, 1, 0, 24, *[0] * 25]


def picture_files(spark: S, d: str) -> str:
    """A folder with an 8 x 8 bitmap for each embedding; of every ninth only 40 or 100 bytes, in turn.

    Levels go to 127, so a file's bytes are characters too, and Spark's writer
    of texts makes a file for each in its own folder.
    """
    folder = scratch(spark)
    level = lambda v, s: F.floor(F.least(F.greatest(v.cast("double") * s + 0.5, F.lit(0.0)), F.lit(1.0)) * 127).cast("int")
    up = F.flatten(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda y: F.slice("embedding", y * 8 + 1, F.lit(8))))
    # from the last line to the first, blue before green before red
    data = F.flatten(F.transform(up, lambda v: F.array(level(v, -1.0), level(v, 0.5), level(v, 1.0))))
    text = F.array_join(F.transform(F.concat(F.array(*[F.lit(b) for b in BITMAP]), data), lambda b: F.char(b)), "")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), text.alias("value"))
    cut = F.when(F.col("image_id") % 18 == 4, 40).when(F.col("image_id") % 18 == 13, 100)
    rows = rows.withColumn("value", F.when(cut.isNotNull(), F.substring("value", F.lit(1), cut)).otherwise(F.col("value")))
    rows.repartition("image_id").write.partitionBy("image_id").text(folder)
    return folder


@query("""SELECT vec_id AS image_id, CASE WHEN vec_id % 9 <> 4 THEN 8 ELSE -1 END AS height, CASE WHEN vec_id % 9 <> 4 THEN 8 ELSE -1 END AS width, CASE WHEN vec_id % 9 <> 4 THEN 3 ELSE -1 END AS channels,
          CASE WHEN vec_id % 9 <> 4 THEN flatten([[CAST(floor(least(greatest(embedding[i]::DOUBLE * s + 0.5, 0), 1) * 127) AS INTEGER) FOR s IN [1.0::DOUBLE, 0.5::DOUBLE, -1.0::DOUBLE]] FOR i IN range(1, 65)]) ELSE []::INTEGER[] END AS rgb FROM embeddings""")
def read_images(spark: S, d: str) -> DataFrame:
    """Bitmap files of the embeddings as Spark's image source reads them, their pixels from red on; files cut short have no pixels."""
    images = tabular.read_images(spark, picture_files(spark, d), r"image_id=(\d+)/")
    return images.select("image_id", *[F.col(f"image.{c}").alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"))], F.coalesce(image.rgb_of("image"), F.array().cast("array<int>")).alias("rgb"))


@query("SELECT count(*) AS n, count(*) FILTER (vec_id % 9 = 4) AS failed FROM embeddings")
def feature_failures(spark: S, d: str) -> DataFrame:
    """Features of picture files, some of them cut short."""
    images = tabular.read_images(spark, picture_files(spark, d), r"image_id=(\d+)/")
    return image.feature_failures(image.image_features(images, ["base"]))


# Jobs


@query()
def flagship(spark: S, d: str) -> DataFrame:
    """Split, encode, scale, fit and score: constant, linear and tree models of order prices, one metric row each."""
    x = profile.group_mean_fallback(listings(spark, d), "nation", "price", train_rows(), "nation_mean")
    feats = [*FEATS, "nation_mean"]
    # every model and level reads these rows, so they are made once
    x = checkpointed(minmax_fit_apply(x.withColumns({c: F.col(c).cast("double") for c in feats}), feats, train_rows()))
    weights, lin = linear.linear_fit_predict(x, feats, "price", train_rows())
    nodes = tree.tree_fit_regression(x.where(train_rows()), ["qty", "items"], "price", 3, 10)
    models = {"constant": linear.constant_baseline(x, "price", train_rows()), "linear": lin, "tree": tree.tree_predict(x, nodes, ["qty", "items"])}
    p = None
    for name, df in models.items():
        part = df.where("split = 'test'").select(F.lit(name).alias("model"), "id", "price", "pred")
        p = part if p is None else p.unionByName(part)
    return rounded(profile.regression_metrics(p, "price", "pred", ["model"]), mae=2, rmse=2, sse=-6, median_abs=2, max_abs=2, within_50k=6, within_100k=6, within_200k=6)
