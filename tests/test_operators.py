"""Operators against small NumPy versions, and their cases of ties, nulls and empty tables."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oremill.functions.columns import city_base_name, first_match_in_json_array, mcc, money_label
from oremill.operators import clean, cluster, dense, evaluate, hierarchy, image, linear, neighbours, prep, profile, ranking, selection, sequence, tree
from oremill.sources import tabular
from oremill.streaming import lookup


def test_split_exact_sizes(spark):
    n = {r[0]: r[1] for r in prep.split_exact(spark.range(15474), "id").groupBy("split").count().collect()}
    assert n == {"train": 10058, "val": 2321, "test": 3095}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_rank_does_not_depend_on_partitions(spark, parts):
    df = spark.range(500).withColumn("v", F.col("id") % 13)
    got = {r["id"]: r["rank"] for r in ranking.distributed_rank(df, ["v", "id"], partitions=parts).collect()}
    want = sorted(range(500), key=lambda i: (i % 13, i))
    assert all(got[i] == k + 1 for k, i in enumerate(want))


def test_scalers_on_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0, True), (3.0, 5.0, True), (9.0, 6.0, False)], "a double, b double, t boolean")
    assert [tuple(r)[:2] for r in prep.minmax_fit_apply(df, ["a", "b"], F.col("t")).orderBy("a").collect()] == [(0.0, 0.0), (1.0, 0.0), (4.0, 1.0)]
    assert [tuple(r)[:2] for r in prep.zscore_fit_apply(df, ["a", "b"], F.col("t")).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0), (7.0, 1.0)]


def test_linear_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.5, -2.0, 0.5] + 4 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(int(i % 2), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "g int, a double, b double, c double, y double")
    w = {r["feature"]: r["weight"] for r in linear.linear_fit_predict(df, ["a", "b", "c"], "y", F.lit(True))[0].collect()}
    want = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)[0]
    assert np.allclose([w["intercept"], w["a"], w["b"], w["c"]], want, atol=1e-4)
    by = linear.linear_fit_predict(df, ["a", "b", "c"], "y", F.lit(True), by=["g"])[0]
    for g in (0, 1):
        own = {r["feature"]: r["weight"] for r in by.where(f"g = {g}").collect()}
        assert np.allclose(own["a"], np.linalg.lstsq(np.c_[np.ones(100), x[g::2]], y[g::2], rcond=None)[0][1], atol=1e-4)


def test_grid_search_stays_at_closed_form(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1 + (i % 3)) for i in range(30)], "x double, y double")
    c = linear.slr_closed_form(df, "x", "y").head()
    g = linear.sse_grid_search(profile.sufficient_stats(df, "x", "y"), c["beta"] + 0.01, c["alpha"] - 0.1).head()
    assert g["sse"] == pytest.approx(c["sse"], rel=0.05) and g["rounds"] <= 50


@pytest.mark.parametrize("metric", neighbours.METRICS)
def test_blocked_neighbours_equal_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(80, 2)), 1)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = neighbours.knn_join(df.where("id < 20"), df.where("id >= 20"), "id", ["a", "b"], 5, (metric,), per_block=7)
    got = {(r["qid"], r["rank"]): r["tid"] for r in got.collect()}
    d = neighbours._distances(x[:20], x[20:], metric, 3.0)
    for q in range(20):
        assert [got[q, k + 1] for k in range(5)] == [20 + i for i in np.argsort(d[q], kind="stable")[:5]]


def test_votes_break_ties_by_label(spark):
    n = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a")], "qid long, rank int, label string")
    assert {r["k"]: r["pred"] for r in neighbours.votes(n, "label", [1, 4]).collect()} == {1: "b", 4: "a"}


def grow(x, y, depth, least, node=1):
    out = {node: (len(y), y.mean())}
    if depth == 0 or len(y) < 2 * least or ((y - y.mean()) ** 2).sum() < 1e-9:
        return out
    best = None
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for t in (v[1:] + v[:-1]) / 2:
            left = x[:, f] <= t
            if least <= left.sum() <= len(y) - least:
                gain = ((y - y.mean()) ** 2).sum() - ((y[left] - y[left].mean()) ** 2).sum() - ((y[~left] - y[~left].mean()) ** 2).sum()
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, t)
    if best is None or best[0] <= 0:
        return out
    left = x[:, best[1]] <= best[2]
    return out | grow(x[left], y[left], depth - 1, least, 2 * node) | grow(x[~left], y[~left], depth - 1, least, 2 * node + 1)


def test_tree_by_levels_equals_recursion(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.uniform(size=(150, 2)) * 20)
    y = np.where(x[:, 0] > 9, 5.0, 0.0) + np.where(x[:, 1] > 4, 2.0, 0.0) + rng.normal(size=150)
    df = spark.createDataFrame([(float(a), float(b), float(v)) for (a, b), v in zip(x, y, strict=True)], "a double, b double, y double")
    nodes = tree.tree_fit_regression(df, ["a", "b"], "y", 4, 5)
    want = grow(x, y, 4, 5)
    assert {r["node_id"]: r["n"] for r in nodes.collect()} == {k: v[0] for k, v in want.items()}
    p = tree.tree_predict(df, nodes, ["a", "b"])
    assert p.where("pred is null").count() == 0
    flat = tree.tree_predict(df, nodes, ["a", "b"], depth=0).select("pred").distinct().collect()
    assert [r[0] for r in flat] == [pytest.approx(y.mean())]


def test_rounds_of_joins_keep_the_true_size(spark):
    df = ranking.checkpointed(spark.range(200).withColumn("c", F.col("id")))
    for _ in range(25):
        root = df.select(F.col("id").alias("c"), F.col("c").alias("r"))
        df = ranking.checkpointed(df.join(root, "c").select("id", F.col("r").alias("c")))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20
    assert df.where("c = id").count() == 200


PLAY = """sunny hot high f n;sunny hot high t n;overcast hot high f y;rain mild high f y;rain cool normal f y;rain cool normal t n;overcast cool normal t y;
sunny mild high f n;sunny cool normal f y;rain mild normal f y;sunny mild normal t y;overcast mild high t y;overcast hot normal f y;rain mild high t n"""


def test_id3_on_the_weather_table(spark):
    rows = [tuple(r.split()) for r in PLAY.replace("\n", "").split(";")]
    df = spark.createDataFrame(rows, "outlook string, temp string, humidity string, windy string, play string")
    attrs = ["outlook", "temp", "humidity", "windy"]
    g = {r["attr"]: r for r in tree.id3_gain(df.withColumn("path", F.lit("")), attrs, "play").collect()}
    assert g["outlook"]["entropy"] == pytest.approx(0.940, abs=1e-3) and g["outlook"]["gain"] == pytest.approx(0.247, abs=1e-3)
    fitted = tree.id3_fit(df, attrs, "play").collect()
    leaves = {r["path"]: r["leaf"] for r in fitted if r["leaf"]}
    assert leaves == {"/outlook=overcast": "y", "/outlook=sunny/humidity=high": "n", "/outlook=sunny/humidity=normal": "y", "/outlook=rain/windy=f": "y", "/outlook=rain/windy=t": "n"}


def test_entropy_tree_separates(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), int(i > 11)) for i in range(24)], "a double, b double, y int")
    nodes = tree.tree_fit_entropy(df, ["a", "b"], "y")
    assert nodes.count() == 3 and nodes.where("node_id = 1").head()["thr"] == 11.5
    assert evaluate.accuracy(tree.tree_classify(df, nodes, ["a", "b"]), "y", "pred").head()["accuracy"] == 1.0


def test_kmeans_falls_and_keeps_empty_clusters(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(30, 2)), rng.normal(size=(30, 2)) + 8])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    start = cluster.centroid_table(spark, np.array([[0.0, 0.0], [8.0, 8.0], [99.0, 99.0]]))
    step = {r["cluster"]: r["center"] for r in cluster.kmeans_step(df, start, ["a", "b"]).collect()}
    assert step[2] == [99.0, 99.0] and np.allclose(step[0], x[:30].mean(axis=0))
    rows, _, cost = cluster.kmeans_fit(df, ["a", "b"], 2, 50)
    assert cost == pytest.approx(rows.agg(F.sum("d2")).head()[0]) and rows.groupBy("cluster").count().where("count = 30").count() == 2
    sweep = [r["wcss"] for r in cluster.kmeans_k_sweep(df, ["a", "b"], range(1, 4), 3).orderBy("k").collect()]
    assert sweep[0] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum()) and sweep[0] > sweep[1] > sweep[2]


def greedy(x, method):
    """Heights of the closest pair's merges, by distances between all rows."""
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    groups, out = [[i] for i in range(len(x))], []
    far = {"single": lambda a, b: d[np.ix_(a, b)].min(), "complete": lambda a, b: d[np.ix_(a, b)].max(), "average": lambda a, b: d[np.ix_(a, b)].mean(), "centroid": lambda a, b: np.sqrt(((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum())}[method]
    m = np.array([[far(a, b) if a != b else np.inf for b in groups] for a in groups])
    while len(groups) > 1:
        i, j = sorted(divmod(int(m.argmin()), len(groups)))
        out.append(m[i, j])
        groups[i] = groups[i] + groups[j]
        del groups[j]
        m = np.delete(np.delete(m, j, 0), j, 1)
        for k, g in enumerate(groups):
            m[i, k] = m[k, i] = far(groups[i], g) if k != i else np.inf
    return out


@pytest.mark.parametrize("method", ["single", "complete", "average", "centroid"])
@pytest.mark.parametrize("table", [4000, 20])
def test_linkages_equal_the_greedy_loop(method, table, monkeypatch):
    monkeypatch.setattr(hierarchy, "TABLE", table)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(60, 3)) + 5])
    merges = hierarchy.LINKAGES[method](x)
    assert np.allclose([m[2] for m in merges], greedy(x, method)) and len({m[1] for m in merges} | {m[0] for m in merges}) == 120


def test_linkages_of_500_and_20000_rows():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 2))
    for method in hierarchy.LINKAGES:
        heights = [m[2] for m in hierarchy.LINKAGES[method](x)]
        d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        size, c, want = np.ones(500), x.copy(), []
        for _ in range(499):
            i, j = sorted(divmod(int(d.argmin()), 500))
            want.append(d[i, j])
            both = np.stack([d[i], d[j]])
            c[i] = (size[i] * c[i] + size[j] * c[j]) / (size[i] + size[j])
            new = {"single": both.min(axis=0), "complete": both.max(axis=0), "average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j]), "centroid": np.sqrt(((c - c[i]) ** 2).sum(axis=1))}[method]
            size[i] += size[j]
            new[np.isinf(both[0]) & np.isinf(both[1]) | np.isinf(both).any(axis=0)] = np.inf
            d[i] = d[:, i] = new
            d[j] = d[:, j] = np.inf
            d[i, i] = np.inf
        assert np.allclose(sorted(heights), sorted(want)), method
    big = np.concatenate([rng.normal(size=(10000, 2)), rng.normal(size=(10000, 2)) + 100])
    merges = hierarchy.single_linkage(big)
    assert len(merges) == 19999 and merges[-1][2] > 50 > merges[-2][2]


def mst_heights(x, most):
    return np.sort(hierarchy.prim(x, most)[2])


@pytest.mark.parametrize("small", [1 << 18, 0])
def test_spanning_forest_over_cells_and_rounds(spark, small, monkeypatch):
    monkeypatch.setattr(hierarchy, "CELL", 20)
    monkeypatch.setattr(hierarchy, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.uniform(size=(300, 2)) * 10, rng.normal(size=(60, 2)) * 0.05 + 4, np.repeat(rng.uniform(size=(5, 2)) * 10, 6, axis=0), np.arange(40)[:, None] * [0.3, 0] + [20, 0]])
    df = spark.createDataFrame([(1000 - i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(5000, None, 1.0)], "id long, a double, b double")
    forest, label, rounds = hierarchy.spanning_forest(hierarchy.near_forests(df, "id", ["a", "b"], 0.7), small)
    print("rounds", rounds)
    assert rounds <= np.log2(len(x)) and (rounds > 0) == (small == 0)
    assert np.allclose(sorted(r["w"] for r in forest.collect()), mst_heights(x, 0.7))
    near = ((x[:, None] - x) ** 2).sum(axis=2) <= 0.49
    least = np.arange(len(x))[::-1] + 1000 - len(x) + 1
    while (new := np.where(near, least, 10**6).min(axis=1)).tolist() != least.tolist():
        least = new
    got = {r["id"]: r["c"] for r in label.collect()}
    assert all(got.get(1000 - i, 1000 - i) == least[i] for i in range(len(x)))
    cut = {r["id"]: r["component"] for r in hierarchy.single_link_cut(df, "id", ["a", "b"], 0.7).collect()} if small else None
    assert cut is None or cut == {5000: 5000, **{1000 - i: int(least[i]) for i in range(len(x))}}


def test_single_link_forest_equals_agglomeration(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(60, 2)) * 10
    df = spark.createDataFrame([(i, 0, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, g int, a double, b double")
    merges = [r["height"] for r in cluster.agglomerate(df, "g", "id", ["a", "b"], "single").orderBy("step").collect()]
    forest = [r["w"] for r in cluster.single_link_forest(df, "id", ["a", "b"]).orderBy("w").collect()]
    assert np.allclose(merges, forest)
    cut = cluster.single_link_cut(df, "id", ["a", "b"], 1.0)
    assert cut.select("component").distinct().count() == 60 - sum(h <= 1.0 for h in merges) and cut.count() == 60
    assert cluster.single_link_cut(df.where("false"), "id", ["a", "b"], 1.0).count() == 0


def test_rows_at_one_place_meet_once(spark, monkeypatch):
    rng = np.random.default_rng(25)
    x = rng.integers(0, 7, size=(4000, 2)) * [1.0, 3.0]
    df = spark.createDataFrame([(9000 - i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(9500, None, 1.0), (9501, -0.0, 0.0)], "id long, a double, b double")
    asked = []
    monkeypatch.setattr(hierarchy, "near_forests", lambda d, *a, made=hierarchy.near_forests: asked.append(d.count()) or made(d, *a))
    cut = {r["id"]: r["component"] for r in hierarchy.single_link_cut(df, "id", ["a", "b"], 1.0).collect()}
    heights = sorted(r["w"] for r in hierarchy.single_link_forest(df, "id", ["a", "b"], 1.0).collect())
    # before, all 4,001 rows met
    assert asked == [49, 49]
    x = np.concatenate([x, [[0.0, 0.0]]])
    ids = np.append(9000 - np.arange(4000), 9501)
    least = {b: ids[x[:, 1] == b].min() for b in set(x[:, 1])}
    assert cut == {9500: 9500} | {int(i): int(least[b]) for i, b in zip(ids, x[:, 1], strict=True)}
    assert np.allclose(heights, mst_heights(x, 1.0))


def test_linkages_by_hand(spark):
    df = spark.createDataFrame([(0, "s", 0.0), (1, "s", 1.0), (2, "s", 3.0), (3, "s", 7.0)], "id long, g string, a double")
    for method, heights in (("single", [1, 2, 4]), ("complete", [1, 3, 7]), ("average", [1, 2.5, 17 / 3]), ("centroid", [1, 2.5, 7 - 4 / 3])):
        got = [r["height"] for r in cluster.agglomerate(df, "g", "id", ["a"], method).orderBy("step").collect()]
        assert np.allclose(got, heights), method


def test_purity_is_one_for_equal_labels(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "p int, t string")
    assert cluster.purity(df, "p", "t").head()[0] == 1.0


def test_sweep_of_separable_scores(spark):
    df = spark.createDataFrame([(float(i), int(i >= 5)) for i in range(10)] + [(None, 1)], "s double, y int")
    s = evaluate.threshold_sweep(df, "s", "y")
    assert s.count() == 9 and s.where("t = 4.5").head()["mcc"] == pytest.approx(1.0)
    one = spark.createDataFrame([(1, 0, 0, 0)], "tp int, fp int, tn int, fn int").select(mcc(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])).head()[0]
    assert one is None


def test_transitions_of_a_hand_made_sequence(spark):
    df = spark.createDataFrame([("q", i, s) for i, s in enumerate("SSRC")] + [("r", 0, "S")], "seq string, pos int, state string")
    m = {(r["state"], r["next_state"]): r["p"] for r in sequence.transition_matrix(df, "seq", "pos", "state").collect()}
    assert m["S", "S"] == 0.5 and m["S", "R"] == 0.5 and m["R", "C"] == 1.0 and m["C", "S"] is None and len(m) == 9
    after = {r["state"]: r["share"] for r in ranking.lead_lag_condition(df, "seq", "pos", "state", "S", "before").collect()}
    assert after == {"S": 1.0}


def test_labels_and_names(spark):
    row = spark.createDataFrame([("Los Angeles , CA",)], "c string").select(city_base_name(F.col("c")), money_label(F.lit(1234567.0)), money_label(F.lit(340000.0)), money_label(F.lit(75.0))).head()
    assert tuple(row) == ("Los Angeles", "$1.2M", "$340k", "$75")


@pytest.mark.parametrize(("text", "lat"), [('[{"lat":"34.1","lon":"-118.2"}]', 34.1), ('[{"lat":"1","lon":"2"},{"lat":"33","lon":"-117"}]', 33.0), ('[{"lat":"1","lon":"2"}]', None), ("[]", None), (None, None)])
def test_first_match(spark, text, lat):
    got = spark.createDataFrame([(text,)], "t string").select(first_match_in_json_array(F.col("t"), clean.BOX)["lat"]).head()[0]
    assert got == lat


def test_box_violations_hold_nulls(spark):
    df = spark.createDataFrame([(34.0, -118.0), (None, -118.0), (32.0, -121.0), (40.0, -118.0)], "lat double, lon double")
    assert clean.bbox_filter(df, "lat", "lon").count() == 2 and clean.bbox_violations(df, "lat", "lon").count() == 2


def test_conjunctive_pick_falls_back(spark):
    df = spark.createDataFrame([(2, 5), (1, 7), (3, None)], "id int, v int")
    assert clean.conjunctive_pick(df, [F.col("v") > 100, F.col("v") > 4], "id").head()["id"] == 1


def test_metrics_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "y double, p double")
    assert profile.regression_metrics(empty, "y", "p").head()["n"] == 0
    assert profile.hist_equal_width(empty, "y", 5).count() == 0


def test_histograms_close_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    assert {r["bin"]: r["n"] for r in profile.hist_equal_width(df, "x", 5).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    assert {r["bin"]: r["n"] for r in profile.hist_fixed_edges(df, "x", 2.0, 8.0, 2.0).collect()} == {0: 2, 1: 2, 2: 3}


def test_numeric_csv_judges_whole_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n3\n4,x\n5,6,7\n8,9\n\n")
    got = tabular.read_numeric_csv(spark, str(tmp_path), 2)
    assert got.select("c0").count() == 2 and sorted(map(tuple, got.collect())) == [(1.0, 2.0), (8.0, 9.0)]


def test_labeled_points_default(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2,x\n\n3,4\n")
    assert sorted(map(tuple, tabular.read_labeled_points(spark, str(tmp_path), 2, "0").collect())) == [(1.0, 2.0, "x"), (3.0, 4.0, "0")]


def test_last_version_wins_and_skips(spark, tmp_path):
    keys = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    cache = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "k string, v int, x string")
    out = tabular.incremental_lookup(keys, cache, lambda m: m.select("k", F.lit(1).alias("v"), F.lit("got").alias("x")), "k", "v")
    assert {r["k"]: r["x"] for r in out.collect()} == {"a": "new", "b": "got"}
    path = str(tmp_path / "t")
    assert tabular.skip_if_exists(spark, path, lambda: keys) and not tabular.skip_if_exists(spark, path, lambda: 1 / 0)


def test_lookup_follows_files(spark, tmp_path):
    source, enrich = str(tmp_path / "in"), lambda k: k.select("key", F.lit(1).alias("version"), F.concat("key", F.lit("!")).alias("x"))
    for batch in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(k,) for k in batch], "key string").write.mode("append").parquet(source)
        lookup.follow(spark, source, "key string", str(tmp_path / "out"), str(tmp_path / "check"), enrich, "key", "version")
    assert sorted(r["key"] for r in lookup.read_lookup(spark, str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_lookup_rewrites_only_touched_buckets(spark, tmp_path):
    table, asked = str(tmp_path / "t"), []

    def enrich(k):
        asked.append(sorted(r[0] for r in k.collect()))
        return k.select("key", F.lit(1).alias("version"), F.concat("key", F.lit("!")).alias("x"))

    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    first = lookup.merge(keys(*map(str, range(40)), None), 0, table, enrich, "key", "version", 8)
    assert first == list(range(8))
    assert lookup.merge(keys("1", "2"), 1, table, enrich, "key", "version", 8) == [] and len(asked) == 1
    touched = lookup.merge(keys("2", "new"), 2, table, enrich, "key", "version", 8)
    assert len(touched) == 1 and asked[-1] == ["new"]
    assert lookup.manifest(spark, table) == dict.fromkeys(range(8), 0) | {touched[0]: 2}
    # the same batch again, as after a failure before its manifest was written
    import shutil

    shutil.rmtree(tmp_path / "t/manifest/2")
    assert lookup.merge(keys("2", "new"), 2, table, enrich, "key", "version", 8) == touched
    assert sorted(r["key"] for r in lookup.read_lookup(spark, table).collect()) == sorted([*map(str, range(40)), "new"])
    for n in range(3, 6):
        lookup.merge(keys(*(f"{n}-{i}" for i in range(40))), n, table, enrich, "key", "version", 8)
    assert sorted(x.name for x in (tmp_path / "t/rows").iterdir()) == ["4", "5"] and sorted(x.name for x in (tmp_path / "t/manifest").iterdir()) == ["4", "5"]
    assert lookup.read_lookup(spark, table).count() == 161 and lookup.read_lookup(spark, str(tmp_path / "none")) is None


def png(pixels):
    h, w, c = pixels.shape
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_folder(spark, tmp_path):
    red = np.zeros((64, 64, 3))
    red[..., 0] = 200
    edge = np.zeros((300, 200, 3))
    edge[:, 100:] = 255
    grey = np.full((40, 40, 1), 90)
    for i, p in enumerate((red, edge, grey)):
        (tmp_path / f"{i + 1}.png").write_bytes(png(p))
    (tmp_path / "9.png").write_bytes(b"junk")
    f = image.image_features(tabular.read_images(spark, str(tmp_path)))
    got = {r["image_id"]: r for r in f.collect()}
    assert len(f.columns) == 1 + 26 + 82 + 96 and got[9]["mean_r"] is None
    assert got[1]["mean_r"] == pytest.approx(200, abs=0.01) and got[1]["mean_g"] == pytest.approx(0, abs=0.01) and got[1]["hist_r_3"] == 1.0
    assert got[2]["edge_density"] > 1 and got[3]["brightness"] == pytest.approx(90, abs=0.1) and got[1]["edge_density"] < 1e-3
    assert tuple(image.feature_failures(f).head()) == (4, 1)


def test_kernels():
    a = np.arange(64, dtype=np.float32).reshape(8, 8)
    assert np.allclose(image.resize_bilinear(np.repeat(a[..., None], 3, axis=2), 8)[..., 0], a)
    assert image.grid_pool(a, 4)[0, 0] == a[:2, :2].mean()
    assert image.center_crop(np.zeros((128, 128, 3))).shape == (78, 78, 3)
    assert np.allclose(image.filter3(a, image.SOBEL_X)[1:-1, 1:-1], 8) and image.filter3(a, image.SOBEL_X)[0].sum() == 0
    hue = lambda *c: image.hsv_stats(np.array([[c]], np.float32))[0]
    assert [hue(255, 0, 0), hue(0, 255, 0), hue(0, 0, 255), hue(9, 9, 9)] == pytest.approx([0, 1 / 3, 2 / 3, 0])


def test_no_pairs_and_no_single_task(spark):
    v = spark.range(100).withColumn("x", F.col("id").cast("double"))
    plan = neighbours.knn_join(v, v, "id", ["x"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    trials = prep.split_trials(v, "id", 4, 0.65, 0.15)._jdf.queryExecution().executedPlan().toString()
    # a row tells its own part from thresholds
    assert "Exchange" not in trials and "Join" not in trials


def test_thresholds_and_samples(spark):
    df = spark.range(3000).withColumn("id", F.when(F.col("id") >= 2900, F.lit(7)).otherwise(F.col("id")))
    rows = df.select(selection.hash60(3, F.col("id")).alias("h"), F.md5(F.concat_ws(":", F.lit("3"), F.col("id").cast("string")).cast("binary")).alias("m")).collect()
    h = np.sort([r["h"] for r in rows])
    assert [r["h"] for r in sorted(rows, key=lambda r: r["m"])] == h.tolist()
    wanted = [(0, n) for n in (0, 1, 2, 500, 2999, 3000)]
    last, equal = selection.thresholds(df, F.array(selection.hash60(3, F.col("id"))), wanted)
    for (_, n), v, e in zip(wanted, last.tolist(), equal.tolist(), strict=True):
        below, same = int((h < v).sum()), int((h == v).sum())
        assert (h <= v).sum() == n if e > 3000 else below + e == n and 0 < e < same
    # an id that 101 rows have is cut within its rows
    seven = [r["id"] for r in df.orderBy(selection.hash_order(3, F.col("id")), "id").select("id").collect()]
    inside = seven.index(7) + 40
    for n in (0, 1, 777, inside, 3000, 5000):
        for _ in range(2):
            got = sorted(r["id"] for r in selection.random_sample(df, "id", n, 3).collect())
            assert got == sorted(seven[:n])
    plan = selection.random_sample(spark.range(1000), "id", 900, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Limit" not in plan


def test_neighbours_by_cells(spark):
    rng = np.random.default_rng(12)
    middle = rng.normal(size=(30, 4)) * 20
    x = np.concatenate([middle[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 4)), np.repeat(middle[:1], 40, axis=0)])
    df = spark.createDataFrame([(i, *map(float, v), i % 7) for i, v in enumerate(x)], "id long, a double, b double, c double, d double, y long")
    feats = ["a", "b", "c", "d"]
    q = df.where("id % 10 = 0")
    got = {}
    for r in neighbours.knn_join(q, df.where("id % 10 != 0"), "id", feats, 6, neighbours.METRICS, per_block=300, carry=("y",)).collect():
        got[r["metric"], r["qid"], r["rank"]] = (r["tid"], r["y"])
    own, other = np.arange(0, len(x), 10), np.flatnonzero(np.arange(len(x)) % 10)
    for metric in neighbours.METRICS:
        d = neighbours._distances(x[own], x[other], metric, 3.0)
        near = other[np.argsort(d, axis=1, kind="stable")[:, :6]]
        assert all(got[metric, q, k + 1] == (t, t % 7) for q, row in zip(own.tolist(), near.tolist(), strict=True) for k, t in enumerate(row))
    assert len(got) == 4 * 6 * len(own)
    rows = neighbours._rows(df, "id", feats)
    for metric in neighbours.METRICS:
        cells = neighbours.Cells(rows, metric, 3.0, 60)
        first = cells.visits(rows, 6, False)
        bound = neighbours.knn_join(df, df, "id", feats, 6, (metric,), per_block=300).where("rank = 6").select(F.col("qid").alias("id"), F.col("d").alias("most"))
        rest = cells.visits(rows.join(bound, "id"), 6, True)
        visited = (first.count() + rest.count()) / (len(x) * len(cells.pivots))
        print(metric, "share of pairs of query and cell visited", round(visited, 3))
        assert visited < 0.25


def test_neighbours_without_structure_stream_past_blocks(spark, monkeypatch):
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.normal(size=(1500, 20)), np.zeros((40, 20))]).round(2)
    feats = [f"c{i}" for i in range(20)]
    df = spark.createDataFrame([(f"r{i:04d}", *map(float, v), i % 7 or None) for i, v in enumerate(x)], "id string, " + ", ".join(f"{c} double" for c in feats) + ", y long")
    df = df.withColumn("c3", F.when(F.col("id") != "r0011", F.col("c3")))
    q = df.where("substr(id, 5) = '0'")
    # before, each query went to nearly all cells, with a copy of its columns for each
    monkeypatch.setattr(neighbours, "Cells", None)
    near = neighbours.knn_join(q, df.where("substr(id, 5) != '0'"), "id", feats, 6, neighbours.METRICS, per_block=300, carry=("y",))
    got = {(r["metric"], int(r["qid"][1:]), r["rank"]): (int(r["tid"][1:]), r["y"], r["d"]) for r in near.collect()}
    x[11, 3] = np.nan
    own, other = np.arange(0, len(x), 10), np.flatnonzero(np.arange(len(x)) % 10)
    for metric in neighbours.METRICS:
        d = neighbours._distances(x[own], x[other], metric, 3.0)
        order = np.argsort(d, axis=1, kind="stable")[:, :6]
        for i, row in enumerate(order):
            for k, j in enumerate(row):
                t = int(other[j])
                assert got[metric, int(own[i]), k + 1] == (t, t % 7 or None, d[i, j])
    assert len(got) == 4 * 6 * len(own)


def test_rows_among_themselves_without_structure_are_no_case_for_cells(spark):
    rows = neighbours._rows(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(np.random.default_rng(24).normal(size=(3000, 20)))], "id long, " + ", ".join(f"c{i} double" for i in range(20))), "id", [f"c{i}" for i in range(20)])
    assert neighbours._open_share(rows, rows, 3, ["euclidean"], 3.0, 3000) > neighbours.OPEN


def test_blocks_keep_exact_order_at_any_scale():
    rng = np.random.default_rng(22)
    wild = rng.normal(size=(400, 5))
    wild[::40] *= 1e5
    wild[3, 0], wild[9, 4], wild[5] = np.nan, np.inf, 1e200
    for x in (rng.normal(size=(400, 30)) + 1e7, rng.integers(0, 3, (400, 4)).astype(float), wild, np.zeros((400, 2))):
        for metric in neighbours.METRICS:
            for k in (3, 150):
                s, ids = dense.Search(x[:50], k, metric, 3.0), rng.permutation(len(x))
                for at in range(0, len(x), 100):
                    s.add(x[at : at + 100], ids[at : at + 100], pa.table({"tid": ids[at : at + 100]}))
                with np.errstate(all="ignore"):
                    d = neighbours._distances(x[:50], x, metric, 3.0)
                order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
                found = s.found()
                assert found[3]["tid"].to_pylist() == ids[order].ravel().tolist()
                assert np.array_equal(found[2], np.take_along_axis(d, order, axis=1).ravel(), equal_nan=True)


def test_neighbours_of_trials_are_not_copied_by_block(spark, monkeypatch):
    rng = np.random.default_rng(23)
    rows = [(i, int(t), *map(float, v)) for i, (t, v) in enumerate(zip(rng.choice([0, 1, 2], 900, p=[0.5, 0.45, 0.05]), rng.normal(size=(900, 3)), strict=True))]
    df = spark.createDataFrame(rows, "id long, trial int, a double, b double, c double")
    q, t = df.where("id % 5 = 0"), df.where("id % 5 != 0")
    near = neighbours.knn_join(q, t, "id", ["a", "b", "c"], 7, ("euclidean", "manhattan"), by=["trial"], per_block=100)
    # before, each row was copied for each block of all trials
    assert "Generate" not in near._jdf.queryExecution().executedPlan().toString()
    got = {(r["metric"], r["trial"], r["qid"], r["rank"]): r["tid"] for r in near.collect()}
    want = {}
    for metric in ("euclidean", "manhattan"):
        for trial in range(3):
            own, other = ([r for r in rows if r[1] == trial and (r[0] % 5 == 0) == asked] for asked in (True, False))
            d = neighbours._distances(np.array([r[2:] for r in own]), np.array([r[2:] for r in other]), metric, 3.0)
            for r, o in zip(own, np.argsort(d, axis=1, kind="stable")[:, :7], strict=True):
                want |= {(metric, trial, r[0], k + 1): other[j][0] for k, j in enumerate(o)}
    assert got == want
    # groups that fit in a block are dealt as they are
    asked = []
    monkeypatch.setattr(neighbours, "_block", lambda n, made=neighbours._block: asked.append(n) or made(n))
    small = neighbours.knn_join(q, t, "id", ["a", "b", "c"], 7, by=["trial"], per_block=400)
    assert {(r["trial"], r["qid"], r["rank"]): r["tid"] for r in small.collect()} == {k[1:]: v for k, v in want.items() if k[0] == "euclidean"}
    assert asked == [1, 1]


def accuracies(x, y, trials, ks, metric, p_train):
    """By all distances, trial by trial."""
    import hashlib

    n = len(x)
    take, out = round(n * p_train), np.zeros((trials, len(ks)))
    d = neighbours._distances(x, x, metric, 3.0)
    for t in range(trials):
        order = sorted(range(n), key=lambda i: (hashlib.md5(f"{t}:{i}".encode()).hexdigest(), i))
        train, test = np.sort(order[:take]), np.sort(order[take:])
        near = train[np.argsort(d[np.ix_(test, train)], axis=1, kind="stable")]
        for j, k in enumerate(ks):
            counts = np.stack([(y[near[:, :k]] == v).sum(axis=1) for v in range(y.max() + 1)])
            out[t, j] = (counts.argmax(axis=0) == y[test]).mean()
    return out.mean(axis=0)


@pytest.mark.parametrize("p_train", [0.75, 0.05])
def test_grid_accuracy_over_trials_as_bitmaps(spark, p_train):
    rng = np.random.default_rng(13)
    y = rng.integers(0, 4, 400)
    x = rng.normal(size=(400, 2)) + np.array([[0, 0], [1, 0], [0, 1], [1, 1]])[y]
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y int")
    got = {(r["metric"], r["k"]): r["accuracy"] for r in neighbours.knn_grid_accuracy(df, "id", ["a", "b"], "y", 25, [1, 4, 5], ["euclidean", "chebyshev"], p_train).collect()}
    for metric in ("euclidean", "chebyshev"):
        assert np.allclose([got[metric, k] for k in (1, 4, 5)], accuracies(x, y, 25, [1, 4, 5], metric, p_train))


def test_order_statistics(spark):
    rng = np.random.default_rng(14)
    rows = [("a", float(v)) for v in rng.integers(0, 9, 500)] + [(None, float(v)) for v in rng.normal(size=37)] + [("b", 2.5), ("c", None), ("d", 1.0), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {r["g"]: r for r in profile.order_statistics(df, "v", shares, ["g"]).collect()}
    assert set(got) == {"a", None, "b", "d"}
    for g, r in got.items():
        own = np.array([v for k, v in rows if k == g])
        assert r["n"] == len(own) and np.allclose(r["at"], np.quantile(own, shares))
    whole = np.array([v for _, v in rows if v is not None])
    assert np.allclose(profile.order_statistics(df, "v", shares).head()["at"], np.quantile(whole, shares))
    assert profile.mean_median(df.where("g = 'c'"), "v").head()["median"] is None and profile.order_statistics(df.where("false"), "v", shares).count() == 0
    boxes = {r["g"]: r for r in profile.box_stats(df, "v", ["g"]).collect()}
    assert boxes["a"]["median"] == np.median([v for k, v in rows if k == "a"]) and boxes["b"]["q3"] == 2.5


def best_cut(x, y, least, gain):
    """(gain, feature, cut) by trying each midpoint."""
    best = None
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for lo, hi in zip(v, v[1:], strict=False):
            left = x[:, f] <= lo
            if left.sum() >= least and (~left).sum() >= least:
                g = gain(y[left], y[~left], y)
                if best is None or g > best[0] + 1e-9:
                    best = (g, f, (lo + hi) / 2)
    return best


@pytest.mark.parametrize("bins", [256, 8, 2])
def test_best_splits_over_bins(spark, bins, monkeypatch):
    monkeypatch.setattr(tree, "BINS", bins)
    rng = np.random.default_rng(15)
    x = np.round(rng.normal(size=(600, 3)), 2)
    x[:, 2] = rng.integers(0, 3, 600)
    y = np.where(x[:, 1] > 0.37, 3.0, 0.0) + rng.normal(size=600) * 0.3
    node = rng.integers(0, 4, 600)
    df = spark.createDataFrame([(int(k), *map(float, r), float(v), int(v > 1.5)) for k, r, v in zip(node, x, y, strict=True)], "node_id long, a double, b double, c double, y double, l int")
    error = lambda v: ((v - v.mean()) ** 2).sum()
    got = {r["node_id"]: r for r in tree.best_split_regression(df, ["a", "b", "c"], "y", 5).collect()}
    for k in range(4):
        g, f, cut = best_cut(x[node == k], y[node == k], 5, lambda p, q, w: error(w) - error(p) - error(q))
        assert got[k]["feat"] == "abc"[f] and got[k]["thr"] == pytest.approx(cut) and got[k]["gain"] == pytest.approx(g)

    def bits(v):
        p = v.mean()
        return -sum(q * np.log2(q) for q in (p, 1 - p) if q > 0)

    got = {r["node_id"]: r for r in tree.best_split_entropy(df, ["a", "b", "c"], "l").collect()}
    for k in range(4):
        g, f, cut = best_cut(x[node == k], (y > 1.5)[node == k], 1, lambda p, q, w: bits(w) - len(p) / len(w) * bits(p) - len(q) / len(w) * bits(q))
        assert got[k]["feat"] == "abc"[f] and got[k]["thr"] == pytest.approx(cut) and got[k]["gain"] == pytest.approx(g)


def test_few_bins_are_looked_into(spark):
    """With a clear cut the bounds leave a few of 2 x 256 bins."""
    rng = np.random.default_rng(16)
    x = rng.uniform(size=(4000, 2))
    df = spark.createDataFrame([(1, float(a), float(b), float(a > 0.4321) + float(e)) for (a, b), e in zip(x, rng.uniform(size=4000) * 0.1, strict=True)], "node_id long, a double, b double, y double")
    counted = []
    cuts = tree._cuts

    def spied(values, bins, by, names):
        counted.append((bins.count(), values.select("place", "bin").distinct().count()))
        return cuts(values, bins, by, names)

    tree._cuts = spied
    try:
        found = tree.best_split_regression(df, ["a", "b"], "y", 5).head()
    finally:
        tree._cuts = cuts
    assert found["feat"] == "a" and abs(found["thr"] - 0.4321) < 0.01
    print("bins looked into", counted)
    assert counted[0][1] > 400 and counted[0][0] <= 4


def test_kmeans_on_edges_equals_dense_rounds(spark):
    rng = np.random.default_rng(17)
    w = np.round(rng.uniform(size=(30, 30)), 3) * (rng.uniform(size=(30, 30)) < 0.3)
    w[:15, :10] += 2
    edges = [(i, j, float(w[i, j])) for i in range(30) for j in range(30) if w[i, j]] + [(0, 1, 0.5)]
    w[0, 1] += 0.5
    got = {r["src"]: r["cluster"] for r in cluster.kmeans_adjacency(spark.createDataFrame(edges, "src long, dst long, w double"), 3).collect()}
    import hashlib

    order = sorted(range(30), key=lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest())[:3]
    c, at = w[order], None
    while True:
        new = ((w[:, None] - c) ** 2).sum(axis=2).round(9).argmin(axis=1)
        if at is not None and (new == at).all():
            break
        at = new
        c = np.stack([w[at == k].mean(axis=0) if (at == k).any() else c[k] for k in range(3)])
    assert got == dict(enumerate(at.tolist()))


def test_cluster_members_guard(spark):
    df = spark.createDataFrame([(0, i) for i in range(9)] + [(1, 50), (None, 51)], "c int, id long")
    with pytest.raises(ValueError, match="cluster_places"):
        cluster.cluster_members(df, "c", "id", most=8)
    got = {(r["c"], r["id"]): r["place"] for r in cluster.cluster_places(df, "c", "id").collect()}
    assert got == {**{(0, i): i + 1 for i in range(9)}, (1, 50): 1, (None, 51): 1}
