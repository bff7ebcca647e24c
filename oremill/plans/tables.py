"""Queries of sources, cleaning, joins, profiles, rankings and preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.functions.columns import city_base_name, first_match_in_json_array, money_label
from oremill.operators import clean, prep, profile, ranking
from oremill.sources import tabular

from .base import GEO, TR, L, P, cities, listings, predictions, query, rounded, scratch, table, train_rows, trial_results

S = SparkSession

# Sources and sinks


@query("""SELECT c_custkey AS image_id, c_name AS street, c_mktsegment AS citi, c_nationkey AS n_citi, CAST(c_custkey % 5 AS INTEGER) AS bed, (c_custkey % 7) / 2.0::DOUBLE AS bath,
          CAST(c_custkey % 3000 AS INTEGER) AS sqft, c_acctbal AS price FROM customer""")
def read_listings(spark: S, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("image_id"), F.col("c_name").alias("street"), F.col("c_mktsegment").alias("citi"), F.col("c_nationkey").alias("n_citi"), (k % 5).cast("int").alias("bed"), ((k % 7) / 2).alias("bath"), (k % 3000).cast("int").alias("sqft"), F.col("c_acctbal").alias("price"))
    path = scratch(spark)
    tabular.write_csv(rows, path)
    return tabular.read_listings(spark, path)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def read_features(spark: S, d: str) -> DataFrame:
    path = scratch(spark)
    tabular.write_parquet(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path)
    return tabular.read_features(spark, path)


@query("SELECT CAST(p_size AS DOUBLE) AS c0, p_retailprice AS c1 FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 11 <> 0")
def read_numeric_csv(spark: S, d: str) -> DataFrame:
    path = scratch(spark)
    k = F.col("p_partkey")
    tail = F.when(k % 10 == 0, ",7").when(k % 11 == 0, "x").otherwise("")
    table(spark, d, "part").select(F.concat(F.col("p_size").cast("string"), F.lit(","), F.col("p_retailprice").cast("string"), tail)).write.text(path)
    return tabular.read_numeric_csv(spark, path, 2)


@query("SELECT CAST(p_size AS DOUBLE) AS x1, p_retailprice AS x2, CASE WHEN p_partkey % 4 = 0 THEN '0' ELSE p_type END AS label FROM part")
def read_labeled_points(spark: S, d: str) -> DataFrame:
    path = scratch(spark)
    line = F.concat_ws(",", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")))
    table(spark, d, "part").select(F.explode(F.array(line, F.lit("  "))).alias("value")).write.text(path)
    return tabular.read_labeled_points(spark, path, 2, "0")


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, CAST(n_nationkey AS DOUBLE) AS value, n_regionkey AS label FROM nation")
def read_transposed_pairs(spark: S, d: str) -> DataFrame:
    path = scratch(spark)
    both = table(spark, d, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_regionkey"))).alias("z"))
    both.select(F.concat_ws("\n", *[F.array_join(F.col(f"z.{c}").cast("array<string>"), ",") for c in ("n_nationkey", "n_regionkey")])).coalesce(1).write.text(path)
    return tabular.read_transposed_pairs(spark, path)


@query("SELECT CAST(user_id AS VARCHAR) AS seq_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, event_type AS state FROM events")
def read_sequence(spark: S, d: str) -> DataFrame:
    path = scratch(spark)
    seqs = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("z"))
    seqs.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.array_join(F.transform("z", lambda x: x["event_type"]), ","))).write.text(path)
    return tabular.read_sequence(spark, path)


@query("SELECT CAST(a.n_nationkey AS BIGINT) AS src, CAST(b.n_nationkey AS BIGINT) AS dst, 1.0::DOUBLE AS w FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def read_adjacency(spark: S, d: str) -> DataFrame:
    path = scratch(spark)
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    cell = ((F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).cast("int")
    rows = a.crossJoin(b).groupBy("a.n_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("b.n_nationkey").alias("k"), cell.alias("v")))).alias("z"))
    rows.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(": "), F.array_join(F.transform("z", lambda x: x["v"].cast("string")), " "))).write.text(path)
    return tabular.read_adjacency(spark, path)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def write_parquet(spark: S, d: str) -> DataFrame:
    path = scratch(spark)
    tabular.write_parquet(table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")), path)
    return spark.read.parquet(path)


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def write_csv(spark: S, d: str) -> DataFrame:
    path = scratch(spark)
    tabular.write_csv(table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")), path, single=True)
    return spark.read.schema("p_type string, n long").option("header", True).csv(path)


@query("SELECT o_orderpriority AS run, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1")
def write_json_metrics(spark: S, d: str) -> DataFrame:
    path = scratch(spark)
    tabular.write_json_metrics(table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("top")), path)
    return spark.read.schema("run string, n long, top double").json(path)


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS run, CASE WHEN c_nationkey % 2 = 0 THEN round(max(c_acctbal), 2) ELSE round(min(c_acctbal), 2) END AS mae FROM customer GROUP BY c_nationkey""")
def upsert_metrics(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy("c_nationkey")
    run = F.col("c_nationkey").cast("string").alias("run")
    old = c.agg(F.round(F.min("c_acctbal"), 2).alias("mae")).select(run, "mae")
    new = c.agg(F.round(F.max("c_acctbal"), 2).alias("mae")).where("c_nationkey % 2 = 0").select(run, "mae")
    return tabular.upsert_metrics(old, new)


@query("SELECT true AS first_wrote, false AS second_wrote, count(*) AS n FROM part")
def skip_if_exists(spark: S, d: str) -> DataFrame:
    path = scratch(spark)
    parts = table(spark, d, "part")
    first = tabular.skip_if_exists(spark, path, lambda: parts.select("p_partkey"))
    second = tabular.skip_if_exists(spark, path, lambda: parts.limit(1))
    return spark.read.parquet(path).agg(F.lit(first).alias("first_wrote"), F.lit(second).alias("second_wrote"), F.count("*").alias("n"))


@query("""SELECT c_nationkey AS key, CASE WHEN c_nationkey % 3 = 0 THEN 'cached' ELSE 'looked up ' || c_nationkey END AS value, CASE WHEN c_nationkey % 3 = 0 THEN 2 ELSE 9 END AS version
          FROM (SELECT DISTINCT c_nationkey FROM customer UNION SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0)""")
def incremental_lookup(spark: S, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_nationkey % 3 = 0")
    cache = n.select(F.col("n_nationkey").alias("key"), F.explode(F.array(F.struct(F.lit("old").alias("value"), F.lit(1).alias("version")), F.struct(F.lit("cached").alias("value"), F.lit(2).alias("version")))).alias("v")).select("key", "v.value", "v.version")
    keys = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"))
    return tabular.incremental_lookup(keys, cache, lambda k: k.select("key", F.concat(F.lit("looked up "), "key").alias("value"), F.lit(9).alias("version")), "key", "version")


# Filters and scalar functions

BOX = "lat BETWEEN 32 AND 37 AND lon BETWEEN -121 AND -114"


@query(f"WITH {GEO} SELECT nation, round(lat, 4) AS lat, round(lon, 4) AS lon FROM geo WHERE {BOX}")
def bbox_filter(spark: S, d: str) -> DataFrame:
    return rounded(clean.bbox_filter(cities(spark, d), "lat", "lon").select("nation", "lat", "lon"), lat=4, lon=4)


@query(f"WITH {GEO} SELECT nation, round(lat, 4) AS lat, round(lon, 4) AS lon FROM geo WHERE NOT coalesce({BOX}, false)")
def bbox_violations(spark: S, d: str) -> DataFrame:
    return rounded(clean.bbox_violations(cities(spark, d), "lat", "lon").select("nation", "lat", "lon"), lat=4, lon=4)


@query("""SELECT event_id, CASE WHEN k BETWEEN 32 AND 37 THEN k WHEN k + 20 BETWEEN 32 AND 37 THEN k + 20 END AS lat
          FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)""")
def first_match_in_json(spark: S, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    js = F.to_json(F.array(*[F.struct((k + s).cast("string").alias("lat"), F.lit("-118.5").alias("lon")) for s in (0, 20)]))
    hit = first_match_in_json_array(js, clean.BOX)
    return table(spark, d, "events").select("event_id", hit["lat"].alias("lat"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def keyed_overwrite(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    fixes = o.where("o_orderkey % 9 = 0").select("o_orderkey", F.lit("Z").alias("o_orderstatus"))
    return clean.keyed_overwrite(o, fixes, "o_orderkey", ["o_orderstatus"])


@query("""SELECT CASE WHEN lower(c_mktsegment) LIKE '%build%' AND c_acctbal BETWEEN 100 AND 105 THEN 0 ELSE 1 END AS priority, c_custkey FROM customer
          WHERE lower(c_mktsegment) LIKE '%build%' AND c_acctbal BETWEEN 100 AND 5000 ORDER BY 1, 2 LIMIT 1""")
def conjunctive_pick(spark: S, d: str) -> DataFrame:
    name = F.lower("c_mktsegment").contains("build")
    picked = clean.conjunctive_pick(table(spark, d, "customer"), [name & F.col("c_acctbal").between(100, 105), name & F.col("c_acctbal").between(100, 5000)], "c_custkey")
    return picked.select("priority", "c_custkey")


@query("SELECT n_nationkey, trim(split_part(n_name || ' , region ' || n_regionkey, ',', 1)) AS base FROM nation", name="city_base_name")
def base_name(spark: S, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", city_base_name(F.concat("n_name", F.lit(" , region "), "n_regionkey")).alias("base"))


@query("""SELECT o_orderkey, CASE WHEN v >= 1000000 THEN '$' || printf('%.1f', v / 1000000) || 'M' WHEN v >= 1000 THEN '$' || printf('%.0f', v / 1000) || 'k' ELSE '$' || printf('%.0f', v) END AS label
          FROM (SELECT o_orderkey, (o_orderkey % 4096) * 512 * 1.0::DOUBLE + 0.25 AS v FROM orders)""", name="money_label")
def money(spark: S, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", money_label((F.col("o_orderkey") % 4096) * 512 * 1.0 + 0.25).alias("label"))


@query(P + "SELECT id, round(a - price, 4) AS err, round(abs(a - price), 4) AS abs_err, CASE WHEN a - price > 0 THEN 'over' ELSE 'under' END AS side FROM P")
def residual_columns(spark: S, d: str) -> DataFrame:
    return rounded(clean.residual_columns(predictions(spark, d), "price", "a").select("id", "err", "abs_err", "side"), err=4, abs_err=4)


@query(f"WITH {GEO} SELECT nation FROM geo WHERE lat IS NOT NULL AND region IS NOT NULL")
def dropna_subset(spark: S, d: str) -> DataFrame:
    return clean.dropna_subset(cities(spark, d), ["lat", "region"]).select("nation")


FILLED = f"""{L}, {GEO}, j AS (SELECT L.id, L.split, geo.lat, geo.lon, geo.region FROM L LEFT JOIN geo USING (nation)),
m AS (SELECT avg(lat) AS lat, avg(lon) AS lon FROM j WHERE split = 'train')
SELECT id, round(coalesce(j.lat, m.lat, 34.0), 4) AS lat, round(coalesce(j.lon, m.lon, -118.0), 4) AS lon, coalesce(region, -1) AS region FROM j, m"""


@query(FILLED)
def fill_with_train_mean(spark: S, d: str) -> DataFrame:
    j = clean.join_city_lookup(listings(spark, d).select("id", "nation", "split"), cities(spark, d), "nation").select("id", "split", "lat", "lon", "region")
    return rounded(clean.fill_with_train_mean(j, ["lat", "lon"], train_rows(), {"lat": 34.0, "lon": -118.0}, "region").drop("split"), lat=4, lon=4)


@query(FILLED)
def geo_encode(spark: S, d: str) -> DataFrame:
    out = prep.geo_encode(listings(spark, d).select("id", "nation", "split"), cities(spark, d).drop("name"), "nation", train_rows(), {"lat": 34.0, "lon": -118.0}, "region")
    return rounded(out.select("id", "lat", "lon", "region"), lat=4, lon=4)


@query("SELECT c_custkey FROM customer ORDER BY md5('7:' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 100")
def random_sample(spark: S, d: str) -> DataFrame:
    return clean.random_sample(table(spark, d, "customer").select("c_custkey"), "c_custkey", 100, 7)


# Joins


@query("SELECT o_orderkey, o_totalprice, qty FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def join_features(spark: S, d: str) -> DataFrame:
    feats = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty"))
    return clean.join_features(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), feats, "o_orderkey")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) ON n_nationkey = c_nationkey")
def join_city_lookup(spark: S, d: str) -> DataFrame:
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return clean.join_city_lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), geo, "c_nationkey").select("c_custkey", "n_name", "r_name")


@query(f"{L}, {GEO}, s AS (SELECT nation, avg(price) AS mean_y, count(*) AS n FROM L WHERE split = 'train' GROUP BY 1) SELECT nation, round(mean_y, 4) AS mean_y, coalesce(n, 0) AS n FROM geo LEFT JOIN s USING (nation) WHERE mean_y IS NOT NULL")
def join_city_stats(spark: S, d: str) -> DataFrame:
    return rounded(clean.join_city_stats(cities(spark, d), listings(spark, d), train_rows(), "nation", "price").select("nation", "mean_y", "n"), mean_y=4)


@query(f"{L} SELECT id, nation FROM L WHERE nation IN (SELECT nation FROM L GROUP BY nation ORDER BY count(*) DESC, nation LIMIT 10)")
def semi_top_groups(spark: S, d: str) -> DataFrame:
    return clean.semi_top_groups(listings(spark, d).select("id", "nation"), "nation", 10)


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def anti_cached(spark: S, d: str) -> DataFrame:
    return clean.anti_cached(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"), "c_custkey")


# Aggregations


@query(P + """SELECT model, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(sum(e * e) / 1e9, 3) AS sse_e9, round(median(abs(e)), 4) AS median_abs, round(max(abs(e)), 4) AS max_abs,
          round(avg((abs(e) <= 50000)::INT), 6) AS within_50k, round(avg((abs(e) <= 100000)::INT), 6) AS within_100k, round(avg((abs(e) <= 200000)::INT), 6) AS within_200k, count(*) AS n
          FROM (SELECT 'a' AS model, a - price AS e FROM P UNION ALL SELECT 'b', b - price FROM P) GROUP BY model""")
def regression_metrics(spark: S, d: str) -> DataFrame:
    p = predictions(spark, d).unpivot(["id", "price"], ["a", "b"], "model", "pred")
    m = profile.regression_metrics(p, "price", "pred", ["model"]).withColumn("sse_e9", F.round(F.col("sse") / 1e9, 3)).drop("sse")
    return rounded(m, mae=4, rmse=4, median_abs=4, max_abs=4, within_50k=6, within_100k=6, within_200k=6)


@query(f"{L}, m AS (SELECT nation, avg(price) AS m FROM L WHERE split = 'train' AND nation % 4 <> 0 GROUP BY 1), g AS (SELECT avg(price) AS g FROM L WHERE split = 'train' AND nation % 4 <> 0) SELECT id, round(coalesce(m, g), 4) AS enc FROM L LEFT JOIN m USING (nation), g")
def group_mean_fallback(spark: S, d: str) -> DataFrame:
    return rounded(profile.group_mean_fallback(listings(spark, d), "nation", "price", F.expr("split = 'train' and nation % 4 <> 0"), "enc").select("id", "enc"), enc=4)


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def count_by_group(spark: S, d: str) -> DataFrame:
    return profile.count_by_group(table(spark, d, "customer"), "c_mktsegment")


@query('SELECT c_nationkey, count(*) AS "count" FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15')
def top_groups(spark: S, d: str) -> DataFrame:
    return clean.top_groups(table(spark, d, "customer"), "c_nationkey", 15)


@query("SELECT round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median FROM orders")
def mean_median(spark: S, d: str) -> DataFrame:
    return rounded(profile.mean_median(table(spark, d, "orders"), "o_totalprice"), mean=4, median=4)


@query("""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 60 AS w FROM orders)
          SELECT CAST(least(floor((o_totalprice - lo) / w), 59) AS INTEGER) AS bin, round(lo + least(floor((o_totalprice - lo) / w), 59) * w, 3) AS lo, round(lo + (least(floor((o_totalprice - lo) / w), 59) + 1) * w, 3) AS hi, count(*) AS n FROM orders, s GROUP BY 1, 2, 3""")
def hist_equal_width(spark: S, d: str) -> DataFrame:
    return rounded(profile.hist_equal_width(table(spark, d, "orders"), "o_totalprice", 60), lo=3, hi=3)


@query("SELECT CAST(least(floor((o_totalprice - 100000) / 10000), 9) AS INTEGER) AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 GROUP BY 1")
def hist_fixed_edges(spark: S, d: str) -> DataFrame:
    return profile.hist_fixed_edges(table(spark, d, "orders"), "o_totalprice", 100000.0, 200000.0, 10000.0)


@query("SELECT max(l_quantity) AS cap, count(*) FILTER (l_quantity = (SELECT max(l_quantity) FROM lineitem)) AS at_cap, count(*) FILTER (l_quantity >= 45) AS from_floor FROM lineitem")
def cap_pileup(spark: S, d: str) -> DataFrame:
    return profile.cap_pileup(table(spark, d, "lineitem"), "l_quantity", floor=45.0)


@query("""WITH q AS (SELECT c_mktsegment AS g, quantile_cont(c_acctbal, 0.25) AS q1, median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.75) AS q3, avg(c_acctbal) AS mean, count(*) AS n FROM customer GROUP BY 1),
          x AS (SELECT q.*, c_acctbal * c_acctbal / 1000 AS v0, c_acctbal AS v FROM customer JOIN q ON c_mktsegment = g)
          SELECT g AS c_mktsegment, n, round(mean, 4) AS mean, round(q1, 4) AS q1, round(m, 4) AS median, round(q3, 4) AS q3, min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lo_whisker,
          max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS hi_whisker, count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM x GROUP BY ALL""")
def box_stats(spark: S, d: str) -> DataFrame:
    """Customers of any balance."""
    return rounded(profile.box_stats(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"]), mean=4, q1=4, median=4, q3=4)


@query(f"{L}, s AS (SELECT stddev_pop(items) AS items, stddev_pop(qty) AS qty, stddev_pop(price) AS price FROM L WHERE split = 'train') SELECT feature, round(std, 4) AS std, std > 100 AS flagged FROM (SELECT 'items' AS feature, items AS std FROM s UNION ALL SELECT 'qty', qty FROM s UNION ALL SELECT 'price', price FROM s)")
def column_std_profile(spark: S, d: str) -> DataFrame:
    return rounded(profile.column_std_profile(listings(spark, d), ["items", "qty", "price"], train_rows()), std=4)


@query(f"{L} SELECT nation, count(*) AS n, round(avg(price), 3) AS mean_price, round(avg(items), 4) AS mean_items, round(avg(qty), 4) AS mean_qty FROM L WHERE split = 'train' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def group_feature_means(spark: S, d: str) -> DataFrame:
    return rounded(profile.group_feature_means(listings(spark, d), "nation", "price", ["items", "qty"], train_rows(), 20), mean_price=3, mean_items=4, mean_qty=4)


@query(P + "SELECT nation, count(*) AS n, round(avg(abs(a - price)), 3) AS mae_a, round(avg(abs(b - price)), 3) AS mae_b, round(avg(abs(b - price)) - avg(abs(a - price)), 3) AS delta FROM P GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def subgroup_metrics(spark: S, d: str) -> DataFrame:
    return rounded(profile.subgroup_metrics(predictions(spark, d), "nation", "price", ["a", "b"]), mae_a=3, mae_b=3, delta=3)


@query(TR + "SELECT model, k, round(avg(mae), 3) AS mean, round(median(mae), 3) AS median, round(quantile_cont(mae, 0.05), 3) AS p05, round(quantile_cont(mae, 0.95), 3) AS p95, count(*) AS n FROM tr GROUP BY 1, 2")
def cv_summary(spark: S, d: str) -> DataFrame:
    return rounded(profile.cv_summary(trial_results(spark, d), ["model", "k"]), mean=3, median=3, p05=3, p95=3)


@query(TR + ", m AS (SELECT model, k, median(mae) AS median FROM tr GROUP BY 1, 2) SELECT model, k, round(median, 3) AS median FROM m QUALIFY row_number() OVER (PARTITION BY model ORDER BY m.median, k) = 1")
def cv_best_param(spark: S, d: str) -> DataFrame:
    return rounded(profile.cv_best_param(trial_results(spark, d), "model"), median=3)


@query(TR + "SELECT trial, model, k, mae FROM tr QUALIFY row_number() OVER (PARTITION BY trial ORDER BY mae, model, k) = 1")
def best_model_selection(spark: S, d: str) -> DataFrame:
    t = trial_results(spark, d).withColumn("place", F.concat("model", F.col("k").cast("string")))
    return profile.best_model_selection(t, ["trial"], "place").drop("place")


@query(TR + ", w AS (SELECT trial, min(mae) FILTER (model = 'a') AS a, min(mae) FILTER (model = 'b') AS b FROM tr GROUP BY 1) SELECT trial, a, b, least(a, b) AS best, least(a, b) = (SELECT min(least(a, b)) FROM w) AS overall_best FROM w")
def comparison_pivot(spark: S, d: str) -> DataFrame:
    return profile.comparison_pivot(trial_results(spark, d), "trial", "model", "mae", ["a", "b"])


@query("SELECT label AS cluster, round(avg(y), 5) AS mean, round(median(y), 5) AS median, count(*) AS n FROM (SELECT label, list_sum(embedding::DOUBLE[]) AS y FROM embeddings) GROUP BY 1")
def cluster_profile(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda t, x: t + x).alias("y"))
    return rounded(profile.cluster_profile(e, "cluster", "y"), mean=5, median=5)


@query("SELECT count(*) AS n, round(sum(p_size), 2) AS sx, round(sum(p_retailprice), 2) AS sy, round(sum(p_size * p_size), 2) AS sxx, round(sum(p_retailprice * p_retailprice), 1) AS syy, round(sum(p_size * p_retailprice), 1) AS sxy FROM part")
def sufficient_stats(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return rounded(profile.sufficient_stats(p, "x", "y"), sx=2, sy=2, sxx=2, syy=1, sxy=1)


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL")
def distinct_keys(spark: S, d: str) -> DataFrame:
    return profile.distinct_keys(table(spark, d, "part"), "p_brand")


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY 1")
def state_shares(spark: S, d: str) -> DataFrame:
    return rounded(profile.state_shares(table(spark, d, "events"), "event_type"), percent=6)


# Windows, sorts, set operations


@query(P + "SELECT id, seg2 AS segment, round(e, 4) AS abs_err, CAST(row_number() OVER (PARTITION BY seg2 ORDER BY e DESC, id) AS INTEGER) AS place FROM (SELECT id, abs(a - price) AS e, CASE WHEN price >= 300000 THEN 'high' ELSE 'rest' END AS seg2 FROM P) QUALIFY row_number() OVER (PARTITION BY seg2 ORDER BY e DESC, id) <= 3")
def worst_k_by_segment(spark: S, d: str) -> DataFrame:
    p = clean.residual_columns(predictions(spark, d), "price", "a").withColumn("segment", F.when(F.col("price") >= 300000, "high").otherwise("rest"))
    return rounded(ranking.worst_k_by_segment(p.select("id", "segment", "abs_err"), "segment", "abs_err", "id", 3), abs_err=4)


@query(P + "SELECT id, round(abs(a - price), 4) AS abs_err FROM P ORDER BY abs(a - price) DESC, id LIMIT 6")
def worst_k_overall(spark: S, d: str) -> DataFrame:
    return rounded(ranking.worst_k_overall(clean.residual_columns(predictions(spark, d), "price", "a").select("id", "abs_err"), "abs_err", "id", 6), abs_err=4)


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def largest_n(spark: S, d: str) -> DataFrame:
    return ranking.largest_n(profile.count_by_group(table(spark, d, "customer"), "c_nationkey"), "n", "c_nationkey", 8)


GAIN = """SELECT p_brand, round((value + nxt) / 2.0, 4) AS thr, round((sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n) / 1000, 2) AS gain FROM (
  SELECT *, sum(c) OVER o AS nl, sum(t) OVER o AS sl, sum(c) OVER w AS n, sum(t) OVER w AS s, lead(value) OVER (PARTITION BY p_brand ORDER BY value) AS nxt
  FROM (SELECT p_brand, p_size AS value, count(*)::DOUBLE AS c, sum(p_retailprice) AS t FROM part GROUP BY 1, 2)
  WINDOW o AS (PARTITION BY p_brand ORDER BY value ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY p_brand)) WHERE nxt IS NOT NULL AND nl >= 5 AND n - nl >= 5"""


@query(GAIN)
def running_split_gain(spark: S, d: str) -> DataFrame:
    g = ranking.running_split_gain(table(spark, d, "part"), "p_size", "p_retailprice", 5, ["p_brand"])
    return rounded(g.withColumn("gain", F.col("gain") / 1000), thr=4, gain=2)


@query("""WITH x AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events), c AS (SELECT nx AS event_type, count(*) AS n FROM x WHERE event_type = 'click' AND nx IS NOT NULL GROUP BY 1)
          SELECT event_type, n, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c""")
def lead_lag_condition(spark: S, d: str) -> DataFrame:
    return rounded(ranking.lead_lag_condition(table(spark, d, "events"), "user_id", "ts", "event_type", "click", "after"), share=6)


@query("SELECT (v + w) / 2 AS thr FROM (SELECT v, lead(v) OVER (ORDER BY v) AS w FROM (SELECT DISTINCT l_discount AS v FROM lineitem)) WHERE w IS NOT NULL")
def midpoint_thresholds(spark: S, d: str) -> DataFrame:
    return ranking.midpoint_thresholds(table(spark, d, "lineitem"), "l_discount")


@query(f"{L} SELECT id, split FROM L WHERE split IN ('train', 'val')")
def union_splits(spark: S, d: str) -> DataFrame:
    return ranking.union_splits(listings(spark, d).select("id", "split"), ["train", "val"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer")
def union_dedupe_last(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    a = c.select("c_custkey", F.lit(1).alias("version"), F.col("c_mktsegment").alias("value"))
    b = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit(2).alias("version"), F.lit("new").alias("value"))
    return ranking.union_dedupe_last(a, b, "c_custkey", "version")


@query(P + "SELECT model, round(avg(abs(p - price)), 4) AS mae, count(*) AS n FROM (SELECT 'a' AS model, a AS p, price FROM P UNION ALL SELECT 'b', b, price FROM P) GROUP BY 1")
def union_model_results(spark: S, d: str) -> DataFrame:
    p = predictions(spark, d)
    u = ranking.union_model_results([p.select(F.lit(m).alias("model"), F.col(m).alias("pred"), "price") for m in ("a", "b")])
    return rounded(profile.regression_metrics(u, "price", "pred", ["model"]).select("model", "mae", "n"), mae=4)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def distributed_rank(spark: S, d: str) -> DataFrame:
    return ranking.distributed_rank(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "rank")


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders")
def prefix_sums(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
    return ranking.prefix_sums(o, ["o_orderdate", "o_orderkey"], ["o_totalprice"]).select("o_orderkey", F.col("cum_o_totalprice").cast("double").alias("running"))


# Splits, scaling, encoding


@query("""SELECT c_custkey, CASE WHEN k <= round_even(n * 0.65, 0) THEN 'train' WHEN k <= round_even(n * 0.65, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split
          FROM (SELECT c_custkey, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS k FROM customer)""")
def split_exact(spark: S, d: str) -> DataFrame:
    return prep.split_exact(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query(f"{L} SELECT id, split FROM L")
def split_hash(spark: S, d: str) -> DataFrame:
    return listings(spark, d).select("id", "split")


@query("""SELECT trial, c_custkey, split FROM (SELECT trial, c_custkey, CASE WHEN k <= round_even(n * 0.65, 0) THEN 'train' WHEN k <= round_even(n * 0.65, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split
          FROM (SELECT CAST(t AS INTEGER) AS trial, c_custkey, count(*) OVER (PARTITION BY t) AS n, row_number() OVER (PARTITION BY t ORDER BY md5(t || ':' || CAST(c_custkey AS VARCHAR)), c_custkey) AS k FROM customer, range(5) r(t))) WHERE split <> 'test'""")
def split_trials(spark: S, d: str) -> DataFrame:
    return prep.split_trials(table(spark, d, "customer"), "c_custkey", 5, 0.65, 0.15)


@query(f"{L}, s AS (SELECT avg(qty) AS m, stddev_pop(qty) AS s, avg(items) AS mi, stddev_pop(items) AS si FROM L WHERE split = 'train') SELECT id, round((qty - m) / s, 5) AS qty, round((items - mi) / si, 5) AS items FROM L, s")
def zscore_fit_apply(spark: S, d: str) -> DataFrame:
    x = listings(spark, d).select("id", F.col("qty").cast("double"), F.col("items").cast("double"), "split")
    return rounded(prep.zscore_fit_apply(x, ["qty", "items"], train_rows()).drop("split"), qty=5, items=5)


@query(f"{L}, s AS (SELECT seg, min(qty) AS m, max(qty) - min(qty) AS s FROM L WHERE split = 'train' GROUP BY seg) SELECT id, round((qty - m) / CASE WHEN s < 1e-12 THEN 1 ELSE s END, 5) AS qty FROM L JOIN s USING (seg)")
def minmax_fit_apply(spark: S, d: str) -> DataFrame:
    x = listings(spark, d).select("id", "seg", "qty", "split")
    return rounded(prep.minmax_fit_apply(x, ["qty"], train_rows(), ["seg"]).select("id", "qty"), qty=5)


@query("""WITH m AS (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1), p AS (SELECT n_regionkey AS cluster, coalesce(avg(m), 0) AS mean FROM nation LEFT JOIN m ON c_nationkey = n_nationkey GROUP BY 1)
          SELECT cluster, round(mean, 4) AS mean, CAST(row_number() OVER (ORDER BY p.mean, cluster) - 1 AS INTEGER) AS region FROM p""")
def region_relabel(spark: S, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("cluster"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    return rounded(prep.region_relabel(n, c, "cluster", "nation", "c_acctbal"), mean=4)


@query(f"""{L}, g AS (SELECT nation, avg(price) AS price, avg(qty) AS qty FROM L GROUP BY 1), s AS (SELECT avg(price) AS mp, stddev_samp(price) AS sp, avg(qty) AS mq, stddev_pop(qty) + 1e-9 AS sq FROM g)
          SELECT nation, round((price - mp) / sp, 5) AS price, round((qty - mq) / sq, 5) AS qty FROM g, s""")
def zscore_groups(spark: S, d: str) -> DataFrame:
    g = listings(spark, d).groupBy("nation").agg(F.avg("price").alias("price"), F.avg("qty").alias("qty"))
    return rounded(prep.zscore_groups(g, "price", ["qty"]), price=5, qty=5)
