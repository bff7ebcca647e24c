"""What the queries share: registration, tables in the role of listings, scratch folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.functions.columns import hash28
from oremill.operators.prep import split_hash
from oremill.operators.ranking import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, places: int = 4) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, places)


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """The given columns rounded; sums come in any order, so their last digits may differ."""
    return df.withColumns({c: F.round(c, p) for c, p in places.items()})


def scratch(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, which executors share."""
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as listings: id, seg, nation, price, items, qty, disc, tax, split."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left").fillna(0, subset=["items", "qty", "disc", "tax"])
    return split_hash(o.select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation"), F.col("o_totalprice").alias("price"), "items", "qty", "disc", "tax"), "id")


def train_rows() -> Column:
    return F.col("split") == "train"


#: The same in SQL, as leading common table expressions.
L = """
WITH li AS (SELECT l_orderkey, count(*) AS items, sum(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax FROM lineitem GROUP BY 1),
L AS (SELECT o_orderkey AS id, c_mktsegment AS seg, c_nationkey AS nation, o_totalprice AS price, coalesce(items, 0) AS items, coalesce(qty, 0) AS qty,
             coalesce(disc, 0) AS disc, coalesce(tax, 0) AS tax,
             CASE WHEN u < 0.65 THEN 'train' WHEN u < 0.8 THEN 'val' ELSE 'test' END AS split
      FROM (SELECT *, CAST('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS u FROM orders)
      JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey)
"""


def cities(spark: SparkSession, d: str) -> DataFrame:
    """Nations as a city lookup with made-up places, some missing or outside the box."""
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(n.alias("nation"), F.col("n_name").alias("name"), F.when(n % 7 != 3, 30.0 + n * 0.4).alias("lat"), F.when(n % 7 != 3, -124.0 + n * 0.5).alias("lon"), F.when(n % 5 != 1, F.col("n_regionkey")).alias("region"))


GEO = """geo AS (SELECT n_nationkey AS nation, n_name AS name, CASE WHEN n_nationkey % 7 <> 3 THEN 30.0::DOUBLE + n_nationkey * 0.4::DOUBLE END AS lat,
                CASE WHEN n_nationkey % 7 <> 3 THEN -124.0::DOUBLE + n_nationkey * 0.5::DOUBLE END AS lon,
                CASE WHEN n_nationkey % 5 <> 1 THEN n_regionkey END AS region FROM nation)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """listings with two plain predictions, a and b, made from their columns."""
    return listings(spark, d).withColumns({"a": F.round(F.lit(100000.0) + 4000 * F.col("items") + 500 * F.col("qty"), 2), "b": F.round(F.lit(250000.0) - 1000 * F.col("items") + F.col("nation") * 100, 2)})


P = L + """, P AS (SELECT *, round(100000.0::DOUBLE + 4000 * items + 500 * qty, 2) AS a, round(250000.0::DOUBLE - 1000 * items + nation * 100, 2) AS b FROM L)"""


def trial_results(spark: SparkSession, d: str) -> DataFrame:
    """Errors of predictions a and b over 20 random parts of the listings: (trial, model, k, mae)."""
    p = predictions(spark, d).withColumn("trial", (hash28("t", F.col("id").cast("string")) % 20).cast("int"))
    long = p.unpivot(["trial", "id", "items", "price"], ["a", "b"], "model", "pred").withColumn("k", (F.col("items") % 3 + 1).cast("int"))
    return long.groupBy("trial", "model", "k").agg(F.round(F.avg(F.abs(F.col("pred") - F.col("price"))), 4).alias("mae"))


TR = P + """, tr AS (SELECT CAST(CAST('0x' || substr(md5('t:' || CAST(id AS VARCHAR)), 1, 7) AS BIGINT) % 20 AS INTEGER) AS trial, model,
                 CAST(items % 3 + 1 AS INTEGER) AS k, round(avg(abs(pred - price)), 4) AS mae
          FROM (SELECT id, items, price, 'a' AS model, a AS pred FROM P UNION ALL SELECT id, items, price, 'b', b FROM P) GROUP BY 1, 2, 3)"""
