"""The resumable lookup job over files that arrive: each run takes what is new.

The lookup table is kept in buckets by a hash of the key. A batch that finds new
keys writes the buckets that they fall in anew, as ``table/rows/<batch>``, and a
manifest ``table/manifest/<batch>`` that names each bucket's batch. Readers take
the last manifest; other buckets stay as they are. A batch that is run again
after a failure writes its own folders again from the manifest before it, so the
table is the same.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.sources.tabular import exists, keep_last

BUCKETS = 64


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Names of the complete folders in ``path`` that are numbers."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit() and exists(spark, f"{path}/{n}/_SUCCESS"))


def manifest(spark: SparkSession, table: str, before: int | None = None) -> dict[int, int]:
    """The batch that wrote each bucket, as of the last manifest (of a batch less than ``before``)."""
    found = [n for n in _numbers(spark, f"{table}/manifest") if before is None or n < before]
    if not found:
        return {}
    return {int(b): n for b, n in json.loads(spark.read.text(f"{table}/manifest/{found[-1]}").head()[0]).items()}


def read_lookup(spark: SparkSession, table: str, buckets: dict[int, int] | None = None) -> DataFrame | None:
    """The lookup table, or only some of its buckets; None where it has no row yet."""
    buckets = manifest(spark, table) if buckets is None else buckets
    paths = [f"{table}/rows/{n}/__bucket={b}" for b, n in sorted(buckets.items())]
    return spark.read.parquet(*paths) if paths else None


def merge(rows: DataFrame, number: int, table: str, enrich: Callable[[DataFrame], DataFrame], key: str, version: str, buckets: int = BUCKETS) -> list[int]:
    """Adds the keys of batch ``number`` that the table lacks; says which buckets were written.

    Only buckets that the batch's keys fall in are read, and of these only those
    that lack some of them are written. The last version of a key wins. The
    manifests of the two last batches stay, and what no one of them names goes.
    """
    spark = rows.sparkSession
    before = manifest(spark, table, number)
    of = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    # bucket numbers, at most ``buckets``
    asked = {r[0] for r in keys.select(of).distinct().collect()}
    there = read_lookup(spark, table, {b: n for b, n in before.items() if b in asked})
    missing = keys.join(there.select(key), key, "left_anti") if there is not None else keys
    touched = sorted(r[0] for r in missing.select(of).distinct().collect())
    if touched:
        new = enrich(missing)
        old = read_lookup(spark, table, {b: n for b, n in before.items() if b in touched})
        both = new if old is None else old.unionByName(new)
        keep_last(both, key, version).withColumn("__bucket", of).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{table}/rows/{number}")
    after = before | dict.fromkeys(touched, number)
    if after:
        spark.createDataFrame([(json.dumps(after),)], "m string").coalesce(1).write.mode("overwrite").text(f"{table}/manifest/{number}")
    _clean(spark, table)
    return touched


def _clean(spark: SparkSession, table: str) -> None:
    kept = _numbers(spark, f"{table}/manifest")[-2:]
    named = {(b, n) for k in kept for b, n in manifest(spark, table, k + 1).items()}
    for n in _numbers(spark, f"{table}/manifest"):
        if n not in kept:
            p, fs = _folder(spark, f"{table}/manifest/{n}")
            fs.delete(p, True)
    for n in _numbers(spark, f"{table}/rows"):
        p, fs = _folder(spark, f"{table}/rows/{n}")
        if n > max(kept, default=-1):
            continue
        parts = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("__bucket=")]
        gone = [x for x in parts if (int(x.getName().split("=")[1]), n) not in named]
        for x in [p] if len(gone) == len(parts) else gone:
            fs.delete(x, True)


def follow(spark: SparkSession, source: str, schema, table: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame], key: str, version: str) -> None:
    """Reads Parquet files of ``source`` not seen before and adds their keys to the lookup table."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(lambda rows, number: merge(rows, number, table, enrich, key, version) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
