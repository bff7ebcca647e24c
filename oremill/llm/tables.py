"""Small Spark helpers that the operators share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from oremill.operators.ranking import checkpointed, forget, shared_folder

#: Sizes from here on are Spark's word for not knowing.
UNKNOWN = 1 << 60
#: The driver's separators of words, as a Java and RE2 pattern for one word.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than 1/HOT of all rows is joined by broadcast; there are fewer than HOT such keys.
HOT = 256
#: A sieve has 2^SIEVE bits at most.
SIEVE = 28


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fanout(df: DataFrame, share: float = 1.0, mb: int = 64) -> int:
    """Partitions so that ``share`` of the tables' size that are read makes about ``mb`` MB in each.

    The session's number of shuffle partitions at least; it alone where Spark
    knows no size, as for rows made in Python.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    wanted = math.ceil(sum(s for s in sizes if s < UNKNOWN) * share / (mb << 20))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted, 1)


def ensure_checkpoints(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, taken from the session; a folder of its own only for a local master where none is named."""
    return shared_folder(spark)


#: Spark's setting for the bytes of rows that go to Python at once, its default, and what ``small_batches`` puts in its place.
BATCH_BYTES, BATCH_DEFAULT, BATCH_SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(2 << 20)


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python 2 MB at once in this session; a setting of the session's own stays.

    By default a batch holds 10,000 rows or 64 MB, once in Python and, going
    and coming, in buffers outside the Java heap, for each task at a time.
    """
    if spark.conf.get(BATCH_BYTES, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_BYTES, BATCH_SMALL)


#: What ``cut`` returned within each ``temporary`` block.
_made: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Deletes at its end what ``cut`` kept within it; for callers that have written their results by then."""
    _made.append([])
    try:
        yield
    finally:
        drop(*_made.pop())


#: Spark's setting that removes the shuffle files of an action when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept as Parquet in the shared folder, with the size that they have; the step's shuffle files go when it ends."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        out = checkpointed(df)
    finally:
        spark.conf.set(CLEAN_UP, before)
    if _made:
        _made[-1].append(out)
    return out


def drop(*done: DataFrame) -> None:
    """Deletes the files of what ``cut`` returned and nothing reads any more."""
    forget(*done)


def labelled(rows: DataFrame, keys: Sequence[str], classes: DataFrame, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``classes`` (one row for each value of ``keys``, with its number of rows ``size``).

    Classes of more than 1/HOT of the ``total`` rows are fewer than HOT, so
    they are broadcast and their rows stay where they are; no task of the join
    of the others gets more than that share for one key. ``keys`` hold no null.
    """
    values = [c for c in classes.columns if c not in keys]
    hot = F.broadcast(classes.where(F.col(size) * HOT > total).select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in values]))
    tried = rows.join(hot, list(keys), "left")
    found = tried.where(F.col(f"__hot_{size}").isNotNull()).select(*rows.columns, *[F.col(f"__hot_{c}").alias(c) for c in values])
    cold = classes.where(F.col(size) * HOT <= total)
    rest = tried.where(F.col(f"__hot_{size}").isNull()).select(*rows.columns).join(cold, list(keys), how)
    return found.unionByName(rest.select(*rows.columns, *values))


@dataclass
class Sieve:
    """A Bloom filter of ids as 64-bit words, with 2^log bits."""

    log: int
    words: np.ndarray

    def passes(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def places(key: str, log: int) -> list[Column]:
    """The bits of a sieve of 2^log bits that a key has."""
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(1 << log)) for k in (1, 2)]


def sieve(ids: DataFrame) -> Sieve:
    """A Bloom filter of the ``id`` column with 16 bits for each of its rows, 2^SIEVE at most (32 MB).

    It only spares rows a journey: whatever passes is joined exactly after it.
    From some ten million ids on more and more pass that are not in it.
    """
    log = min(SIEVE, max(16, math.ceil(math.log2(16 * ids.count() + 1))))
    words = ids.select(F.explode(F.array(*places("id", log))).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (log - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return Sieve(log, out)


def sifted(rows: DataFrame, kept: Sieve, key: str, inside: bool = True) -> DataFrame:
    """Rows whose ``key`` passes a sieve: all that are in it, and a few others; or, not ``inside``, the rest."""
    shared = rows.sparkSession.sparkContext.broadcast(kept)
    hashed = rows.select("*", *[at.alias(f"__at{k}") for k, at in enumerate(places(key, kept.log))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (shared.value.passes(batch.column(batch.num_columns + k).to_numpy(zero_copy_only=False)) for k in (-2, -1))
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], batch.schema.names[:-2]).filter(pa.array((first & second) == inside))

    return hashed.mapInArrow(work, rows.schema)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fresh(prefix: str) -> str:
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def tokenizer_path(name: str = "piece_bpe_32k.model", folder: str = "/opt/tokenizers") -> str:
    """Where the driver finds a public tokenizer's vocabulary file."""
    return f"{folder}/{name}"
