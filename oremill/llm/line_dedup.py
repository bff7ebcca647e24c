"""Removing multi-line chunks that repeat, with boundaries set by the content.

Native: DataFrame functions only. A line's hash is 28 bits of its md5; a rolling
hash of three of them, a polynomial modulo a prime, closes a chunk where it is
divisible by ``period``, so an inserted line moves only the boundaries near it.
Chunks of two lines and more that occur more than once are candidates; a
candidate goes when its bytes equal those of the first chunk of its digest
(smallest doc_id, then place). A digest with more than 1/HOT of all chunks is
salted: its first chunk goes to each salt, the others are spread over them.

Defined results: a null text stays null and has no lines; an empty text has one
empty line; rows with a null doc_id are returned as they are and are no source;
of equal rows the chunks count as one place, so all or none of them lose it; an
empty table gives an empty one; other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import HOT, cut, labelled

PERIOD = 4
#: The rolling hash: a line's hash plus BASE times that of the line before plus BASE^2 times that before it, modulo PRIME.
BASE, PRIME = 48271, 2147483647


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def with_chunks(docs: DataFrame, period: int = PERIOD) -> DataFrame:
    """Adds __lines and __chunks: array of (no, start, len), start counted from 1."""
    d = docs.withColumn("__lines", F.split("text", "\n", -1))
    d = d.withColumn("__h", F.transform("__lines", line_hash))
    back = lambda n: F.concat(F.array_repeat(F.lit(0).cast("long"), n), F.col("__h"))
    d = d.withColumn("__z", F.arrays_zip(F.col("__h").alias("a"), back(1).alias("b"), back(2).alias("c")))
    rolled = lambda x: (x["a"] + BASE * x["b"] + BASE * BASE % PRIME * x["c"]) % PRIME
    at_end = lambda x, i: (rolled(x) % period == 0) | (i == F.size("__h") - 1)
    d = d.withColumn("__ends", F.filter(F.transform("__z", lambda x, i: F.when(x["a"].isNotNull() & at_end(x, i), i + 1)), lambda e: e.isNotNull()))
    d = d.withColumn("__e", F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("__ends")).alias("s"), F.col("__ends").alias("e")))
    chunks = F.transform(F.filter("__e", lambda x: x["e"].isNotNull()), lambda x, i: F.struct(i.alias("no"), (x["s"] + 1).alias("start"), (x["e"] - x["s"]).alias("len")))
    return d.withColumn("__chunks", chunks).drop("__h", "__z", "__ends", "__e")


def place(start: Column | str, length: Column | str) -> Column:
    """A chunk's start and length as one number."""
    at, n = (F.col(x) if isinstance(x, str) else x for x in (start, length))
    return F.shiftleft(at.cast("long"), 32) + n.cast("long")


def chunk_text(c: Column) -> Column:
    return F.array_join(F.slice(F.col("__lines"), c["start"], c["len"]), "\n")


def dedup_lines(docs: DataFrame, period: int = PERIOD, min_lines: int = 2) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and n_lines, n_chunks, n_removed_lines."""
    key, results = ["doc_id", "__row"], ("doc_id", "text", "n_lines", "n_chunks", "n_removed_lines")
    # the caller's other columns travel in a struct, where no name can clash
    others = [c for c in docs.columns if c not in results]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("__end")).alias("__others"))
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("__row"))
    found = with_chunks(own, period).select(*key, F.explode(F.transform(F.filter("__chunks", lambda c: c["len"] >= min_lines), lambda c: F.struct(c["no"].alias("no"), c["start"].alias("start"), c["len"].alias("len"), F.unhex(F.md5(chunk_text(c).cast("binary"))).alias("digest")))).alias("c"))
    found = cut(found.where(F.col("doc_id").isNotNull()).select(*key, "c.*"))
    total = found.count()
    repeated = found.groupBy("digest").agg(F.min(F.struct(*key, "no")).alias("first"), F.max(F.struct(*key, "no")).alias("last"), F.count("*").alias("n")).where("first != last").drop("last")
    salts = F.ceil(F.col("n") * HOT / F.lit(max(total, 1))).cast("int")
    is_first = F.struct(*key, "no") == F.col("first")
    wanted = labelled(found, ["digest"], repeated, "n", total).select(*key, F.struct("digest", "start", "len", is_first.alias("is_first"), salts.alias("salts")).alias("w"))
    wanted = wanted.groupBy(*key).agg(F.collect_set("w").alias("wanted"))
    texts = own.join(wanted, key).withColumn("__lines", F.split("text", "\n", -1)).select(*key, "__lines", F.explode("wanted").alias("w"))
    texts = texts.select(*key, "w.*", chunk_text(F.col("w")).alias("chunk"))
    firsts = texts.where("is_first").groupBy("digest", "salts").agg(F.min("chunk").alias("chunk"))
    firsts = firsts.select("digest", "chunk", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    others = texts.where("not is_first").withColumn("salt", F.pmod(F.xxhash64(*key, "start"), F.col("salts")).cast("int"))
    removed = others.join(firsts, ["digest", "salt", "chunk"], "left_semi")
    removed = removed.groupBy(*key).agg(F.collect_set(place("start", "len")).alias("__gone"))
    out = packed.withColumn("__row", F.xxhash64("text")).alias("d").join(removed.hint("shuffle_hash").alias("r"), (F.col("d.doc_id") == F.col("r.doc_id")) & (F.col("d.__row") == F.col("r.__row")), "left")
    out = with_chunks(out.select("d.*", F.coalesce("r.__gone", F.array().cast("array<bigint>")).alias("__gone")), period)
    left = F.array_except(F.transform("__chunks", lambda c: place(c["start"], c["len"])), F.col("__gone"))
    kept = F.transform(left, lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("start"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("len")))
    out = out.withColumn("__kept", kept)
    lines = F.aggregate("__kept", F.lit(0), lambda a, c: a + c["len"])
    text = F.when(F.size("__gone") == 0, F.col("text")).otherwise(F.array_join(F.transform("__kept", chunk_text), "\n"))
    out = out.withColumn("n_lines", F.greatest(F.size("__lines"), F.lit(0))).withColumn("n_chunks", F.greatest(F.size("__chunks"), F.lit(0)))
    out = out.withColumn("n_removed_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines") - lines)).withColumn("text", text)
    return out.select(*[c if c in results else F.col("__others")[c].alias(c) for c in docs.columns], *[c for c in results if c not in docs.columns])
