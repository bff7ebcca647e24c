"""The pipeline's stages against brute force on what each received."""

import re
import tracemalloc
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from oremill.llm import ngram_join, quality, sentencepiece, tables
from oremill.llm.tables import read

SF = "/root/testdata/sf0.001"


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark, tmp_path):
    docs = read(spark, SF, "documents")
    steps = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, steps[-1], SF)
        if k < len(pipeline.STAGES) - 1:
            assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(str(tmp_path / str(k)))
        steps.append(spark.read.parquet(str(tmp_path / str(k))))
    start, good, lines, apart, mixed, ids = steps
    labels = read(spark, SF, "labels")
    kept = good.select("doc_id").withColumn("kept", F.lit(1))
    share = start.join(labels, "doc_id").join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("s"))
    share = {r["quality"]: r["s"] for r in share.collect()}
    assert share[1] > 0.9 and share[0] < 0.5
    assert lines.count() <= good.count() and lines.join(good, "doc_id", "left_anti").count() == 0
    # no two that stay are similar, and what went was similar to something
    sets = {r["doc_id"]: grams(r["text"]) for r in lines.collect()}
    stay = {r["doc_id"] for r in apart.collect()}
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    ids_ = sorted(sets)
    for k, a in enumerate(ids_):
        for b in ids_[:k]:
            assert not (a in stay and b in stay and near(sets[a], sets[b]))
    for a in set(ids_) - stay:
        assert any(b < a and near(sets[a], sets[b]) for b in ids_) or any(near(sets[a], sets[b]) for b in ids_ if b != a)
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(copies.values()) <= 3 and set(copies) <= stay
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = {r["doc_id"]: words(r["text"]) for r in apart.collect()}
    assert abs(sum(size[i] * n for i, n in copies.items()) - sum(size.values())) < 0.25 * sum(size.values())
    assert ids.count() == mixed.count() and ids.where("not (text <=> decoded)").count() == 0


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert {"doc_id", "ids", "n_tokens", "decoded"} <= set(out.columns) and out.count() > 0


class Caught:
    """Stands for a DataFrame and keeps what its rows would be given to."""

    def __init__(self):
        self.given, self.sparkSession, self.sparkContext = [], self, self

    def select(self, *columns):
        return self

    where = repartition = select

    def broadcast(self, value):
        return type("Shared", (), {"value": value})

    def mapInArrow(self, work, schema):
        self.given.append(work)
        return self

    def toArrow(self):
        return pa.table({})


@pytest.mark.parametrize("step, most", [("contexts", 60), ("features", 60), ("profiles", 28), ("companies", 28)])
def test_workers_hold_little_at_once(spark, monkeypatch, step, most):
    """A slice of 1 MB took 89, 97, 45 and 43 MB of arrays, which its worker keeps."""
    rng = np.random.default_rng(8)
    words = np.array(["w%d" % i for i in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 600)]) for _ in range(700)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(700)), "id": list(range(700)), "label": pa.array([1] * 700, pa.int32()), "text": texts, "__picked": [False] * 700})
    docs = Caught()
    for module in (quality, ngram_join):
        monkeypatch.setattr(module, "fanout", lambda *a: 4)
    vectors = docs.broadcast(np.zeros((quality.UNITS + quality.SHAPES, quality.DIM), np.float32))
    if step == "contexts":
        quality.contexts(docs)
    elif step == "features":
        quality.features(docs, vectors, "label")
    elif step == "profiles":
        ngram_join.profiles(docs, 5, 0.0)
    else:
        ngram_join.companies(docs, 5, ngram_join.planned(80, np.full(len(ngram_join.edges(80)) - 1, 700.0), []))
    tracemalloc.start()
    rows = sum(len(x) for x in docs.given[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < most << 20


def test_decoding_in_pieces(monkeypatch):
    """2 MB of text took 40 MB of arrays at once."""
    many = pa.array([[(i * k) % 10 for i in range(1000)] for k in range(500)], pa.list_(pa.int32()))
    words = sentencepiece.byte_table([b" wo%d" % i for i in range(10)])
    tracemalloc.start()
    assert len(sentencepiece.texts_of(many, *words)) == 500
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 26 << 20
    lists = pa.array([[0, 1, 2], None, [], [2, 2], [1], [0, 0]], pa.list_(pa.int32()))
    table = sentencepiece.byte_table([b" abcdefgh", b"", "ß".encode()])
    want = ["abcdefghß", None, "", "ßß", "", "abcdefgh abcdefgh"]
    for limit in (1, 3, 9, 1 << 18):
        monkeypatch.setattr(sentencepiece, "FINE", limit)
        assert sentencepiece.texts_of(lists, *table).to_pylist() == want


def test_signatures_in_fine_slices_are_dealt_together(spark, monkeypatch):
    """What leaves a slice of 1 MB is the same rows, however finely it was gone through."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [f"a b c d{i % 3} e f g{i} h i " * (1 + i % 5) for i in range(39)] + [None]})
    monkeypatch.setattr(ngram_join, "fanout", lambda *a: 4)
    got = []
    for limit in (1, 200, 1 << 20):
        monkeypatch.setattr(ngram_join, "FINE", limit)
        docs = Caught()
        ngram_join.companies(docs, 5, ngram_join.planned(80, np.full(len(ngram_join.edges(80)) - 1, 40.0), []))
        (out,) = docs.given[0](iter([batch]))
        columns = ngram_join.gather([out], ["<u8", "<i8", "u1", "<u2", "?"])
        got.append((out.num_rows, sorted(zip(*(c.tolist() for c in columns), strict=True))))
    assert got[0][1] and all(a == b for a, b in pairwise(got))


def test_stages_send_small_batches(spark):
    """By default one batch held all 9 MB; a setting of the session's own stays."""
    key = tables.BATCH_BYTES
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 3000).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(3000).cast("long").alias("n_chars"))
    sizes = lambda: [r["n"] for r in docs.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long").collect()]
    try:
        spark.conf.unset(key)
        assert sizes() == [3000]
        pipeline.sentencepiece_ids(spark, docs, SF)
        assert sum(sizes()) == 3000 and max(sizes()) * 3000 < 4 << 20
        spark.conf.set(key, "1m")
        tables.small_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
