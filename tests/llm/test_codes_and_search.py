"""Vector codes, the projection forest and lexical search against brute force, and on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from oremill.llm import lexical_search, projection_forest, vector_codes

BAD = [(900, None), (901, [float("nan")] + [1.0] * 63), (902, [None] + [1.0] * 63), (903, [float("-inf")] * 64), (904, [])]


def vectors_of(spark, rows, kind="float", **more):
    df = spark.createDataFrame([(i, v, None if k % 3 == 0 else k % 2) for k, (i, v) in enumerate(rows)], f"vec_id long, embedding array<{kind}>, label int")
    return df.withColumns({c: F.lit("clash") for c in ("code", "error", "__v", "place", "same", "rep", "n", "vec", "ids", "score", "part", "entry")}).repartition(3)


def clustered(rng, n, d=64, groups=12):
    middle = rng.normal(size=(groups, d))
    return (middle[rng.integers(0, groups, n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)


@pytest.mark.parametrize("k", [1, 3, 4, 17])
def test_equal_average_search_is_exact(k):
    rng = np.random.default_rng(k)
    # few values, so that many distances tie
    x, entries = rng.integers(-3, 4, (500, k)), rng.integers(-3, 4, (64, k))
    at, best = vector_codes.nearest(x, entries)
    d2 = ((x[:, None, :] - entries) ** 2).sum(axis=2)
    assert (at == d2.argmin(axis=1)).all() and (best == d2.min(axis=1)).all()


def codes_again(rows, size, parts=16, entries=64, rounds=2):
    """rows: (id, vector) that are kept. {(id, code, error)}, hash."""
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    order = sorted(range(len(ints)), key=lambda r: (ints[r][0] is None, ints[r][0], rows[r][1]))
    bounds = [p * size // parts for p in range(parts + 1)]
    cut = lambda v: [tuple(v[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    books = [[cut(ints[r][1])[p] for r in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda p, part: min(range(len(books[p])), key=lambda e: (far(part, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v in ints:
                own[place(p, cut(v)[p])].append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(own[e]) for c in zip(*own[e], strict=True)) if own[e] else old for e, old in enumerate(books[p])]
    out = Counter()
    for i, v in ints:
        at = [place(p, part) for p, part in enumerate(cut(v))]
        out[i, "".join("%02x" % e for e in at), sum(far(part, books[p][e]) for p, (part, e) in enumerate(zip(cut(v), at, strict=True)))] += 1
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize(("n", "size"), [(150, 64), (20, 64), (90, 37), (70, 5)])
def test_op11_equals_brute_force(spark, n, size):
    x = clustered(np.random.default_rng(n), n, size, 5)
    rows = [(1000 - 3 * i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [rows[4], (rows[5][0], rows[6][1]), (None, rows[7][1])]
    df = vectors_of(spark, rows + [b for b in BAD if b[0] != 904] + [(905, [1.0, 2.0])])
    books = vector_codes.learn(df)
    got = Counter((r["vec_id"], bytes(r["code"]).hex(), r["error"]) for r in vector_codes.encode(df, books).collect())
    want, sha = codes_again(rows, size)
    assert got == want and books.sha256() == sha


def test_op11_label_errors_empty_tables_and_large_components(spark):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(clustered(np.random.default_rng(1), 100))]
    df = vectors_of(spark, rows)
    books = vector_codes.learn(df)
    coded = vector_codes.encode(df, books, keep=("vec_id", "label"))
    out = vector_codes.with_group_error(coded, "label").collect()
    sums = Counter()
    for r in out:
        sums[r["label"]] += r["error"]
    assert len(out) == 100 and {r["label"] for r in out} == {None, 0, 1} and all(r["label_error"] == sums[r["label"]] for r in out)
    back = {r["vec_id"]: r["decoded"] for r in vector_codes.decode(coded, books).collect()}
    ints = np.floor(256 * np.array([v for _, v in rows]))
    error = {r["vec_id"]: r["error"] for r in out}
    assert all(((ints[i] - 256 * np.array(back[i])) ** 2).sum() == error[i] for i, _ in rows)
    none = vector_codes.learn(df.where("false"))
    assert vector_codes.encode(df.where("false"), none).count() == 0 and vector_codes.with_group_error(vector_codes.encode(df.where("false"), none, keep=("label",)), "label").count() == 0
    huge = vectors_of(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)])
    assert [r["error"] for r in vector_codes.encode(huge, vector_codes.learn(huge)).collect()] == [0, 0, 0]


def neighbours_again(rows, query, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    s = u @ u[int(np.flatnonzero(ids == query)[0])]
    return [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s.round(9))) if ids[j] != query][:k]


@pytest.mark.parametrize(("leaf", "levels"), [(64, 10), (16, 3)])
def test_op12_recall_and_scores(spark, leaf, levels):
    x = clustered(np.random.default_rng(2), 1500)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = vectors_of(spark, rows)
    got = projection_forest.nearest(df, F.col("vec_id") % 50 == 0, leaf=leaf, levels=levels).collect()
    lists = defaultdict(dict)
    for r in got:
        lists[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q in range(0, 1500, 50):
        want, mine = neighbours_again(rows, q, 5), [lists[q][n] for n in range(1, 6)]
        hits += len({i for i, _ in want} & {i for i, _ in mine})
        u = x.astype(float)
        for i, s in mine:
            assert s == pytest.approx(u[q] @ u[i] / math.sqrt((u[q] @ u[q]) * (u[i] @ u[i])), abs=1e-12)
        assert [s for _, s in mine] == sorted((s for _, s in mine), reverse=True)
    assert set(lists) == set(range(0, 1500, 50)) and hits >= 0.9 * 150


def test_op12_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 60)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    # one vector that very many rows have, queries among them
    rows += [(i, rows[7][1]) for i in range(100, 400)] + [(i, [4 * v for v in rows[9][1]]) for i in range(400, 430)]
    df = vectors_of(spark, rows + [rows[3], (None, rows[1][1]), (950, [0.0] * 64), (951, [1.0] * 3), *BAD])
    got = defaultdict(list)
    for r in projection_forest.nearest(df, F.col("vec_id") % 50 == 0, leaf=32).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert set(got) == {0, *range(50, 401, 50)}
    for q in range(100, 400, 50):
        assert got[q] == list(enumerate([i for i in (7, 100, 101, 102, 103, 104, 105) if i != q][:5], 1))
    assert [i for _, i in got[400]] == [9, 401, 402, 403, 404]
    few = vectors_of(spark, rows[:3])
    assert projection_forest.nearest(few, F.col("vec_id") == 0).count() == 2
    assert projection_forest.nearest(few.limit(1), F.col("vec_id") >= 0).count() == 0
    assert projection_forest.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert projection_forest.nearest(df, F.lit(False)).count() == 0


def test_shared_queue_gives_leaves_by_penalty():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    trees = [projection_forest.grown(x, 4, t) for t in range(3)]
    for q in rng.normal(size=(20, 8)):
        want = []
        for t, tree in enumerate(trees):
            gaps = tree.normals @ q - tree.cuts
            for leaf in range(16):
                node, penalty = leaf + 15, 0.0
                while node:
                    up = (node - 1) // 2
                    penalty += 0.0 if (node == 2 * up + 2) == (gaps[up] > 0) else gaps[up] ** 2
                    node = up
                want.append((penalty, t, leaf))
        found = projection_forest.walk([(tree.normals @ q - tree.cuts).tolist() for tree in trees], 15, 48)
        assert np.allclose([f[0] for f in found], sorted(w[0] for w in want)) and {f[1:] for f in found} == {w[1:] for w in want}
    sizes = np.bincount(trees[0].leaves(x, np.arange(300)), minlength=16)
    assert sizes.min() >= 17 and sizes.max() <= 20


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked_again(docs, items, depth=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in items:
        scores = []
        for i, b in bags:
            if i is None or not b:
                continue
            m = 10 + 90 * sum(b.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scores.append((-s, i))
        for k, (s, i) in enumerate(sorted(scores)[:depth], 1):
            out[item, k, i, -s] += 1
    return out


def odd_texts():
    rng = np.random.default_rng(6)
    words = ["Alpha", "beta7", "GAMMA", "é漢", "Ünder", "x", "delta", "eps", "zeta", "İ", "kappa9", "the"]
    say = lambda n: " ".join(rng.choice(words, n))
    docs = [(i, say(int(rng.integers(1, 40)))) for i in range(60)] + [(i, "alpha beta7-beta7 the") for i in range(200, 260)]
    # same item terms, other words of other number: equal bags, other lengths
    docs += [(i, "ALPHA,beta7 Beta7 the" + " zz" * (i % 3)) for i in range(300, 330)] + [(400, None), (401, ""), (402, " ,.;"), (403, say(30000)), (None, "alpha"), (404, "unheard of"), (7, "eps eps"), (7, "eps eps")]
    items = [(1, "alpha BETA7!"), (2, "É漢 ünder zeta"), (3, None), (4, "nowhere"), (5, "the the The"), (5, "kappa9"), (6, "x_delta eps"), (None, "gamma")]
    return docs, items


def test_op13_equals_brute_force(spark, monkeypatch):
    docs, items = odd_texts()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "bag", "m", "h", "k", "ids", "score", "item", "item_id")}).repartition(4)
    b = spark.createDataFrame(items, "item_id int, text string").withColumn("rank", F.lit("clash"))
    want = ranked_again(docs, items)
    for block in (50_000, 3):
        monkeypatch.setattr(lexical_search, "ITEMS", block)
        got = lexical_search.search(d, b)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(tuple(r) for r in got.collect()) == want
    assert lexical_search.search(d.where("false"), b).count() == 0 and lexical_search.search(d, b.where("false")).count() == 0
    shallow = lexical_search.search(d, b, depth=2)
    assert Counter(tuple(r) for r in shallow.collect()) == ranked_again(docs, items, 2)


def test_op13_copies_are_one_class(spark):
    docs, items = odd_texts()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    words = lexical_search.vocabulary(*map(list, zip(*items, strict=True)))
    kept = lexical_search.bags(d, words)
    found = lexical_search.classes(kept, 100, 5000, 10).collect()
    bags = {(bytes(r["bag"]), 10 + 90 * r["n"] * 100 // 5000) for r in kept.collect() if r["doc_id"] is not None and r["bag"]}
    assert len(found) == len(bags) and {(bytes(r["bag"]), r["m"]) for r in found} == bags
    assert list(range(200, 210)) in [r["ids"] for r in found] and max(len(r["ids"]) for r in found) == 10
