"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, language_id, lexical_search, line_dedup, mixture, ngram_join, projection_forest, quality, sentencepiece, substring_dedup, suffix_array_dedup, transport_stream, vector_codes
from .tables import fanout, held_out, read, tokenizer_path

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM s0),
s2 AS (SELECT *, ((r - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))
                 / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev, cap / w AS ratio
       FROM s2 WINDOW o AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (SELECT lev FROM s3 WHERE lev <= ratio ORDER BY ratio, r LIMIT 1) AS level FROM s3),
targets AS (SELECT source, source_size, r, least(cap, coalesce(level * w, cap)) AS target FROM s4),
ranked AS (
  SELECT d.*, t.source_size, t.target, t.r,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS n
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
, counted AS (
  SELECT *, CAST(n + CASE WHEN size > 0 AND b + size / 2.0 <= target - n * source_size THEN 1 ELSE 0 END AS INTEGER) AS copies,
         (b + size / 2.0::DOUBLE) / target AS share
  FROM ranked),
-- demand up to progress u is the integral of a schedule linear between knots; its inverse is a root in one of its pieces
used AS (SELECT *, share * [1.0, 1.0, 0.975][(r - 1) % 3 + 1]::DOUBLE AS q FROM counted)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(size * copies AS BIGINT) AS taken, copies,
       round(CASE WHEN copies = 0 THEN NULL WHEN (r - 1) % 3 = 0 THEN q WHEN (r - 1) % 3 = 1 THEN 1.5 - sqrt(greatest(2.25 - 2 * q, 0))
                  WHEN q <= 0.375 THEN (sqrt(0.0625 + 2.5 * q) - 0.25) / 1.25 ELSE 0.6 + (sqrt(1 + 5 * (q - 0.375)) - 1) / 2.5 END, 6) AS position
FROM used
"""

LINE_SQL = r"""
WITH l AS (SELECT doc_id, i, line, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
c AS (SELECT *, CASE WHEN (h + 48271 * coalesce(lag(h, 1) OVER w, 0) + 182605794 * coalesce(lag(h, 2) OVER w, 0)) % 2147483647 % 4 = 0 THEN 1 ELSE 0 END AS e
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM c),
k AS (SELECT doc_id, no, count(*) AS len, string_agg(line, chr(10) ORDER BY i) AS chunk FROM n GROUP BY doc_id, no),
f AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, no) AS rn FROM k),
g AS (SELECT *, len >= 2 AND rn > 1 AS gone FROM f),
o AS (SELECT doc_id, count(*) AS n_chunks, sum(len) AS n_lines, coalesce(sum(len) FILTER (gone), 0) AS n_removed_lines,
             coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text
      FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN o.text END AS text, d.lang, d.source, d.n_chars,
       CAST(coalesce(o.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(o.n_chunks, 0) AS INTEGER) AS n_chunks,
       CAST(coalesce(o.n_removed_lines, 0) AS INTEGER) AS n_removed_lines
FROM documents d LEFT JOIN o USING (doc_id)
"""

#: Windows of 20 words that start again, and the words that they cover.
REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
g AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + k AS i, true AS gone FROM g, range(20) r(k)),
o AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT doc_id, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone IS NULL) AS kept FROM o LEFT JOIN c USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

#: The same for strings of 100 bytes: starts of repeats, the runs that they cover, and what is left between runs.
BYTES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(encode(text), ''::BLOB) AS t FROM documents),
v AS (SELECT doc_id, i, md5_number(array_slice(t, i, i + 99)::VARCHAR) AS s FROM (SELECT doc_id, t, unnest(range(1, octet_length(t) - 98)) AS i FROM d)),
g AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
n AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM g),
u AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n),
r AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS e FROM u GROUP BY doc_id, k),
x AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS f FROM r),
z AS (SELECT doc_id, count(*) AS n_spans, sum(e - a + 1) AS n_removed, max(e) AS last, string_agg(CASE WHEN a > f THEN hex(array_slice(t, f, a - 1)) ELSE '' END, '' ORDER BY a) AS kept FROM x JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, octet_length(t) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || CASE WHEN octet_length(t) > coalesce(last, 0) THEN hex(array_slice(t, coalesce(last, 0) + 1, octet_length(t))) ELSE '' END)) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id)
"""

#: All pairs that share a shingle, and the components of those that are similar enough.
JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
m AS (SELECT id AS doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

#: Parts of four components a row; three assignments to the nearest of 64 entries, two moves of the entries between them.
NEAREST = """{to} AS (SELECT t.vec_id, t.p, t.a, t.b, t.c, t.d, min((power(t.a - k.a, 2) + power(t.b - k.b, 2) + power(t.c - k.c, 2) + power(t.d - k.d, 2))::BIGINT * 64 + k.e) AS best FROM parts t JOIN {books} k USING (p) GROUP BY ALL)"""
MOVED = """{to} AS (SELECT k.p, k.e, {means} FROM {books} k LEFT JOIN (SELECT p, best % 64 AS e, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM {rows} GROUP BY 1, 2) s USING (p, e))"""
MEANS = ", ".join(f"CAST(coalesce(floor(s.{c}::DOUBLE / s.n), k.{c}) AS BIGINT) AS {c}" for c in "abcd")
CODES_SQL = f"""
WITH kept AS (SELECT vec_id, label, [CAST(floor(256 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT vec_id, p, v[p * 4 + 1] AS a, v[p * 4 + 2] AS b, v[p * 4 + 3] AS c, v[p * 4 + 4] AS d FROM kept, range(16) r(p)),
books0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, a, b, c, d FROM parts QUALIFY e < 64),
{NEAREST.format(to="rows0", books="books0")}, {MOVED.format(to="books1", books="books0", rows="rows0", means=MEANS)},
{NEAREST.format(to="rows1", books="books1")}, {MOVED.format(to="books2", books="books1", rows="rows1", means=MEANS)},
{NEAREST.format(to="rows2", books="books2")},
coded AS (SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM rows2 GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) FROM books2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""

SAID = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""
WITH c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({SAID}) AS term FROM documents) GROUP BY 1, 2),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY 1),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM n),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({SAID}) AS term FROM benchmark)),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, g WHERE term IN (SELECT term FROM q) GROUP BY 1),
m AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // len AS m FROM n, g),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN c USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = mixture.mix(docs).withColumn("position", F.try_element_at("positions", F.lit(1)))
    return mixture.by_position(out, fanout(docs)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies", F.round("position", 6).alias("position"))


def removed(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["len"]).alias("n_removed")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_words(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", removed("spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup.dedup_bytes(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", removed("spans"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(read(spark, sf_dir, "documents"), n=3, percent=90)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_links(read(spark, sf_dir, "embeddings"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids of every whole text, and whether they decode to it; the vocabulary of ``path``."""
    path = path or tokenizer_path()
    out = sentencepiece.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return out.select("doc_id", "n_tokens", "ids", F.col("text").eqNullSafe(F.col("decoded")).alias("exact"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = language_id.label(docs, language_id.learn(docs))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = quality.score(docs.select("doc_id", "text"), quality.learn(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def op9_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.digest(transport_stream.store(read(spark, sf_dir, "documents")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    books = vector_codes.learn(vectors)
    out = vector_codes.with_group_error(vector_codes.encode(vectors, books, keep=("vec_id", "label")), "label")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_mixture, op2_sentencepiece, op3_language_id, op4_quality, op5_substring_dedup, op6_ngram_join, op7_embedding_dedup, op8_line_dedup, op9_transport_stream, op10_suffix_array_dedup, op11_vector_codes, op12_projection_forest, op13_lexical_search)}
ORACLE = {"op1_mixture": MIX_SQL, "op5_substring_dedup": REPEATS_SQL, "op6_ngram_join": JACCARD_SQL, "op8_line_dedup": LINE_SQL, "op10_suffix_array_dedup": BYTES_SQL, "op11_vector_codes": CODES_SQL, "op13_lexical_search": SEARCH_SQL}
