"""The operators over the provided tables, one query each, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tavola.llm import byte_bpe, divergence, html_text, importance, line_dedup, lm_scoring, near_dup, packing, secrets, simhash, toxicity, vector_hashing, vector_search
from tavola.llm.common import read

RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: Words of a shingle in the queries of operators 9 and 13.
QUERY_SHINGLE_WORDS = 4


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the ownership of their values."""
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found for every hundredth vector."""
    rows = read(spark, sf_dir, "embeddings")
    return vector_hashing.nearest(rows, rows.where("vec_id % 100 = 0"), 10)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps of its lines."""
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return lm_scoring.score(read(spark, sf_dir, "documents"))


def op6_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products for every fiftieth vector."""
    rows = read(spark, sf_dir, "embeddings")
    return vector_search.inner_products(rows, rows.where("vec_id % 50 = 0"), 5).withColumn("score", F.col("score").cast("long"))


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and the bytes they decode to."""
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages"))


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document, on four-word shingles."""
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), QUERY_SHINGLE_WORDS)


def op10_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document is packed."""
    added = packing.added_tokens(public_tokenizers.path(TOKENIZER))
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, added=added)


def op11_cube_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that set each apart."""
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_crc_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by their likeness to the benchmark."""
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_covering_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, and its component, on four-word shingles."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), QUERY_SHINGLE_WORDS)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_multi_index_hashing, op3_line_dedup, op4_toxicity, op5_backoff_automaton, op6_branch_and_bound,
              op7_bpe_tree, op8_template_removal, op9_lsh_forest, op10_differencing, op11_cube_divergence, op12_crc_matrices,
              op13_covering_hashing, pipeline)
}

_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS t FROM documents),
p(kind, pat) AS (VALUES (0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'), (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]+'), (3, '[A-Za-z0-9+/_-]+')),
m AS (SELECT uid, doc_id, source, kind, regexp_extract_all(t, pat) AS ms, string_split_regex(t, pat) AS ss FROM d, p WHERE regexp_matches(t, pat)),
u AS (SELECT uid, doc_id, source, kind, unnest(ms) AS v, unnest(ss[1:len(ms)]) AS s, generate_subscripts(ms, 1) AS i FROM m),
w AS (SELECT *, sum(length(s)) OVER a + sum(length(v)) OVER a - length(v) AS lo,
      CASE WHEN kind = 0 THEN regexp_extract(v, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) ELSE v END AS val
      FROM u WINDOW a AS (PARTITION BY uid, kind ORDER BY i)),
k AS (SELECT uid, doc_id, source, kind, lo::BIGINT AS lo, (lo + length(v))::BIGINT AS hi, val FROM w
      WHERE length(val) >= CASE kind WHEN 0 THEN 6 WHEN 1 THEN 20 WHEN 2 THEN 24 ELSE 20 END
      AND (kind < 3 OR (regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')))),
c AS (SELECT * FROM k x WHERE kind < 3 OR NOT EXISTS (
      SELECT 1 FROM k b WHERE b.uid = x.uid AND b.kind < 3 AND b.lo < x.hi AND x.lo < b.hi)),
f AS (SELECT val, count(DISTINCT source) >= 3 OR count(DISTINCT doc_id) >= 25 AS copied FROM c GROUP BY val),
j AS (SELECT c.*, copied, NOT copied AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')
      AND len(list_distinct(string_split(val, ''))) >= 8 AS live,
      (CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'opaque' END) || ':' || lo || ':' || hi AS span
      FROM c JOIN f USING (val))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY lo, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY lo, kind) FILTER (kind < 3 OR live), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied
FROM d LEFT JOIN j ON j.uid = d.uid GROUP BY d.uid, d.doc_id
"""

_OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT uid, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
l AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s),
dup AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT l.*, coalesce(l.doc_id > first_doc, false) AS gone FROM l LEFT JOIN dup USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY uid, doc_id
"""

_OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS a FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
  coalesce(list_sum(list_transform(range(1, len(q.a) + 1), lambda i: q.a[i] * c.a[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.a) = len(c.a))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {_LOWER}) AS t FROM documents),
w AS (SELECT uid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT uid) >= 10),
l AS (SELECT g.lang, count(k.term)::HUGEINT AS v, coalesce(sum(k.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN k USING (lang) GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
      1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v) AS p, 1 + (1000000000 * (k.n + 2)) // (l.n + 2 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
      LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3, 4
      UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""

_WORDS12 = r"regexp_extract_all(translate(coalesce(text, ''), " + _LOWER + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS12} AS ws FROM documents),
b AS (SELECT unnest({_WORDS12}) AS word FROM benchmark),
w AS (SELECT uid, unnest(ws) AS word FROM d),
x AS (SELECT word, list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
      lambda c, y: list_reduce(list_prepend(xor(c, y), range(8)), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS crc
      FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM w UNION SELECT word FROM b))),
f AS (SELECT word, xor(crc, 4294967295) % 10000 AS bucket FROM x),
s AS (SELECT bucket, count(*) AS s FROM w JOIN f USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN f USING (word) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM w)::DOUBLE AS s_all, (SELECT count(*) FROM b)::DOUBLE AS t_all),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
      FROM s LEFT JOIN t USING (bucket), n),
a AS (SELECT uid, sum(gain)::BIGINT AS weight FROM w JOIN f USING (word) JOIN g USING (bucket) GROUP BY 1),
e AS (SELECT uid, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u FROM d LEFT JOIN a USING (uid)),
r AS (SELECT *, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score, n_features >= 20 AS eligible FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) FILTER (eligible) OVER () AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM o
"""

ORACLE_SQL: dict[str, str] = {"op11_cube_divergence": _OP11, "op12_crc_matrices": _OP12, "op1_secret_scan": _OP1, "op3_line_dedup": _OP3, "op6_branch_and_bound": _OP6}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
