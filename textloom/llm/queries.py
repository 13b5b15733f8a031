"""Queries of the training-data operators, and the SQL of those it can express.

Beside the thirteen, `mixing_targets`, `token_statistics` and `edited_texts` give those
columns of op1, op4 and op9 that SQL can check: sizes and targets, counts and base
scores, and what a text becomes with its neighbour's beginning as its end.
"""

from pyspark.sql import functions as F

from . import kdtree, kneser_ney, language, middle, mixing, pieces, simhash, spotsigs, token_count, topk, toxicity, urls, vafile


def mixing_targets(spark, sf_dir):
    rows = mixing.query(spark, sf_dir)
    return rows.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def token_statistics(spark, sf_dir):
    rows = kneser_ney.query(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def edited_texts(spark, sf_dir):
    return spotsigs.query(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {
    "op1_mixing": mixing.query,
    "op2_pieces": pieces.query,
    "op3_token_count": token_count.query,
    "op4_kneser_ney": kneser_ney.query,
    "op5_language": language.query,
    "op6_toxicity": toxicity.query,
    "op7_topk": topk.query,
    "op8_simhash": simhash.query,
    "op9_spotsigs": spotsigs.query,
    "op10_urls": urls.query,
    "op11_middle": middle.query,
    "op12_shards": kdtree.query,
    "op13_codes": vafile.query,
    "mixing_targets": mixing_targets,
    "token_statistics": token_statistics,
    "edited_texts": edited_texts,
}

#: The level at which the weighted shares of open sources take what is left, from the sums at each source's cap.
_TARGETS = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS f FROM s),
t AS (SELECT 1.5 * sum(source_size) AS total FROM s),
p AS (SELECT a.f, sum(least(b.w * a.f, b.cap)) AS given, sum(CASE WHEN b.f > a.f THEN b.w ELSE 0 END) AS open FROM (SELECT DISTINCT f FROM c UNION SELECT 0.0) a CROSS JOIN c b GROUP BY a.f),
l AS (SELECT f + CASE WHEN open > 0 THEN (total - given) / open ELSE 0 END AS level FROM p, t WHERE given <= total ORDER BY f DESC LIMIT 1)
SELECT d.doc_id, d.size, c.source_size, round(CAST(least(c.w * level, c.cap) AS DOUBLE), 4) AS target FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source, l
"""

#: The checksum of an id's digits goes bit by bit.
_STATISTICS = r"""
WITH RECURSIVE k(doc_id, t, c, n) AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS BIGINT), 0 FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, t, CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END, n + 1
  FROM (SELECT *, CASE WHEN n % 8 = 0 THEN xor(c, CAST(ord(substr(t, n // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM k WHERE n < 8 * length(t))
),
h AS (SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) % 10 = 0 AS held_out FROM k WHERE n = 8 * length(t)),
w AS (SELECT d.doc_id, held_out, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10))) AS token FROM documents d JOIN h USING (doc_id)),
v AS (SELECT token, count(*) AS c FROM w WHERE NOT held_out GROUP BY token),
a AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM v)
SELECT w.doc_id, w.held_out, count(*) AS n_tokens, count(v.c) AS n_known, any_value(a.n) AS train_tokens, round(sum(log10((coalesce(v.c, 0) + 0.1) / (a.n + 0.1 * (a.v + 1)))), 4) AS base_score
FROM w LEFT JOIN v ON w.token = v.token, a GROUP BY w.doc_id, w.held_out
"""

_EDITED = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS o FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substring(t, 1, n - n // 2) || substring(o, 1, n // 2)) AS edited_sha256 FROM n
"""

ORACLE_SQL = {"op7_topk": topk.SQL, "op10_urls": urls.SQL, "op11_middle": middle.SQL, "op13_codes": vafile.SQL, "mixing_targets": _TARGETS, "token_statistics": _STATISTICS, "edited_texts": _EDITED}
