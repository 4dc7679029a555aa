"""The registered corpus queries: each applies one operator with production
parameters to its whole table.  ``ORACLE`` has DuckDB SQL where SQL can say
the same; the others are held against brute force in the tests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (ann, bpe, embedding_dedup, hard_negatives, hmm, langid, line_dedup, ngram_join, packing, spelling, substring_dedup,
                          token_counts, warc)
from tillroll.llm.common import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_spans(_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(_table(spark, sf_dir, "documents"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model_scores(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, label = F.col("vec_id"), F.col("label")
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), every % 100 == 0, F.when(every % 7 == 0, (label + 1) % 10).otherwise(label))


QUERIES = {f.__name__: f for f in (
    op1_bpe_round_trip, op2_warc_normaliser, op3_embedding_dedup, op4_substring_dedup, op5_ngram_join, op6_language_id,
    op7_nearest_neighbours, op8_best_fit_packing, op9_token_counts, op10_line_dedup,
    op11_language_model, op12_spelling_variants, op13_hard_negatives)}

_LINES = r"""
cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS line FROM cut),
lines AS (
  SELECT doc_id, line, l, trim(regexp_replace(lower(l), '\s+', ' ', 'g')) AS norm,
         CAST(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(l) - 1 AS BIGINT) AS start_at
  FROM raw)"""

_VECTORS = """
vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0)"""

ORACLE: dict[str, str] = {
    "op2_warc_normaliser": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, strlen(h) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS best,
         array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
           (CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) // CAST(pow(32, 3 - k % 4) AS BIGINT)) % 32) AS BIGINT), 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM d""",
    "op3_embedding_dedup": f"""
WITH RECURSIVE {_VECTORS},
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach(v, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.v),
comp AS (SELECT v, min(c) AS c FROM reach GROUP BY v),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(deg.n, 0) AS n_links, comp.c AS component_id, e.vec_id = comp.c AS kept
FROM embeddings e JOIN comp ON comp.v = e.vec_id LEFT JOIN deg ON deg.a = e.vec_id""",
    "op4_substring_dedup": rf"""
WITH {_LINES},
pieces AS (SELECT doc_id, line, start_at, regexp_extract_all(l, '[^.!?]*[.!?]+[ \t]*|[^.!?]+') AS ps FROM lines),
piece AS (SELECT doc_id, line, start_at, unnest(ps) AS l, generate_subscripts(ps, 1) AS i FROM pieces WHERE len(ps) > 1),
placed AS (
  SELECT doc_id, line, l, CAST(start_at + sum(length(l)) OVER (PARTITION BY doc_id, line ORDER BY i) - length(l) AS BIGINT) AS start_at
  FROM piece),
every AS (
  SELECT doc_id, line, start_at, start_at + length(l) AS end_at, norm, TRUE AS whole FROM lines
  UNION ALL SELECT doc_id, line, start_at, start_at + length(l), trim(regexp_replace(lower(l), '\s+', ' ', 'g')), FALSE FROM placed),
units AS (
  SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(start_at) OVER w AS kept_start, first_value(end_at) OVER w AS kept_end
  FROM every WHERE len(string_split(norm, ' ')) >= 8 WINDOW w AS (PARTITION BY norm ORDER BY doc_id, start_at, end_at)),
gone AS (SELECT *, max(whole) OVER (PARTITION BY doc_id, line) AS goes FROM units WHERE (doc_id, start_at, end_at) <> (kept_doc_id, kept_start, kept_end))
SELECT doc_id, line, start_at AS "start", end_at AS "end", kept_doc_id, kept_start, kept_end FROM gone WHERE whole OR NOT goes""",
    "op5_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents WHERE text IS NOT NULL),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach(v, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.v),
comp AS (SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, comp.c AS component_id
FROM documents d JOIN comp ON comp.v = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id""",
    "op7_nearest_neighbours": f"""
WITH {_VECTORS},
near AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])),
           lambda a, b: a + b)) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM near QUALIFY rank <= 10""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5""",
    "op10_line_dedup": f"""
WITH {_LINES},
units AS (SELECT *, length(norm) AS n FROM lines WHERE length(norm) >= 30),
firsts AS (SELECT norm, n, min((doc_id, line, start_at)) AS first FROM units GROUP BY norm, n),
halves AS (
  SELECT norm, first, m, side, CASE side WHEN 0 THEN substr(norm, 1, m // 2) ELSE substr(norm, n - (m - m // 2) + 1) END AS half
  FROM (SELECT norm, n, first, unnest([n, n - 1]) AS m FROM firsts) CROSS JOIN (VALUES (0), (1)) s(side)),
near AS (
  SELECT DISTINCT a.norm, b.first FROM halves a JOIN halves b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND a.norm <> b.norm
  WHERE abs(length(a.norm) - length(b.norm)) <= 1 AND levenshtein(a.norm, b.norm) <= 1),
best AS (SELECT norm, min(first) AS kept FROM (SELECT norm, first FROM firsts UNION ALL SELECT norm, first FROM near) GROUP BY norm)
SELECT doc_id, line, start_at AS "start", start_at + length(l) AS "end", kept[1] AS kept_doc_id, kept[2] AS kept_line, kept[3] AS kept_start
FROM units JOIN best USING (norm) WHERE (doc_id, line, start_at) > kept""",
}
