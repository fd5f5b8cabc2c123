"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, license_scan, lm_scoring, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, url_filters
from .common import fold, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scores = quality_classifier.score_quality(documents, quality_classifier.trusted_ids(table(spark, sf_dir, "labels")))
    return scores.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return license_scan.scan_licenses(documents.withColumn("path", license_scan.document_path(documents)))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), labels.where("quality = 1").select("doc_id"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge_urls(pages, url_filters.listed_hosts(pages))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_quality_classifier, op2_near_dedup, op3_source_mix, op4_license_scan, op5_embedding_dedup, op6_quality_rules, op7_url_filter, op8_pii, op9_packing, op10_lm_score, pipeline)
    return {f.__name__: f for f in named}


_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
k AS (SELECT sh AS set_, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY 1),
e AS (SELECT rep, len(set_) AS n, unnest(set_) AS g FROM k),
f AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS both_, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM (SELECT * FROM e SEMI JOIN f USING (g)) a JOIN (SELECT * FROM e SEMI JOIN f USING (g)) b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * both_ >= 75 * (na + nb - both_)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, seen) AS (SELECT rep, rep FROM k UNION SELECT d.b, r.seen FROM r JOIN d ON d.a = r.node),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM s LEFT JOIN (SELECT set_, rep FROM k) k ON list_sort(s.sh) = k.set_ LEFT JOIN c ON c.node = k.rep
"""

_OP3 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s0),
s2 AS (SELECT *, [3.0, 1.0, 2.0][((sid - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from FROM s2),
s4 AS (SELECT *, cap * weight_from <= weight * (budget - full_before) AS is_full FROM s3),
s5 AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS full_caps, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS open_weight FROM s4),
s6 AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap, (budget - full_caps) * weight / open_weight) END AS target FROM s5),
r AS (SELECT d.doc_id, d.size, s6.source_size, s6.target, floor(s6.target)::BIGINT AS words,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before_
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
t AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (epochs * size + greatest(0, least(size, words - epochs * source_size - before_)))::BIGINT AS taken FROM t
"""

_OP5 = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

_OP7 = r"""
WITH h AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(act, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, host, path, rh || rp AS rule, act, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (h.host = rh OR ends_with(h.host, '.' || rh)) AND starts_with(h.path, rp))
SELECT page_id, host, path, rule, coalesce(act, CASE WHEN regexp_matches(host, '(^|\.)(spam|ads|phish|malware)[^.]*\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM m WHERE k = 1
"""


def oracle_sql() -> dict[str, str]:
    """The learnt operators (1, 6, 8, 10), the packing and the pipeline are tested against brute force instead."""
    return {"op2_near_dedup": _OP2, "op3_source_mix": _OP3, "op5_embedding_dedup": _OP5, "op7_url_filter": _OP7}
