"""The registered queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import ORACLE as audit_sql
from .drake import oracle_sql as clusters_sql
from .exact import ORACLE as exact_sql
from .licenses import oracle_sql as licenses_sql
from .linkgraph import oracle_sql as urls_sql
from .mixing import ORACLE as mixing_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .storage import shared_folder
    from .warc import page_number, read_warc, write_warc

    path = shared_folder(spark)
    write_warc(_table(spark, sf_dir, "pages"), path)
    found = read_warc(spark, path, with_payload=False).where("kind = 'record'")
    return found.select(page_number().alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge_quality

    return judge_quality(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs, held = _table(spark, sf_dir, "documents").select("doc_id", "text"), F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held))
    return score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_key, replace_personal_data

    return replace_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii_key(spark))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linkgraph import RULES, judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), RULES, keep=["page_id"])


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .partenum import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fmindex import find_contamination

    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"]).drop("removal_spans")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit_filters, text_failures

    return audit_filters(text_failures(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .drake import cluster_vectors

    return cluster_vectors(_table(spark, sf_dir, "embeddings"), keep=["vec_id"])


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_quality_rules,
        op3_html_extraction,
        op4_license_scans,
        op5_toxicity,
        op6_mixing,
        op7_pii,
        op8_url_filters,
        op9_ngram_jaccard_join,
        op10_benchmark_decontamination,
        op11_exact_dedup,
        op12_filter_interactions,
        op13_centroid_clustering,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
""",
    "op4_license_scans": licenses_sql(),
    "op6_mixing": mixing_sql,
    "op8_url_filters": urls_sql(),
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) AS x FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
same AS MATERIALIZED (SELECT r, min(r) OVER (PARTITION BY k) AS g FROM (SELECT r, md5(array_to_string(list_sort(list(x)), chr(10))) AS k FROM s GROUP BY r)),
f AS MATERIALIZED (SELECT s.r, x, n FROM s JOIN same ON s.r = same.r AND s.r = same.g JOIN n ON n.r = s.r),
p AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM f a JOIN f b ON a.x = b.x AND a.r < b.r AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT g, r FROM same UNION ALL SELECT r, g FROM same),
reach AS (SELECT r AS a, r AS b FROM same UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
least AS (SELECT reach.a AS r, min(doc_id) AS c FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN d.doc_id ELSE c END AS component_id FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN least ON least.r = d.r
""",
    "op11_exact_dedup": exact_sql,
    "op12_filter_interactions": audit_sql,
    "op13_centroid_clustering": clusters_sql(),
    "op10_benchmark_decontamination": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item, w, least(13, len(w)) AS size FROM i WHERE len(w) > 0),
win AS MATERIALIZED (SELECT DISTINCT item, size, array_to_string(w[pos : pos + size - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS pos FROM k)),
z AS (SELECT DISTINCT size FROM win),
o AS (SELECT r, size, pos, array_to_string(w[pos : pos + size - 1], ' ') AS x FROM (SELECT d.r, d.w, z.size, unnest(range(1, len(d.w) - z.size + 2)) AS pos FROM d, z WHERE len(d.w) >= z.size)),
hit AS MATERIALIZED (SELECT o.r, o.size, o.pos, win.item FROM o JOIN win ON o.size = win.size AND o.x = win.x),
words AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(pos, pos + size)) AS pos FROM (SELECT DISTINCT r, size, pos FROM hit)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN items ON items.r = d.r
""",
}
