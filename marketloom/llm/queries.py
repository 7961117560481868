"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids, flac, language_id, lexical_search, mixing, near_dup, quality_model, quality_rules, secret_scan,
    sentencepiece_tokens, simhash, suffix_dedup, url_rules,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _held_out() -> F.Column:
    """A null id counts as an empty text, which is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return near_dup.near_duplicates(docs, shingle_words=4).select("doc_id", "n_shingles", "component_id", "kept")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = url_rules.judge_urls(pages, url_rules.base_rules(spark), default_rules=url_rules.ad_rules(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", _held_out())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    learn = labels.where(~_held_out())
    weights = quality_model.fit(docs.select("doc_id", "text"), learn)
    return quality_model.score(docs, weights).select("doc_id", "held_out", "score", "predicted")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.store_and_read(_documents(spark, sf_dir).select("doc_id", "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", _held_out())
    profiles = language_id.fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return language_id.identify(docs.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return suffix_dedup.repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return quality_rules.judge_quality(docs, carry=["doc_id"])


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan_secrets(_documents(spark, sf_dir).select("doc_id", "text"), carry=["doc_id"])
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.plan_mix(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    coded = sentencepiece_tokens.encode_tokens(docs, with_ids=False, most_words=600_000)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "round_trip")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return simhash.simhash_duplicates(docs, carry=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return centroids.centroid_clusters(vectors, carry=["vec_id"])


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return lexical_search.lexical_search(_documents(spark, sf_dir).select("doc_id", "text"), items)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_minhash_near_dedup, op2_url_filters, op3_quality_classifier, op4_media_columns, op5_language_id,
        op6_suffix_array_dedup, op7_quality_rules, op8_secret_scans, op9_source_mix, op10_sentencepiece,
        op11_simhash_near_dedup, op12_centroid_clusters, op13_lexical_search,
    )
}

_OP2 = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(verdict, host, path) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), best AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, r.host || r.path) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE
  WHEN regexp_matches(host || path, '(?s)^([^/]*\.)?(ads-track|adserver|doubleclick)\.')
    OR contains(host || path, '/adframe.') OR contains(host || path, '/banner/ads/') THEN 'block'
  ELSE 'allow' END) AS verdict
FROM best WHERE k = 1
"""

_OP9 = r"""
WITH d AS (
  SELECT doc_id, source, sha256(coalesce(doc_id::VARCHAR, '')) AS hex,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0))::BIGINT AS rest_size,
    (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::BIGINT AS rest_weight
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, rest_size * weight > 3 * source_size * rest_weight AS capped FROM o
), l AS (
  SELECT rest_size, rest_weight FROM c WHERE NOT capped ORDER BY source_size / weight, rest_size, rest_weight LIMIT 1
), t AS (
  SELECT c.source, c.source_size,
    CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (weight * l.rest_size) / l.rest_weight END AS target
  FROM c LEFT JOIN l ON true
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
), e AS (
  SELECT *, floor(rate)::BIGINT AS whole, printf('%08x', floor((rate - floor(rate)) * 4294967296.0)::BIGINT) AS edge FROM r
), x AS (
  SELECT d.source, k, abs(sum(d.size * (e.whole + CASE WHEN substr(d.hex, k, 8) < e.edge THEN 1 ELSE 0 END)) - any_value(e.target)) AS miss
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source, range(1, 58) AS g(k) GROUP BY d.source, k
), b AS (
  SELECT source, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss, k) AS i FROM x) WHERE i = 1
)
SELECT d.doc_id, d.size, e.source_size, e.target,
  d.size * (e.whole + CASE WHEN substr(d.hex, b.k::INT, 8) < e.edge THEN 1 ELSE 0 END) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""

def _op12(rounds: int = 5) -> str:
    """Every distance of every round."""
    parts = [r"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), x) AS i, * FROM (
    SELECT vec_id, [floor(256 * e::DOUBLE)::BIGINT for e in embedding] AS x FROM embeddings
    WHERE len(embedding) = 64 AND len([e for e in embedding if isfinite(e)]) = 64)
), c0 AS MATERIALIZED (SELECT i - 1 AS j, x AS c FROM v WHERE i <= 40)"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT i, j, d FROM (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM (
      SELECT i, j, list_sum([(x[p] - c[p]) * (x[p] - c[p]) for p in range(1, 65)])::BIGINT AS d FROM v, c{r})) WHERE k = 1
)""")
        if r < rounds:
            parts.append(f"""m{r} AS MATERIALIZED (
  SELECT j, list(floor_div ORDER BY p) AS c FROM (
    SELECT j, p, ((sum(y) - (sum(y) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS floor_div
    FROM (SELECT j, unnest(x) AS y, generate_subscripts(x, 1) AS p FROM a{r} JOIN v USING (i)) GROUP BY j, p) GROUP BY j
), c{r + 1} AS MATERIALIZED (
  SELECT j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j)
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (i) JOIN c{rounds} USING (j)
"""


_OP13 = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS i, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), q AS (
  SELECT item_id, row_number() OVER () AS iq, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), q2 AS (
  SELECT item_id, iq, term, count(*) AS qn FROM q GROUP BY ALL
), g AS (
  SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM t WHERE len(terms) > 0
), f AS (
  SELECT i, term, count(*) AS tf FROM (SELECT i, unnest(terms) AS term FROM t) WHERE term IN (SELECT term FROM q2) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term
), s AS (
  SELECT item_id, iq, i, sum(qn * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(terms) * n_docs) // n_terms))))::BIGINT AS score
  FROM q2 JOIN w USING (term) JOIN f USING (term) JOIN t USING (i), g GROUP BY ALL
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY iq ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM s JOIN t USING (i) WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": _OP2, "op9_source_mix": _OP9, "op12_centroid_clusters": _op12(), "op13_lexical_search": _OP13,
}
