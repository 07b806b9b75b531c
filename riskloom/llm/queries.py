"""The operators' queries over the given tables, and their SQL where SQL can say it.

Each query applies its operator to the whole table and derives the result's columns from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import (
    decontamination,
    exact_dedup,
    licenses,
    mixing,
    packing,
    periodic_runs,
    quality_gam,
    simhash,
    token_scan,
    url_rules,
    warc,
    weighted_sampling,
    zone_clustering,
)
from riskloom.llm.common import WORD, table


def op1_pareto_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.Mix(table(spark, sf, "documents"), weights=(5, 2, 1), share=1.5, max_copies=2.0).report()


def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return exact_dedup.exact_groups(table(spark, sf, "documents"), carry={"text_sha256": digest})


def op3_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf, "documents"), shingle=3, radius=2)
    return groups.select(
        F.col("_id").alias("doc_id"), simhash.fingerprint_hex(F.col("_fp")).alias("fingerprint"), "component_id"
    )


def op4_warc_segments(spark: SparkSession, sf: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf, "pages"), least_revisit=1000)
    pages = warc.read_pages(archives)
    revisit = F.col("record_type") == "revisit"
    size = F.when(revisit, F.col("stated")).otherwise(F.octet_length("payload").cast("long"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        size.alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op5_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = url_rules.judge(table(spark, sf, "pages"), table(spark, sf, "labels"))
    return verdicts.select("page_id", "host", "path", "rule", "verdict", "confidence")


def op6_weighted_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return weighted_sampling.fingerprints(table(spark, sf, "documents"), samples=128)


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_scan.token_counts(table(spark, sf, "documents"))


def op8_quality_gam(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality_gam.train(docs, table(spark, sf, "labels"))
    scored = docs.select("doc_id", quality_gam.score(model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        quality_gam.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op9_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), capacity=1024, end_id=2)


def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf, "documents"))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.size("found").cast("long").alias("notices"),
        F.array_join(F.transform("found.line", lambda x: x.cast("string")), ",").alias("lines"),
    )


def op11_zone_clustering(spark: SparkSession, sf: str) -> DataFrame:
    found = zone_clustering.cluster(table(spark, sf, "embeddings"), k=40, rounds=5, seed="2")
    each, total = zone_clustering.inertias(found)
    rows = [
        (i, each.get(i, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(found.centroids)
    ]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(facts), "cluster")  # 40 rows


def op12_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), size=10)
    n_hit = F.aggregate("passages", F.lit(0).cast("long"), lambda done, p: done + p["n_words"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def planted_periods(docs: DataFrame) -> DataFrame:
    """Every document; the text of about one in ten becomes periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0)).alias("w"))
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    a = F.when(n > 0, g % n)
    placed = words.withColumns({"a": a, "p": 1 + F.floor((n - a) / (3 + g % 8))})
    periodic = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_periods(table(spark, sf, "documents")), min_length=6, min_exponent=4)
    none = F.lit(None).cast(periodic_runs.RUN)
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", none, lambda done, r: F.when(done.isNull() | more(r, done), r).otherwise(done))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pareto_mix,
        op2_exact_dedup,
        op3_simhash_near_dedup,
        op4_warc_segments,
        op5_url_rules,
        op6_weighted_fingerprints,
        op7_token_counts,
        op8_quality_gam,
        op9_best_fit_packing,
        op10_license_scan,
        op11_zone_clustering,
        op12_decontamination,
        op13_periodic_runs,
    )
}

def clustering_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The rounds written out one after the other; centroids as rows (c, i, x)."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, e
  FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v ORDER BY h LIMIT {k}))"""
    ]
    distance = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.r, c.c, CAST({distance} AS BIGINT) AS d FROM v, c{n} c) GROUP BY r)"""
        )
        if n < rounds:
            steps.append(
                f"""m{n} AS MATERIALIZED (
  SELECT c, list(x ORDER BY i) AS e
  FROM (SELECT c, i, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x
        FROM (SELECT a{n}.c, unnest(range({dims})) AS i, unnest(v.e) AS x FROM a{n} JOIN v USING (r)) GROUP BY c, i) GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.e, c{n}.e) AS e FROM c{n} LEFT JOIN m{n} USING (c))"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)"""


ORACLE = {
    "op11_zone_clustering": clustering_sql(),
    "op12_decontamination": r"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS b FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT item, list_slice(w, b, b + 9) AS words FROM s),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
l AS (SELECT DISTINCT len(words) AS n FROM p),
x AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS b FROM d JOIN l ON len(w) >= n),
h AS (SELECT x.r, x.b, x.n, p.item FROM x JOIN d USING (r) JOIN p ON p.words = list_slice(d.w, x.b, x.b + x.n - 1)),
hit AS (SELECT r, count(DISTINCT b) AS n_hit FROM (SELECT r, unnest(range(b, b + n)) AS b FROM h) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""",
    "op1_pareto_mix": r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS t, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS m FROM documents),
r AS (
  SELECT *, CAST(length(bin(m)) AS DOUBLE) AS w,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM d),
s0 AS (SELECT source, sum(m)::BIGINT AS source_size FROM r GROUP BY source),
s1 AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS sw,
         2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, cap / sw AS level FROM s1),
s3 AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(sw) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS candidate
  FROM s2 WINDOW o AS (ORDER BY level, source NULLS FIRST)),
lv AS (SELECT (SELECT candidate FROM s3 WHERE candidate < level ORDER BY level, source NULLS FIRST LIMIT 1) AS c),
t AS (
  SELECT source, source_size, CASE WHEN c IS NULL OR level <= c THEN cap ELSE sw * c END AS target FROM s3, lv),
k0 AS (SELECT source, w, sum(m)::BIGINT AS m FROM r GROUP BY source, w),
k1 AS (
  SELECT k0.*, target, source_size,
         (target - 2.0::DOUBLE * coalesce(sum(k0.m) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / nullif(sum(k0.w * k0.m) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS k
  FROM k0 JOIN t ON k0.source IS NOT DISTINCT FROM t.source
  WINDOW o AS (PARTITION BY k0.source ORDER BY k0.w DESC)),
k2 AS (SELECT source, arg_max(k, w) FILTER (k * w <= 2.0) AS k FROM k1 GROUP BY source),
k3 AS (
  SELECT k1.source, any_value(source_size) AS source_size, any_value(target) AS target, any_value(k2.k) AS k,
         any_value(target) - sum(CAST(floor(coalesce(least(2.0::DOUBLE, k2.k * w), 2.0)) AS BIGINT) * m) AS rest
  FROM k1 JOIN k2 ON k1.source IS NOT DISTINCT FROM k2.source GROUP BY k1.source),
e0 AS (
  SELECT r.*, source_size, target, rest, coalesce(least(2.0::DOUBLE, k * w), 2.0::DOUBLE) AS e
  FROM r JOIN k3 ON r.source IS NOT DISTINCT FROM k3.source),
e1 AS (SELECT *, CASE WHEN e - floor(e) > 0 AND m > 0 THEN (u / (1.0 - u)) / ((e - floor(e)) / (1.0 - (e - floor(e)))) END AS q FROM e0),
e2 AS (
  SELECT *, row_number() OVER o AS place, CASE WHEN q IS NOT NULL THEN sum(m) OVER o END AS cum
  FROM e1 WINDOW o AS (PARTITION BY source, q IS NULL ORDER BY q, doc_id NULLS FIRST, m ROWS UNBOUNDED PRECEDING)),
g AS (SELECT source, any_value(rest) - coalesce(max(cum) FILTER (cum <= rest), 0) AS gap FROM e2 GROUP BY source),
f AS (
  SELECT e2.source, first(place ORDER BY abs(m - gap), place) AS fill
  FROM e2 JOIN g ON e2.source IS NOT DISTINCT FROM g.source WHERE cum > rest AND abs(m - gap) < gap GROUP BY e2.source),
c AS (
  SELECT e2.*, CASE WHEN m = 0 THEN 0 ELSE CAST(floor(e) AS BIGINT) + CASE WHEN q IS NOT NULL AND (cum <= rest OR
         place = fill) THEN 1 ELSE 0 END END AS copies
  FROM e2 LEFT JOIN f ON e2.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, m AS size, source_size, target, copies * m AS taken, copies FROM c""",
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
    "op4_warc_segments": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM g""",
}
