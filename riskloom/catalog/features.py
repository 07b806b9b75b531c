"""Queries on schema, quality, splits, lookups, aggregates and feature transforms."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.catalog.inputs import PREDS_SQL, RISK_SQL, predictions, risk_frame
from riskloom.catalog.registry import query, rounded, table
from riskloom.functions import fixed_values as fv
from riskloom.operators import binning, currency, encode, impute, metrics, quality, risk, split
from riskloom.operators.curves import auc_roc
from riskloom.operators.model import eval_feature_frame, fit_features
from riskloom.operators.codebook import CodeBook
from riskloom.plans import quantiles
from riskloom.plans.lookup import (
    attach_results,
    decode_codes,
    local_table,
    lookup_with_default,
    merge_new_columns,
    resume_pending,
)
from riskloom.plans.quantiles import exact_quantiles
from riskloom.plans.staging import new_stage_path, stage


def sql_list(rows) -> str:
    def lit(x):
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


# ---- the flagship: smoothed risk -> mapped score -> AUC

RISK_FIT_SQL = """
known AS (SELECT {key} AS key, y FROM risk WHERE y <> -1 AND {key} IS NOT NULL),
overall AS (SELECT avg(CAST(y AS DOUBLE)) AS d, floor(count(*) * {smooth}::DOUBLE) AS s FROM known),
bins AS (
  SELECT key, n, n1 * 1.0::DOUBLE / (n1 + n0) AS r FROM (
    SELECT key, count(*) AS n, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0
    FROM known GROUP BY key)),
fitted AS (
  SELECT key, n, r, CASE WHEN n >= {threshold} THEN (n * r + s * d) / (n + s) ELSE d END AS value
  FROM bins, overall)"""


def fit_sql(key: str, smooth: float = 0.01, threshold: int = 5) -> str:
    return RISK_FIT_SQL.format(key=key, smooth=smooth, threshold=threshold)


@query(
    "risk_score_auc",
    f"""WITH {RISK_SQL}, {fit_sql("supp")},
    scored AS (SELECT coalesce(f.value, g.d) AS score, CASE WHEN y = 1 THEN 1 ELSE 0 END AS y
               FROM risk LEFT JOIN fitted f ON f.key = risk.supp CROSS JOIN overall g),
    h AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY score),
    c AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM h)
    SELECT round(sum(pos * (below + neg * 0.5::DOUBLE)) / (max(p) * max(n)::DOUBLE), 6) AS auc,
           CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg FROM c""",
)
def risk_score_auc(spark, sf):
    df = risk_frame(spark, sf)
    tables = risk.risk_table_fit(df, ["supp"], "y", 0.01, 5).staged()
    scored = risk.risk_map_apply(df, tables, ["supp"]).select(
        F.col("supp").alias("score"), F.when(F.col("y") == 1, 1).otherwise(0).alias("y")
    )
    return rounded(auc_roc(scored, "score", "y"), "auc")


# ---- schema and quality


@query(
    "label_clean",
    """WITH codes AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
                     FROM (SELECT DISTINCT nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders)
                     WHERE o_orderpriority IS NOT NULL)
    SELECT o_orderkey, CAST(code AS BIGINT) AS label FROM orders JOIN codes ON o_orderpriority = v""",
)
def label_clean(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("label")
    )
    return quality.label_clean(orders, "label")


ROLE_INPUT_SQL = """
src AS (SELECT event_id, nullif(event_type, 'error') AS kind, CAST(nullif(user_id, 8) AS VARCHAR) AS label,
               CASE WHEN event_type = 'view' THEN 'n/a' ELSE CAST(CAST(value * 100 AS BIGINT) AS VARCHAR) END AS amount
        FROM events)"""


def role_input(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.nullif("event_type", F.lit("error")).alias("kind"),
        F.nullif("user_id", F.lit(8)).cast("string").alias("label"),
        F.when(F.col("event_type") == "view", "n/a")
        .otherwise(F.round(F.col("value") * 100).cast("long").cast("string"))
        .alias("amount"),
    )


ROLES = quality.RoleSpec(label="label", id="event_id", categorical=("kind",), numeric=("amount",))


@query(
    "role_typed_coerce",
    f"""WITH {ROLE_INPUT_SQL}
    SELECT CAST(event_id AS DOUBLE) AS event_id, coalesce(kind, 'None') AS kind,
           coalesce(TRY_CAST(label AS DOUBLE), -1.0) AS label, coalesce(TRY_CAST(amount AS DOUBLE), -1.0) AS amount
    FROM src""",
)
def role_typed_coerce(spark, sf):
    return quality.role_typed_coerce(role_input(spark, sf), ROLES)


@query(
    "fill_missing_by_role",
    f"""WITH {ROLE_INPUT_SQL}
    SELECT CAST(event_id AS DOUBLE) AS event_id, coalesce(kind, 'None') AS kind,
           CAST(coalesce(TRY_CAST(label AS DOUBLE), 0.0) AS INTEGER) AS label,
           coalesce(TRY_CAST(amount AS DOUBLE), -1.0) AS amount
    FROM src""",
)
def fill_missing_by_role(spark, sf):
    return quality.fill_missing_by_role(role_input(spark, sf), ROLES)


@query(
    "safe_numeric",
    f"""WITH {ROLE_INPUT_SQL}
    SELECT event_id, coalesce(TRY_CAST(amount AS DOUBLE), 0.0) AS amount, coalesce(TRY_CAST(kind AS DOUBLE), 0.0) AS kind
    FROM src""",
)
def safe_numeric(spark, sf):
    return quality.safe_numeric(role_input(spark, sf).select("event_id", "amount", "kind"), ["amount", "kind"])


@query(
    "eval_feature_frame",
    f"""WITH {RISK_SQL}, {fit_sql("supp")}, med AS (SELECT median(l_tax) AS t FROM risk)
    SELECT l_orderkey, y, l_quantity, round(coalesce(l_tax, t), 6) AS l_tax, round(coalesce(f.value, g.d), 6) AS supp
    FROM risk LEFT JOIN fitted f ON f.key = risk.supp CROSS JOIN overall g CROSS JOIN med""",
)
def eval_features(spark, sf):
    df = risk_frame(spark, sf)
    state = fit_features(df, "y", ["supp"], ["l_quantity", "l_tax"], 0.01, 5)
    return rounded(eval_feature_frame(df, state, ["l_orderkey", "y"]), "supp", "l_tax")


@query(
    "feature_quality",
    f"""WITH {RISK_SQL}, f AS (
      UNPIVOT (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, 1 / nullif(l_tax, 0.01) AS inv_tax,
                      CASE WHEN l_discount = 0.05 THEN 'NaN'::DOUBLE WHEN l_discount = 0.06 THEN 'Infinity'::DOUBLE
                           ELSE l_discount END AS disc FROM risk)
      ON l_quantity, inv_tax, disc INTO NAME feature VALUE v),
    t AS (SELECT count(*) AS n FROM risk)
    SELECT feature, max(t.n) - count(*) AS nulls, count(*) FILTER (isnan(v)) AS nans,
           count(*) FILTER (isinf(v)) AS infs,
           CASE WHEN max(t.n) = count(*) FILTER (isfinite(v)) THEN 1 ELSE 0 END AS ok
    FROM f, t GROUP BY feature""",
)
def feature_quality(spark, sf):
    d = F.col("l_discount")
    df = risk_frame(spark, sf).select(
        "l_quantity",
        (1 / F.nullif("l_tax", F.lit(0.01))).alias("inv_tax"),
        F.when(d == 0.05, float("nan")).when(d == 0.06, float("inf")).otherwise(d).alias("disc"),
    )
    return quality.feature_quality(df, ["l_quantity", "inv_tax", "disc"])


@query(
    "validate_cases",
    """SELECT doc_id, text AS dialogue, coalesce(nullif(source, 'src1'), '') AS shiptrack,
              nullif(nullif(lang, 'en'), '') AS max_estimated_arrival_date FROM documents""",
)
def validate_cases(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.col("text").alias("dialogue"),
        F.nullif("source", F.lit("src1")).alias("shiptrack"),
        F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("max_estimated_arrival_date"),
    )
    return quality.validate_cases(docs)


CODES_SQL = "[" + ", ".join(f"'{c}'" for c in fv.REASON_CODES) + "]"
CHECK_INPUT_SQL = f"""
src AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'No_BSM' ELSE {CODES_SQL}[user_id % 12 + 1] END AS category,
               value / 25.0 AS confidence_score FROM events)"""


def coded_events(spark, sf):
    codes = F.array(*[F.lit(c) for c in fv.REASON_CODES])
    return table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "No_BSM")
        .otherwise(F.element_at(codes, (F.col("user_id") % 12 + 1).cast("int")))
        .alias("category"),
        (F.col("value") / 25.0).alias("confidence_score"),
    )


@query(
    "enum_and_range_check",
    f"""WITH {CHECK_INPUT_SQL}, r AS (
      SELECT *, CASE WHEN NOT list_contains({CODES_SQL}, category) THEN 'category'
                     WHEN confidence_score < 0 OR confidence_score > 1 THEN 'confidence_score' END AS reject_reason FROM src)
    SELECT reject_reason, CAST(reject_reason IS NULL AS INTEGER) AS valid, category, count(*) AS n,
           count(DISTINCT round(confidence_score, 1)) AS scores
    FROM r GROUP BY ALL""",
)
def enum_and_range_check(spark, sf):
    checked = quality.enum_and_range_check(
        coded_events(spark, sf).withColumn("c1", F.round("confidence_score", 1)),
        "category", "confidence_score", list(fv.REASON_CODES),
    )
    pairs = checked.groupBy("reject_reason", "valid", "category", "c1").agg(F.count(F.lit(1)).alias("c"))
    return pairs.groupBy("reject_reason", "valid", "category").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("scores")
    )


CONST_SQL = """
src AS (SELECT p_partkey, p_size, p_type, 'x' AS fixed, CAST(NULL AS VARCHAR) AS empty FROM part)"""


def constant_input(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", "p_size", "p_type", F.lit("x").alias("fixed"), F.lit(None).cast("string").alias("empty")
    )


@query("drop_constant_columns", f"WITH {CONST_SQL} SELECT p_partkey, p_size, p_type, empty FROM src")
def drop_constant_columns(spark, sf):
    return quality.drop_constant_columns(constant_input(spark, sf))


@query("drop_all_null_columns", f"WITH {CONST_SQL} SELECT p_partkey, p_size, p_type, fixed FROM src")
def drop_all_null_columns(spark, sf):
    return quality.drop_all_null_columns(constant_input(spark, sf))


@query(
    "dedup_keep_first",
    """SELECT doc_id, md5(text) AS h, source FROM (
         SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def dedup_keep_first(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"), "source")
    return quality.dedup_keep_first(docs, "h", ["doc_id"])


@query(
    "oot_split",
    """WITH s AS (SELECT *, CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'oot'
                    WHEN o_orderstatus = 'F' THEN 'bad' ELSE 'good' END AS part FROM orders)
    SELECT part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, min(CAST(o_orderdate AS DATE)) AS first_day,
           max(CAST(o_orderdate AS DATE)) AS last_day FROM s GROUP BY part""",
)
def oot_split(spark, sf):
    orders = table(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    parts = quality.oot_split(orders, "o_orderdate", "y", "2000-01-01")
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("o_orderkey").alias("keys"),
        F.min(F.to_date("o_orderdate")).alias("first_day"),
        F.max(F.to_date("o_orderdate")).alias("last_day"),
    )


@query(
    "date_range",
    """SELECT CAST(min(o_orderdate) AS DATE) AS first_ts, CAST(max(o_orderdate) AS DATE) AS last_ts FROM orders""",
)
def date_range(spark, sf):
    out = quality.date_range(table(spark, sf, "orders"), "o_orderdate")
    return out.select(F.to_date("first_ts").alias("first_ts"), F.to_date("last_ts").alias("last_ts"))


@query(
    "categorical_eligibility",
    """WITH d AS (SELECT 'p_brand' AS column_name, count(DISTINCT p_brand) AS n_distinct, 1 AS txt FROM part
      UNION ALL SELECT 'p_name', count(DISTINCT p_name), 1 FROM part
      UNION ALL SELECT 'p_size', count(DISTINCT p_size), 0 FROM part
      UNION ALL SELECT 'p_partkey', count(DISTINCT p_partkey), 0 FROM part)
    SELECT column_name, n_distinct, CASE WHEN txt = 1 OR n_distinct < 100 THEN 1 ELSE 0 END AS eligible FROM d""",
)
def categorical_eligibility(spark, sf):
    return quality.categorical_eligibility(table(spark, sf, "part"), ["p_brand", "p_name", "p_size", "p_partkey"])


@query(
    "capped_eligibility",
    """SELECT 'p_brand' AS column_name, 1 AS eligible UNION ALL SELECT 'p_name', 1
      UNION ALL SELECT 'p_size', CASE WHEN (SELECT count(DISTINCT p_size) FROM part) < 100 THEN 1 ELSE 0 END
      UNION ALL SELECT 'p_partkey', CASE WHEN (SELECT count(DISTINCT p_partkey) FROM part) < 100 THEN 1 ELSE 0 END""",
)
def capped_eligibility(spark, sf):
    return quality.capped_eligibility(table(spark, sf, "part"), ["p_brand", "p_name", "p_size", "p_partkey"])


@query(
    "distinct_per_column",
    """SELECT 'l_suppkey' AS column_name, count(DISTINCT l_suppkey) AS n_distinct FROM lineitem
      UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem
      UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem
      UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem""",
)
def distinct_per_column(spark, sf):
    return quality.distinct_per_column(
        table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey", "l_returnflag", "l_quantity"]
    )


# ---- splits

SPLIT_SQL = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rn,
         count(*) OVER (PARTITION BY o_orderstatus) AS n FROM {src}),
cut AS (SELECT *, floor(n * 0.7::DOUBLE) AS a FROM ranked),
parts AS (
  SELECT *, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + floor((n - a) * 0.5::DOUBLE) THEN 'test' ELSE 'val' END AS split
  FROM cut)"""


@query("stratified_split", f"WITH {SPLIT_SQL.format(src='orders')} SELECT o_orderkey, o_orderstatus, split FROM parts")
def stratified_split(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_split(orders, "o_orderstatus", "o_orderkey")


@query(
    "random_split",
    """SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5('42:' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.3
              THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def random_split(spark, sf):
    return split.random_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.3)


@query(
    "downsample_negatives",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rn FROM o)
    SELECT o_orderkey, y FROM r WHERE y = 1 OR rn <= 1000""",
)
def downsample_negatives(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return split.downsample_negatives(orders, "y", "o_orderkey", 1000)


# ---- lookups and joins

RATES = [("USD", 1.0), ("CAD", 1.35), ("MXN", 17.1), ("BRL", 4.97), ("EUR", 0.92), ("GBP", 0.79), ("JPY", 149.5)]
MARKETS = [(i, RATES[i % 7][0] if i % 7 < 6 else "XXX") for i in range(20)]
CURRENCY_SQL = f"""
markets(key, code) AS (VALUES {sql_list(MARKETS)}),
rates(code, rate) AS (VALUES {sql_list(RATES)}),
src AS (SELECT o_orderkey, o_orderstatus, nullif(c_nationkey, 3) AS market, nullif(o_orderpriority, '5-LOW') AS prio, o_totalprice
        FROM orders JOIN customer ON o_custkey = c_custkey),
coded AS (SELECT o_orderkey, o_orderstatus, market, o_totalprice, coalesce(code, 'USD') AS currency_code
          FROM src LEFT JOIN markets ON market = key WHERE market IS NOT NULL),
converted AS (SELECT o_orderkey, o_orderstatus, market, currency_code,
                     round(o_totalprice / coalesce(CAST(rate AS DOUBLE), 1.0::DOUBLE), 4) AS o_totalprice
              FROM coded LEFT JOIN rates ON currency_code = rates.code)"""


def currency_input(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return orders.select("o_orderkey", "o_orderstatus", F.nullif("c_nationkey", F.lit(3)).alias("market"), "o_totalprice")


def convert(spark, df):
    markets = local_table(spark, MARKETS, "key long, currency_code string")
    rates = local_table(spark, RATES, "key string, rate double")
    return rounded(currency.currency_convert(df, "market", ["o_totalprice"], markets, rates), "o_totalprice", places=4)


@query("currency_convert", f"WITH {CURRENCY_SQL} SELECT * FROM converted")
def currency_convert(spark, sf):
    return convert(spark, currency_input(spark, sf))


@query(
    "resplit_after_transform",
    f"""WITH {CURRENCY_SQL}, {SPLIT_SQL.format(src='converted')}
    SELECT o_orderkey, o_orderstatus, market, currency_code, o_totalprice, split FROM parts""",
)
def resplit_after_transform(spark, sf):
    first = split.stratified_split(currency_input(spark, sf), "o_orderstatus", "o_orderkey", seed=7)
    return split.resplit_after_transform(first, lambda d: convert(spark, d), "o_orderstatus", "o_orderkey")


@query(
    "lookup_with_default",
    """SELECT l_orderkey, l_linenumber, coalesce(s_name, 'none') AS supplier
    FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON l_suppkey = s_suppkey""",
)
def lookup(spark, sf):
    suppliers = table(spark, sf, "supplier").filter("s_acctbal > 5000")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    out = lookup_with_default(
        items, suppliers, F.col("l_suppkey"), "s_name", F.lit("none"), "supplier", table_key="s_suppkey"
    )
    return out.drop("l_suppkey")


@query(
    "attach_results_by_index",
    """SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def attach_results_by_index(spark, sf):
    return attach_results(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


@query(
    "merge_new_columns",
    """SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def merge_new(spark, sf):
    right = table(spark, sf, "labels").withColumn("lang", F.lit("not taken"))
    return merge_new_columns(table(spark, sf, "documents").select("doc_id", "lang"), right, "doc_id")


@query(
    "resume_pending",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def pending(spark, sf):
    return resume_pending(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


TOPIC_ROWS = list(fv.TOPICS.items())
ENTRY_ROWS = list(fv.ENTRY_POINTS.items())


@query(
    "decode_codes",
    f"""WITH topics(code, name) AS (VALUES {sql_list(TOPIC_ROWS)}), points(code, name) AS (VALUES {sql_list(ENTRY_ROWS)})
    SELECT event_id, coalesce(t.name, 'MISSING') AS topic, coalesce(p.name, 'MISSING') AS entry_point
    FROM events LEFT JOIN topics t ON t.code = user_id LEFT JOIN points p ON p.code = CAST(floor(value) AS BIGINT)""",
)
def decode(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("t"), F.floor("value").alias("p")
    )
    topics = local_table(spark, TOPIC_ROWS, "code long, name string")
    points = local_table(spark, ENTRY_ROWS, "code long, name string")
    return decode_codes(decode_codes(events, topics, "t", "topic"), points, "p", "entry_point").drop("t", "p")


# ---- aggregates


@query(
    "label_crosstab",
    f"""WITH {RISK_SQL}
    SELECT coalesce(line, '_count_') AS category, count(*) FILTER (y = 0) AS label_0, count(*) FILTER (y = 1) AS label_1,
           count(*) AS n_all FROM risk WHERE line IS NOT NULL GROUP BY ROLLUP (line)""",
)
def label_crosstab(spark, sf):
    return risk.label_crosstab(risk_frame(spark, sf), "line", "y")


@query(
    "risk_table_fit",
    f"""WITH {RISK_SQL}, {fit_sql("part")}
    SELECT key, n, round(r, 6) AS risk, round(value, 6) AS value, round(d, 6) AS default_value FROM fitted, overall""",
)
def risk_table_fit(spark, sf):
    tables = risk.risk_table_fit(risk_frame(spark, sf), ["part"], "y", 0.01, 5)
    out = tables.bins.withColumn("default_value", tables.default_of("part")).drop("var")
    return rounded(out, "risk", "value", "default_value")


SCRIPT_SQL = """
known AS (SELECT {key} AS key, y FROM risk WHERE y <> -1),
overall AS (SELECT avg(CAST(y AS DOUBLE)) AS d, floor(count(*) * 0.01::DOUBLE) AS s FROM known),
bins AS (SELECT key, count(*) AS n, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM known
         WHERE key IS NOT NULL GROUP BY key)
SELECT key, n, round(CASE WHEN n >= 5 THEN (n * (n1 * 1.0::DOUBLE / (n1 + n0)) + s * d) / (n + s) ELSE d END, 6) AS value,
       round(d, 6) AS default_value FROM bins, overall"""


@query("risk_table_fit_script", f"WITH {RISK_SQL}, {SCRIPT_SQL.format(key='line')}")
def risk_table_fit_script(spark, sf):
    tables = risk.risk_table_fit_script(risk_frame(spark, sf), ["line"], "y")
    out = tables.bins.withColumn("default_value", tables.default_of("line")).drop("var")
    return rounded(out, "value", "default_value")


MULTI_FIT_SQL = """
long AS (SELECT 'supp' AS var, supp AS key, y FROM risk UNION ALL SELECT 'line', line, y FROM risk
         UNION ALL SELECT 'status', status, y FROM risk),
known AS (SELECT * FROM long WHERE y <> -1 AND key IS NOT NULL),
overall AS (SELECT var, avg(CAST(y AS DOUBLE)) AS d, floor(count(*) * 0.01::DOUBLE) AS s FROM known GROUP BY var),
bins AS (SELECT var, key, count(*) AS n, avg(CAST(y AS DOUBLE)) AS r FROM known GROUP BY var, key),
fitted AS (SELECT var, key, CASE WHEN n >= 5 THEN (n * r + s * d) / (n + s) ELSE d END AS value FROM bins JOIN overall USING (var))"""


@query("risk_tables_multi", f"WITH {RISK_SQL}, {MULTI_FIT_SQL} SELECT var, key, round(value, 6) AS value FROM fitted")
def risk_tables_multi(spark, sf):
    tables = risk.risk_table_fit(risk_frame(spark, sf), ["supp", "line", "status"], "y", 0.01, 5)
    return rounded(tables.bins.select("var", "key", "value"), "value")


@query(
    "risk_map_apply",
    f"""WITH {RISK_SQL}, {MULTI_FIT_SQL}
    SELECT l_orderkey, l_linenumber, round(coalesce(a.value, ga.d), 6) AS supp, round(coalesce(b.value, gb.d), 6) AS line,
           round(coalesce(c.value, gc.d), 6) AS status
    FROM risk LEFT JOIN fitted a ON a.var = 'supp' AND a.key = supp LEFT JOIN fitted b ON b.var = 'line' AND b.key = line
    LEFT JOIN fitted c ON c.var = 'status' AND c.key = status
    JOIN overall ga ON ga.var = 'supp' JOIN overall gb ON gb.var = 'line' JOIN overall gc ON gc.var = 'status'""",
)
def risk_map_apply(spark, sf):
    df = risk_frame(spark, sf)
    names = ["supp", "line", "status"]
    tables = risk.risk_table_fit(df, names, "y", 0.01, 5).staged()
    mapped = risk.risk_map_apply(df.select("l_orderkey", "l_linenumber", *names), tables, names)
    return rounded(mapped, *names)


def ratio_sql(tag: str, positive: int) -> str:
    return f"""WITH {RISK_SQL}, overall AS (SELECT count(*) FILTER ({tag} = {positive}) / count({tag})::DOUBLE AS p FROM risk),
    t AS (SELECT part AS key, {tag} AS t, count(*) AS c FROM risk GROUP BY 1, 2),
    k AS (SELECT key, sum(c) AS n, coalesce(sum(c) FILTER (t = {positive}), 0) AS np, count(*) AS d, arg_min(c, t) AS lo
          FROM t GROUP BY key)
    SELECT key, CAST(np AS BIGINT) AS n_positive, round(CASE WHEN n < 5 THEN 0.001 WHEN np = 0 THEN p
        WHEN d = 2 THEN (np + 10 * p) / (n + 10) WHEN d > 2 THEN (np + 10 * p) / (n - lo + 10)
        ELSE np * 10.0::DOUBLE / n END, 6) AS risk FROM k, overall"""


@query("category_risk_ratio", ratio_sql("y", 1))
def category_risk_ratio(spark, sf):
    return rounded(risk.category_risk_ratio(risk_frame(spark, sf), "part", "y"), "risk")


@query(
    "impute_fit",
    f"""WITH {RISK_SQL}, m AS (SELECT l_discount AS v, count(*) AS n FROM risk WHERE l_discount IS NOT NULL GROUP BY 1)
    SELECT 'l_tax' AS var, round(avg(l_tax), 6) AS value FROM risk
    UNION ALL SELECT 'l_extendedprice', round(median(l_extendedprice), 6) FROM risk
    UNION ALL SELECT 'l_discount', (SELECT v FROM m ORDER BY n DESC, v LIMIT 1)
    UNION ALL SELECT 'l_quantity', 7.0""",
)
def impute_fit(spark, sf):
    strategies = {"l_tax": "mean", "l_extendedprice": "median", "l_discount": "mode", "l_quantity": "mean"}
    return rounded(impute.impute_fit(risk_frame(spark, sf), strategies, {"l_quantity": 7.0}), "value")


@query(
    "impute_apply",
    f"""WITH {RISK_SQL}, m AS (SELECT avg(l_tax) AS t, median(l_discount) AS d FROM risk)
    SELECT l_orderkey, l_linenumber, round(coalesce(l_tax, t), 6) AS l_tax, round(coalesce(l_discount, d), 6) AS l_discount
    FROM risk, m""",
)
def impute_apply(spark, sf):
    df = risk_frame(spark, sf).select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    fitted = stage(impute.impute_fit(df, {"l_tax": "mean", "l_discount": "median"}))
    return rounded(impute.impute_apply(df, fitted, ["l_tax", "l_discount"]), "l_tax", "l_discount")


@query(
    "quantile_edges",
    """WITH q AS (SELECT 'l_quantity' AS var, unnest(quantile_cont(l_quantity, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS e FROM lineitem
      UNION ALL SELECT 'l_extendedprice', unnest(quantile_cont(l_extendedprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) FROM lineitem
      UNION ALL SELECT 'l_tax', unnest(quantile_cont(l_tax, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) FROM lineitem),
    d AS (SELECT DISTINCT var, round(e, 6) AS edge FROM q)
    SELECT var, CAST(row_number() OVER (PARTITION BY var ORDER BY edge) - 1 AS INTEGER) AS pos, edge,
           CAST(count(*) OVER (PARTITION BY var) - 1 AS INTEGER) AS n_bins FROM d""",
)
def quantile_edges(spark, sf):
    fitted = binning.quantile_edges(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], 10)
    rows = fitted.select("var", F.posexplode("edges").alias("pos", "edge"), "n_bins")
    return rounded(rows, "edge")


@query(
    "approximate_quantile_edges",
    """SELECT var, 10 AS n_bins, lo, hi, 1 AS near FROM (
      SELECT 'l_extendedprice' AS var, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem
      UNION ALL SELECT 'l_orderkey', min(l_orderkey)::DOUBLE, max(l_orderkey)::DOUBLE FROM lineitem)""",
)
def approximate_quantile_edges(spark, sf):
    """Edges of the sketches, and whether the rank of each is within half a per cent of the wanted one."""
    items = table(spark, sf, "lineitem")
    columns = ["l_extendedprice", "l_orderkey"]
    fitted = stage(binning.approximate_quantile_edges(items, columns, 10), "edges")
    long = quantiles.numeric_long(items, columns).join(fitted, "var")
    shares = [(F.avg((F.col("v") < F.col("edges")[i]).cast("double")), F.avg((F.col("v") <= F.col("edges")[i]).cast("double"))) for i in range(11)]
    near = [(below <= i / 10 + 0.005) & (upto >= i / 10 - 0.005) for i, (below, upto) in enumerate(shares)]
    return long.groupBy("var", "n_bins", "lo", "hi").agg(F.least(*[n.cast("int") for n in near]).alias("near"))


@query(
    "equal_width_edges",
    """WITH m AS (SELECT 'l_quantity' AS var, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem
      UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem)
    SELECT var, CAST(i AS INTEGER) AS pos, round(CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + (hi - lo) / 5 * i END, 6) AS edge
    FROM m, range(6) t(i)""",
)
def equal_width_edges(spark, sf):
    fitted = binning.equal_width_edges(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], 5)
    return rounded(fitted.select("var", F.posexplode("edges").alias("pos", "edge")), "edge")


@query(
    "bin_apply",
    f"""WITH {RISK_SQL},
    e AS (SELECT quantile_cont(l_extendedprice, [0, .25, .5, .75, 1]) AS q, min(l_tax) AS lo, max(l_tax) AS hi FROM risk),
    b AS (SELECT *, len(list_filter(q, lambda x: x < l_extendedprice)) AS k, lo + (hi - lo) / 3 AS t1, lo + (hi - lo) / 3 * 2 AS t2
          FROM risk, e)
    SELECT l_orderkey, l_linenumber, 'Bin_' || greatest(k - 1, 0) AS price_bin,
           CASE WHEN l_tax IS NULL THEN 'none' WHEN l_tax <= t1 THEN 'low' WHEN l_tax <= t2 THEN 'mid' ELSE 'high' END AS tax_bin
    FROM b""",
)
def bin_apply(spark, sf):
    df = risk_frame(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")
    price = stage(binning.quantile_edges(df, ["l_extendedprice"], 4))
    tax = stage(binning.equal_width_edges(df, ["l_tax"], 3))
    out = binning.bin_apply(df, price, "l_extendedprice", "price_bin")
    out = binning.bin_apply(out, tax, "l_tax", "tax_bin", labels=["low", "mid", "high"], missing="none")
    return out.drop("l_extendedprice", "l_tax")


@query(
    "value_counts",
    "SELECT l_suppkey AS value, count(*) AS n FROM lineitem GROUP BY 1",
)
def value_counts(spark, sf):
    return metrics.value_counts(table(spark, sf, "lineitem"), "l_suppkey")


@query(
    "class_distribution",
    "SELECT l_returnflag AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS ratio FROM lineitem GROUP BY 1",
)
def class_distribution(spark, sf):
    return rounded(metrics.class_distribution(table(spark, sf, "lineitem"), "l_returnflag"), "ratio")


@query(
    "array_stats",
    f"""WITH {PREDS_SQL} SELECT round(min(score), 6) AS min_value, round(max(score), 6) AS max_value,
      round(avg(score), 6) AS mean_value, round(stddev_pop(score), 6) AS std_value, 0::BIGINT AS n_nan, 0::BIGINT AS n_inf FROM preds""",
)
def array_stats(spark, sf):
    out = metrics.array_stats(predictions(spark, sf), "score")
    return rounded(out, "min_value", "max_value", "mean_value", "std_value")


@query(
    "vocabulary",
    """SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS code FROM (
        SELECT p_type AS key FROM part UNION SELECT o_orderpriority FROM orders UNION SELECT c_name FROM customer)""",
)
def vocabulary(spark, sf):
    frames = [
        table(spark, sf, "part").select(F.col("p_type").alias("v")),
        table(spark, sf, "orders").select(F.col("o_orderpriority").alias("v")),
        table(spark, sf, "customer").select(F.col("c_name").alias("v")),
    ]
    return encode.vocabulary(frames, "v")


# ---- encoders


@query(
    "label_encode_sorted",
    """WITH c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_brand AS v FROM part))
    SELECT p_partkey, p_brand, CAST(code AS BIGINT) AS code FROM part JOIN c ON v = p_brand""",
)
def label_encode_sorted(spark, sf):
    return encode.label_encode_sorted(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "code")


@query(
    "label_encode_first_seen",
    """WITH c AS (SELECT p_brand AS v, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY 1)
    SELECT p_partkey, p_brand, CAST(code AS BIGINT) AS code FROM part JOIN c ON v = p_brand""",
)
def label_encode_first_seen(spark, sf):
    return encode.label_encode_first_seen(
        table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", "code"
    )


@query(
    "growing_codes",
    """SELECT user_id AS k, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM (
      SELECT event_id, event_type || user_id % 50 AS user_id FROM events) GROUP BY 1""",
)
def growing_codes(spark, sf):
    """Three batches arrive one after the other, the last twice; codes as of one run over all rows."""
    events = table(spark, sf, "events").select("event_id", F.concat("event_type", F.col("user_id") % 50).alias("k"))
    book = CodeBook(spark, new_stage_path(spark, "codes"))
    cuts = [r[0] for r in exact_quantiles(events, ["event_id"], [1 / 3, 2 / 3]).orderBy("prob").select("value").collect()]
    part = F.when(F.col("event_id") <= cuts[0], 0).when(F.col("event_id") <= cuts[1], 1).otherwise(2)
    for batch in (0, 1, 2, 2):
        book.extend(events.filter(part == batch), batch, "k", "event_id")
    return book.codes().select(F.col("key").alias("k"), "code")


@query(
    "label_encode_fixed",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS code FROM events""",
)
def label_encode_fixed(spark, sf):
    events = table(spark, sf, "events")
    codes = {"click": 0, "view": 1, "purchase": 2}
    return events.select("event_id", encode.fixed_code(F.col("event_type"), codes).alias("code"))


@query(
    "multiclass_encode",
    """WITH c AS (SELECT o_orderstatus AS v, row_number() OVER (ORDER BY min(o_orderkey)) + 1 AS code FROM orders
                 WHERE o_orderstatus NOT IN ('O', 'P') GROUP BY 1
                 UNION ALL SELECT 'O', 0 UNION ALL SELECT 'P', 1)
    SELECT o_orderkey, CAST(code AS BIGINT) AS code FROM orders JOIN c ON v = o_orderstatus""",
)
def multiclass_encode(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    known = local_table(spark, [("O", 0), ("P", 1)], "key string, code long")
    codes = stage(encode.first_seen_codes(orders, "o_orderstatus", "o_orderkey", known))
    return encode.multiclass_encode(orders, "o_orderstatus", codes, "code").drop("o_orderstatus")


@query(
    "one_hot",
    """SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CAST(CAST(i = label AS INTEGER) AS VARCHAR)), ',') AS hot
    FROM embeddings""",
)
def one_hot(spark, sf):
    hot = F.transform(encode.one_hot(F.col("label"), 10), lambda x: x.cast("int").cast("string"))
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(hot, ",").alias("hot"))


@query(
    "zscore_scale",
    f"""WITH {RISK_SQL}, m AS (SELECT median(l_tax) AS t FROM risk),
    f AS (SELECT l_orderkey, l_linenumber, coalesce(l_tax, t) AS l_tax, l_quantity FROM risk, m),
    s AS (SELECT avg(l_tax) AS a1, stddev_pop(l_tax) AS s1, avg(l_quantity) AS a2, stddev_pop(l_quantity) AS s2 FROM f)
    SELECT l_orderkey, l_linenumber, round((l_tax - a1) / s1, 5) + 0.0 AS l_tax, round((l_quantity - a2) / s2, 5) + 0.0 AS l_quantity FROM f, s""",
)
def zscore_scale(spark, sf):
    df = risk_frame(spark, sf).select("l_orderkey", "l_linenumber", "l_tax", "l_quantity")
    out = rounded(impute.zscore_scale(df, ["l_tax", "l_quantity"]), "l_tax", "l_quantity", places=5)
    # no negative zero
    return out.withColumns({c: F.col(c) + 0.0 for c in ("l_tax", "l_quantity")})


@query(
    "bin_then_risk",
    f"""WITH {RISK_SQL}, m AS (SELECT median(l_tax) AS t FROM risk),
    f AS (SELECT l_orderkey, l_linenumber, y, coalesce(l_tax, t) AS v FROM risk, m),
    e AS (SELECT list_sort(list_distinct(quantile_cont(v, [0, .2, .4, .6, .8, 1]))) AS q FROM f),
    b AS (SELECT *, 'Bin_' || greatest(len(list_filter(q, lambda x: x < v)) - 1, 0) AS bin FROM f, e),
    r AS (SELECT bin, avg(CAST(y AS DOUBLE)) AS value FROM b WHERE y <> -1 GROUP BY bin),
    g AS (SELECT avg(CAST(y AS DOUBLE)) AS d FROM b WHERE y <> -1)
    SELECT l_orderkey, l_linenumber, bin, round(coalesce(value, d), 6) AS bin_risk FROM b LEFT JOIN r USING (bin), g""",
)
def bin_then_risk(spark, sf):
    out, _ = binning.bin_then_risk(risk_frame(spark, sf), "l_tax", "y", 5)
    out = out.select(
        "l_orderkey", "l_linenumber", F.col("l_tax_bin").alias("bin"), F.col("l_tax_bin_risk").alias("bin_risk")
    )
    return rounded(out, "bin_risk")


@query(
    "assemble_features",
    f"""WITH {RISK_SQL}, {fit_sql("supp")}
    SELECT l_orderkey, l_linenumber, round(l_quantity + l_extendedprice + coalesce(value, d), 4) AS total, 3 AS width
    FROM risk LEFT JOIN fitted f ON f.key = supp CROSS JOIN overall""",
)
def assemble_features(spark, sf):
    df = risk_frame(spark, sf)
    tables = risk.risk_table_fit(df, ["supp"], "y", 0.01, 5).staged()
    mapped = risk.risk_map_apply(df, tables, ["supp"])
    vec = encode.assemble_features(mapped, ["l_quantity", "l_extendedprice"], ["supp"])
    arr = vector_to_array("features")
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    return vec.select("l_orderkey", "l_linenumber", F.round(total, 4).alias("total"), F.size(arr).alias("width"))


@query(
    "class_weight_column",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 2.5::DOUBLE ELSE 1.0 END AS w2,
      CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 2.0 ELSE 3.0 END AS w3 FROM lineitem""",
)
def class_weight_column(spark, sf):
    flag = F.col("l_returnflag")
    two = encode.class_weight_column((flag == "R").cast("int"), [2.0, 5.0], 2)
    three = encode.class_weight_column(F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2), [1.0, 2.0, 3.0], 3)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", two.alias("w2"), three.alias("w3"))
