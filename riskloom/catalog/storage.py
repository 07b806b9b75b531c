"""Queries that write tables in the formats of the jobs and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.features import fit_sql
from riskloom.catalog.inputs import MULTI_SQL, PREDS_SQL, RISK_SQL, class_scores, predictions, risk_frame
from riskloom.catalog.registry import query, table
from riskloom.operators.model import eval_feature_frame, fit_features
from riskloom.operators.quality import RoleSpec
from riskloom.operators.split import stratified_split
from riskloom.plans.staging import new_stage_path
from riskloom.sources import artifacts, readers, writers


@query(
    "scan_shards",
    """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS o_totalprice,
      CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS o_orderpriority FROM orders""",
)
def scan_shards(spark, sf):
    orders = table(spark, sf, "orders")
    path = new_stage_path(spark, "shards")
    status = F.col("o_orderstatus")
    two = orders.filter(status == "F").select("o_orderkey", "o_orderstatus")
    two.write.mode("append").csv(path, header=True, compression="gzip")
    three = orders.filter(status == "O").select("o_orderkey", "o_orderstatus", "o_totalprice")
    three.write.mode("append").json(path)
    four = orders.filter(~status.isin("F", "O")).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    four.write.mode("append").parquet(path)
    columns = "o_orderkey long, o_orderstatus string"
    schemas = {"csv": columns, "json": f"{columns}, o_totalprice double", "parquet": four.schema}
    return readers.scan_shards(spark, path, schemas=schemas)


@query(
    "scan_shards_dialects",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 5 = 3 THEN o_orderpriority END AS o_orderpriority
    FROM orders""",
)
def scan_shards_dialects(spark, sf):
    orders = table(spark, sf, "orders")
    path = new_stage_path(spark, "dialects")
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    rest = F.col("o_orderkey") % 5
    for i, sep in enumerate((",", "\t", ";", "|")):
        more = ["o_orderpriority"] if i == 3 else []
        orders.filter(rest == i).select(*columns, *more).write.mode("append").csv(path, header=True, sep=sep, compression="gzip" if i % 2 else None)
    orders.filter(rest == 4).select(*columns).write.mode("append").json(path)
    return readers.scan_shards(spark, path)


@query(
    "scan_shards_wrapped",
    """SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 <> 1 THEN o_orderpriority END AS o_orderpriority FROM orders""",
)
def scan_shards_wrapped(spark, sf):
    orders = table(spark, sf, "orders")
    plain, path = new_stage_path(spark, "plain"), new_stage_path(spark, "wrapped")
    rest = F.col("o_orderkey") % 3
    two = orders.filter(rest == 1).select(F.col("o_orderkey").cast("long"), "o_totalprice")
    two.write.mode("append").parquet(plain)
    orders.filter(rest == 2).select("o_orderkey", "o_totalprice", "o_orderpriority").write.mode("append").parquet(plain)
    writers.gzip_files(spark, plain, path, "part-*.parquet")
    orders.filter(rest == 0).select("o_orderkey", "o_totalprice", "o_orderpriority").write.mode("append").parquet(path)
    return readers.scan_shards(spark, path)


@query(
    "scan_json_lines_or_array",
    """SELECT event_id AS id, user_id AS "user.id", event_type AS "user.kind", value FROM events""",
)
def scan_json_lines_or_array(spark, sf):
    user = F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("user")
    record = F.struct(F.col("event_id").alias("id"), user, "value")
    path = new_stage_path(spark, "json")
    table(spark, sf, "events").select(F.to_json(F.array(record)).alias("value")).write.text(path)
    return readers.scan_json(spark, path)


@query(
    "scan_role_typed",
    "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, value AS amount FROM events",
)
def scan_role_typed(spark, sf):
    path = new_stage_path(spark, "typed") + ".tsv"
    table(spark, sf, "events").select("event_id", "event_type", "value").write.csv(path, header=True, sep="\t")
    roles = RoleSpec(label="label", id="id", categorical=("kind",), numeric=("amount",))
    return readers.scan_role_typed(spark, path, roles, names=["id", "kind", "amount"])


@query(
    "scan_with_signature",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, CAST(n_chars AS VARCHAR) AS "TAG", 'a"b\\c' AS note FROM documents""",
)
def scan_with_signature(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", F.col("n_chars").alias("size"), F.lit('a"b\\c').alias("note")
    )
    data, signature = new_stage_path(spark, "data"), new_stage_path(spark, "signature")
    docs.write.csv(data, header=True, escape="\\", quoteAll=True)
    docs.limit(0).write.csv(signature, header=True)
    return readers.scan_with_signature(spark, data, signature, label="size")


@query("scan_cases", "SELECT conv_id, turn, role, text AS dialogue FROM conversations")
def scan_cases(spark, sf):
    path = new_stage_path(spark, "cases") + ".jsonl"
    table(spark, sf, "conversations").withColumnRenamed("text", "dialogue").write.json(path)
    return readers.scan_cases(spark, path)


SPLIT_COUNTS_SQL = """
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rn,
             count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
s AS (SELECT *, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train'
        WHEN rn <= floor(n * 0.7::DOUBLE) + floor((n - floor(n * 0.7::DOUBLE)) * 0.5::DOUBLE) THEN 'test' ELSE 'val' END AS split FROM r)"""


def written_splits(spark, sf):
    path = new_stage_path(spark, "splits")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    writers.sink_splits(stratified_split(orders, "o_orderstatus", "o_orderkey"), path)
    return path


@query(
    "sink_splits",
    f"WITH {SPLIT_COUNTS_SQL} SELECT split, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM s GROUP BY ALL",
)
def sink_splits(spark, sf):
    df = spark.read.parquet(written_splits(spark, sf))
    return df.groupBy("split", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("scan_split_dirs", f"WITH {SPLIT_COUNTS_SQL} SELECT o_orderkey, split FROM s WHERE split IN ('test', 'val')")
def scan_split_dirs(spark, sf):
    df = readers.scan_split_dirs(spark, written_splits(spark, sf), ["test", "val"])
    return df.select("o_orderkey", "split")


@query(
    "scan_tagged_predictions",
    f"""WITH {PREDS_SQL} SELECT dataset_origin, count(*) AS n, round(sum(score), 4) AS total FROM (
      SELECT 'validation' AS dataset_origin, score, y FROM preds UNION ALL SELECT 'test', old_score, y FROM preds) GROUP BY 1""",
)
def scan_tagged_predictions(spark, sf):
    df = predictions(spark, sf)
    tagged = readers.scan_tagged_predictions(
        {"validation": df.select("y", "score", "amount"), "test": df.select("y", F.col("old_score").alias("score"))}
    )
    return tagged.groupBy("dataset_origin").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total")
    )


@query(
    "scan_rank_predictions",
    """SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id % 2 AS VARCHAR) AS label,
      CASE WHEN event_type = 'view' THEN 3 ELSE 2 END AS k,
      CASE WHEN event_type = 'view' THEN 0.25 ELSE (user_id % 101) / 100.0::DOUBLE END AS second FROM events""",
)
def scan_rank_predictions(spark, sf):
    folder = new_stage_path(spark, "ranks")
    prob = F.when(F.col("event_type") == "view", "[0.5, 0.25, 0.25]").otherwise(
        ((F.col("user_id") % 101) / 100.0).cast("string")
    )
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 2).alias("label"), prob.alias("prob"), "event_type"
    )
    many = F.col("event_type") == "view"
    rows.filter(~many).drop("event_type").write.csv(f"{folder}/test_result_0.tsv", sep="\t", header=True)
    rows.filter(many).drop("event_type").write.csv(f"{folder}/test_result_1.tsv", sep="\t", header=True)
    read = readers.scan_rank_predictions(spark, folder)
    return read.select("id", "label", F.size("probs").alias("k"), F.element_at("probs", 2).alias("second"))


@query(
    "parse_request_records",
    """WITH n AS (SELECT *, unnest(CASE event_type WHEN 'click' THEN [0, 1] WHEN 'view' THEN [0, 1] WHEN 'signup' THEN [0, 1] ELSE [0] END) AS pos FROM events)
    SELECT event_id, CAST(pos AS INTEGER) AS pos,
      CASE WHEN event_type IN ('error', 'purchase') OR (event_type = 'signup' AND pos = 1) THEN NULL ELSE user_id + pos END AS user_id,
      CASE WHEN event_type IN ('error', 'purchase') OR (event_type = 'signup' AND pos = 1) THEN NULL ELSE value END AS value,
      CASE WHEN event_type = 'error' THEN 'unsupported content type' WHEN event_type = 'purchase' THEN 'empty input'
           WHEN event_type = 'signup' AND pos = 1 THEN 'invalid record' END AS error FROM n""",
)
def parse_request_records(spark, sf):
    kind = F.col("event_type")
    first = F.to_json(F.struct("user_id", "value"))
    second = F.to_json(F.struct((F.col("user_id") + 1).alias("user_id"), "value"))
    csv = F.concat_ws(",", "user_id", "value")
    csv2 = F.concat_ws(",", F.col("user_id") + 1, "value")
    body = (
        F.when(kind == "click", F.concat(csv, F.lit("\n"), csv2))
        .when(kind == "view", F.concat(F.lit("["), first, F.lit(","), second, F.lit("]")))
        .when(kind == "signup", F.concat(first, F.lit("\n{oops")))
        .when(kind == "purchase", "")
        .otherwise(first)
    )
    media = F.when(kind == "click", "text/csv").when(kind == "error", "image/png").otherwise("application/json")
    requests = table(spark, sf, "events").select("event_id", body.alias("body"), media.alias("media"))
    return readers.parse_request_records(requests, "body", "media", "event_id", "user_id bigint, value double")


def written_batches(spark, sf):
    root = new_stage_path(spark, "batches")
    events = table(spark, sf, "events").withColumn(
        "evidence", F.array(F.col("event_type"), F.col("user_id").cast("string"))
    )
    late = F.col("value") >= 20
    writers.sink_batch_partitioned(events.filter(~late), root, "0")
    writers.sink_batch_partitioned(events.filter(late), root, "1")
    writers.sink_batch_partitioned(events, root, "all_backup")
    return root


@query(
    "sink_batch_partitioned",
    "SELECT event_type, count(*) AS n, min(event_type || ';' || user_id) AS first_evidence FROM events GROUP BY 1",
)
def sink_batch_partitioned(spark, sf):
    root = new_stage_path(spark, "batch")
    events = table(spark, sf, "events").withColumn(
        "evidence", F.array(F.col("event_type"), F.col("user_id").cast("string"))
    )
    path = writers.sink_batch_partitioned(events, root, "0", ["event_type"], "zstd")
    return spark.read.parquet(path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("evidence").alias("first_evidence")
    )


@query("merge_batches", "SELECT event_id, event_type, event_type || ';' || user_id AS evidence FROM events")
def merge_batches(spark, sf):
    merged = writers.merge_batches(spark, written_batches(spark, sf), exclude="backup")
    return merged.select("event_id", "event_type", "evidence")


@query(
    "sink_multi_format",
    """WITH f(fmt) AS (VALUES ('csv'), ('json'), ('parquet'))
    SELECT fmt, category, count(*) AS n FROM (SELECT event_type AS category FROM events), f GROUP BY ALL""",
)
def sink_multi_format(spark, sf):
    root = new_stage_path(spark, "formats")
    events = table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("category"),
        (F.col("user_id") / 1000.0).alias("confidence_score"),
        F.lit("success").alias("processing_status"),
        F.array("props").alias("message_evidence"),
    )
    writers.sink_multi_format(events, root)
    back = {
        "parquet": spark.read.parquet(f"{root}/results.parquet"),
        "csv": spark.read.csv(f"{root}/results.csv", header=True),
        "json": spark.read.json(f"{root}/results.jsonl"),
    }
    rows = readers.scan_tagged_predictions({k: v.select("category") for k, v in back.items()})
    counted = rows.groupBy(F.col("dataset_origin").alias("fmt"), "category")
    return counted.agg(F.count(F.lit(1)).alias("n"))


@query(
    "sink_predictions",
    f"""WITH {MULTI_SQL} SELECT y AS label, count(*) AS n, round(sum(probs[1]), 3) AS s0, round(sum(probs[2]), 3) AS s1,
      round(sum(probs[3]), 3) AS s2 FROM multi GROUP BY y""",
)
def sink_predictions(spark, sf):
    path = new_stage_path(spark, "predictions")
    rows = class_scores(spark, sf).withColumn("id", F.col("y"))
    writers.sink_predictions(rows, path, "id", "y", "probs", 3)
    back = spark.read.csv(path, header=True, schema="id long, label int, prob_class_0 double, prob_class_1 double, prob_class_2 double")
    sums = [F.round(F.sum(f"prob_class_{i}"), 3).alias(f"s{i}") for i in range(3)]
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums)


@query(
    "sink_metrics",
    f"""WITH {PREDS_SQL} SELECT 'mean_score' AS metric, round(avg(score), 6) AS value FROM preds
      UNION ALL SELECT 'base_rate', round(avg(y), 6) FROM preds""",
)
def sink_metrics(spark, sf):
    path = new_stage_path(spark, "metrics")
    summary = predictions(spark, sf).agg(
        F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("y"), 6).alias("base_rate")
    )
    writers.sink_metrics(summary, path)
    return spark.read.schema("metric string, value double").json(f"{path}/metrics.json")


@query(
    "fitted_artifacts",
    f"""WITH {RISK_SQL}, {fit_sql("supp")}, med AS (SELECT median(l_tax) AS t FROM risk)
    SELECT y, count(*) AS n, round(sum(coalesce(f.value, g.d)), 4) AS supp, round(sum(coalesce(l_tax, t)), 4) AS l_tax
    FROM risk LEFT JOIN fitted f ON f.key = risk.supp CROSS JOIN overall g CROSS JOIN med GROUP BY y""",
)
def fitted_artifacts(spark, sf):
    df = risk_frame(spark, sf)
    root = new_stage_path(spark, "artifacts")
    artifacts.save_features(spark, fit_features(df, "y", ["supp"], ["l_tax"], 0.01, 5), root)
    state = artifacts.load_features(spark, root)
    return eval_feature_frame(df, state, ["y"]).groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("supp"), 4).alias("supp"), F.round(F.sum("l_tax"), 4).alias("l_tax")
    )


