"""Queries that train, score and format with Spark ML, and the streaming forms."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from riskloom.catalog.features import MULTI_FIT_SQL
from riskloom.catalog.inputs import MULTI_SQL, RISK_SQL, class_scores, risk_frame
from riskloom.catalog.registry import query, rounded, table
from riskloom.catalog.texts import MESSAGES_SQL, chunks_sql, dialogue_text, squeeze_sql
from riskloom.functions import dialogue as dg, formats
from riskloom.operators import boosting, model as md
from riskloom.operators.curves import auc_roc
from riskloom.operators.encode import class_weight_column
from riskloom.operators.quality import oot_split
from riskloom.operators.split import random_split
from riskloom.plans.cutoffs import hash_fraction
from riskloom.operators import scoring
from riskloom.plans.partitions import spread
from riskloom.plans.staging import stage
from riskloom.streaming import score as st

FEATURES = ["l_quantity", "l_extendedprice", "l_tax", "l_discount", "supp", "line"]
SMALL = md.TreeParams(max_depth=3, rounds=5, step_size=0.3)


def training_frame(spark, sf):
    """Labelled line items with mapped risks, split by hash of the row."""
    df = risk_frame(spark, sf).filter("y <> -1")
    df = df.withColumn("row_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "part", "supp"))
    state = md.fit_features(df, "y", ["supp", "line"], FEATURES[:4], 0.01, 5)
    mapped = md.eval_feature_frame(df, state, ["row_id", "y", "l_shipdate"])
    return stage(spread(random_split(mapped, "row_id", 0.3)), "training")


def trained(df, **kwargs):
    rows = df.withColumn("weight", class_weight_column(F.col("y"), [1.0, 2.0], 2))
    rows = rows.withColumn("is_val", hash_fraction(7, "row_id") < 0.2)
    return md.train_boosted_trees(
        rows.filter("split = 'train'"), FEATURES, "y", SMALL, weight="weight", validation="is_val", **kwargs
    )


@query("train_boosted_trees")
def train_boosted_trees(spark, sf):
    df = training_frame(spark, sf)
    scored = md.score_frame(df, trained(df)).select("split", "y", F.element_at("probs", 2).alias("score"))
    return rounded(auc_roc(scored, "score", "y", ["split"]), "auc", places=4)


BOOST_FEATURES = ["l_quantity", "l_tax", "l_discount"]


def best_cut_sql(node: str, rows: str) -> str:
    """``<node>``: feature, cut, side of missing values, gain and leaf values of the best cut of ``rows(f0, f1, f2, g, h)``.

    Penalties: lambda 1, alpha 2; step 0.5. A cut beyond all values parts them from the missing ones.
    """
    worth = lambda g, h: f"power(greatest(abs({g}) - 2, 0), 2) / ({h} + 1)"
    value = lambda g, h: f"-sign({g}) * greatest(abs({g}) - 2, 0) / ({h} + 1) * 0.5"
    cells = " UNION ALL ".join(f"SELECT {i} AS f, f{i} AS v, sum(g)::DOUBLE AS g, sum(h)::DOUBLE AS h FROM {rows} GROUP BY f{i}" for i in range(3))
    return f"""
{node}_c AS ({cells}),
{node}_t AS (SELECT f, sum(g) AS g, sum(h) AS h, coalesce(sum(g) FILTER (v IS NULL), 0) AS gm, coalesce(sum(h) FILTER (v IS NULL), 0) AS hm
  FROM {node}_c GROUP BY f),
{node}_p AS (SELECT f, v, sum(g) OVER o AS cg, sum(h) OVER o AS ch FROM {node}_c WHERE v IS NOT NULL WINDOW o AS (PARTITION BY f ORDER BY v)),
{node}_s AS (SELECT f, v, m, g, h, cg + CASE WHEN m THEN gm ELSE 0 END AS gl, ch + CASE WHEN m THEN hm ELSE 0 END AS hl
  FROM {node}_p JOIN {node}_t USING (f), (VALUES (false), (true)) x(m)),
{node} AS (
  SELECT f, CASE WHEN v < max(v) OVER (PARTITION BY f) THEN v END AS cut, m, gl, hl, g - gl AS gr, h - hl AS hr,
         0.5 * ({worth("gl", "hl")} + {worth("(g - gl)", "(h - hl)")} - {worth("g", "h")}) AS gain,
         {value("gl", "hl")} AS left_value, {value("(g - gl)", "(h - hl)")} AS right_value
  FROM {node}_s WHERE hl >= 1 AND h - hl >= 1 QUALIFY gain > 0 ORDER BY gain DESC, f, m, v LIMIT 1)"""


def side_sql(name: str, rows: str, node: str, left: bool) -> str:
    v = f"CASE {node}.f WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END"
    goes = f"CASE WHEN {v} IS NULL THEN m WHEN cut IS NULL THEN true ELSE {v} <= cut END"
    return f"{name} AS (SELECT f0, f1, f2, r.g, r.h FROM {rows} r, {node} WHERE {'' if left else 'NOT '}({goes}))"


@query(
    "boosted_tree_cuts",
    f"""WITH {RISK_SQL},
    r0 AS (SELECT l_quantity AS f0, l_tax AS f1, l_discount AS f2, 0.5 - y AS g, 0.25 AS h FROM risk WHERE y <> -1),
    {best_cut_sql("n0", "r0")}, {side_sql("r1", "r0", "n0", True)}, {side_sql("r2", "r0", "n0", False)},
    {best_cut_sql("n1", "r1")}, {best_cut_sql("n2", "r2")},
    n AS (SELECT 0 AS node, f, cut, m, gain, NULL::DOUBLE AS left_value, NULL::DOUBLE AS right_value FROM n0
      UNION ALL SELECT 1, f, cut, m, gain, left_value, right_value FROM n1 UNION ALL SELECT 2, f, cut, m, gain, left_value, right_value FROM n2)
    SELECT node, ['l_quantity', 'l_tax', 'l_discount'][f + 1] AS feature, cut, m AS missing_left, round(gain, 6) AS gain,
           round(left_value, 8) AS left_value, round(right_value, 8) AS right_value FROM n""",
)
def boosted_tree_cuts(spark, sf):
    """The cuts and leaf values of a first tree of two levels, found by value in SQL."""
    df = risk_frame(spark, sf).filter("y <> -1")
    params = boosting.BoostParams(rounds=1, eta=0.5, max_depth=2, reg_alpha=2.0)
    nodes = boosting.fit_boosted_trees(df, BOOST_FEATURES, "y", params).nodes(spark)
    side = nodes.select("node", "value")
    joined = nodes.filter("feature IS NOT NULL").alias("n")
    for name in ("left", "right"):  # seven nodes
        joined = joined.join(side.select(F.col("node").alias(name), F.col("value").alias(f"{name}_value")), name, "left")
    cut = F.when(F.col("cut") < float("inf"), F.col("cut"))
    return joined.select(
        "node", "feature", cut.alias("cut"), "missing_left", F.round("gain", 6).alias("gain"),
        F.round("left_value", 8).alias("left_value"), F.round("right_value", 8).alias("right_value"),
    )


@query(
    "boosted_softmax",
    """SELECT y AS label, count(*) AS n, 1 AS sums_to_one, 1 AS beats_shares, 1 AS early_enough FROM (
      SELECT CASE WHEN l_quantity < 15 THEN 0 WHEN l_discount > 0.05 THEN 2 ELSE 1 END AS y FROM lineitem) GROUP BY y""",
)
def boosted_softmax(spark, sf):
    """Three classes of quantity and discount by one softmax model, stopped on validation rows: held-out log loss below that of the class shares by a quarter."""
    label = F.when(F.col("l_quantity") < 15, 0).when(F.col("l_discount") > 0.05, 2).otherwise(1)
    df = risk_frame(spark, sf).withColumn("label", label)
    df = df.withColumn("row_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "part", "supp"))
    df = df.withColumn("held", hash_fraction(11, "row_id") < 0.2)
    params = boosting.BoostParams(rounds=6, eta=0.4, max_depth=3, early_stopping=3)
    model = boosting.fit_boosted_trees(df, [*BOOST_FEATURES, "supp"], "label", params, validation="held", n_classes=3)
    scored = model.score(df.select("label", "held", *BOOST_FEATURES, "supp"))
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    loss = -F.log(F.get("probs", F.col("label")))
    facts = scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.abs(total - 1)).alias("off"),
        F.sum(F.when(F.col("held"), loss)).alias("loss"),
        F.count_if("held").alias("h"),
    )
    every = Window.partitionBy(F.lit(0))  # three rows
    facts = facts.withColumn("prior", -F.col("h") * F.log(F.col("h") / F.sum("h").over(every)))
    better = F.sum("loss").over(every) < 0.75 * F.sum("prior").over(every)
    return facts.select(
        "label", "n", (F.col("off") < 1e-9).cast("int").alias("sums_to_one"), better.cast("int").alias("beats_shares"),
        F.lit(int(len(model.trees) <= 6 and len(model.losses) >= 2)).alias("early_enough"),
    )


@query("score_frame")
def score_frame(spark, sf):
    df = training_frame(spark, sf)
    return md.score_frame(df, trained(df)).select("row_id", "y", F.round(F.element_at("probs", 2), 6).alias("score"))


@query("feature_importance")
def feature_importance(spark, sf):
    return rounded(md.feature_importance(trained(training_frame(spark, sf)), FEATURES, spark), "importance")


@query("feature_selection_loop")
def feature_selection_loop(spark, sf):
    df = training_frame(spark, sf).withColumn("constant", F.lit(1.0))
    model, kept = md.feature_selection_loop(df, [*FEATURES, "constant"], "y", SMALL, max_iter=2)
    return rounded(md.feature_importance(model, kept, spark), "importance")


@query("train_test_oot_report")
def train_test_oot_report(spark, sf):
    df = training_frame(spark, sf)
    model = trained(df)
    parts = oot_split(df, "l_shipdate", "y", "2001-06-01")
    named = parts.withColumn("split", F.when(F.col("part") == "oot", "oot").otherwise(F.col("split")))
    return rounded(md.train_test_oot_report(named, model, "y"), "auc", places=4)


TREE_ROWS_SQL = """
scored AS (SELECT y, l_shipdate, concat_ws('-', l_orderkey, l_linenumber, part, supp) AS row_id FROM risk WHERE y <> -1),
parts AS (SELECT y, CASE WHEN l_shipdate >= TIMESTAMP '2001-06-01' THEN 'oot'
    WHEN CAST('0x' || substr(md5('42:' || row_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.3 THEN 'test' ELSE 'train' END AS split FROM scored)"""


def checked(scored, by="split", label="y"):
    """Per split: the rows of each class that got a score, and whether the scores are sound."""
    auc = auc_roc(scored, "score", label, [by]).select(by, "n_pos", "n_neg", "auc")
    sound = scored.groupBy(by).agg(F.min(F.col("score").between(0, 1)).cast("int").alias("in_range"))
    least = F.when(F.col(by) == "train", 0.5).otherwise(0.0)
    ranks = (F.col("auc") > least) & (F.col("auc") <= 1)
    return auc.join(sound, by).select(by, "n_pos", "n_neg", "in_range", ranks.cast("int").alias("ranks"))


@query(
    "tree_model_checks",
    f"""WITH {RISK_SQL}, {TREE_ROWS_SQL} SELECT split, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
      1 AS in_range, 1 AS ranks FROM parts GROUP BY split""",
)
def tree_model_checks(spark, sf):
    """Training, scoring and the report over train, test and later rows: no row lost, scores in range, better than chance."""
    df = training_frame(spark, sf)
    parts = oot_split(df, "l_shipdate", "y", "2001-06-01")
    named = parts.withColumn("split", F.when(F.col("part") == "oot", "oot").otherwise(F.col("split")))
    return checked(md.score_frame(named, trained(df)).select("split", "y", F.element_at("probs", 2).alias("score")))


@query("feature_importance_checks", "SELECT 6 AS features, 1 AS sums_to_one, 1 AS none_negative, 1 AS constant_dropped")
def feature_importance_checks(spark, sf):
    """Importances of the six features and a constant: a share each, and the selection drops the constant."""
    df = training_frame(spark, sf).withColumn("constant", F.lit(1.0))
    shares = md.feature_importance(trained(df), FEATURES, spark)
    _, kept = md.feature_selection_loop(df, [*FEATURES, "constant"], "y", SMALL, max_iter=2)
    return shares.agg(
        F.count(F.lit(1)).alias("features"),
        (F.abs(F.sum("importance") - 1) < 1e-9).cast("int").alias("sums_to_one"),
        F.min(F.col("importance") >= 0).cast("int").alias("none_negative"),
        F.lit(int("constant" not in kept and len(kept) > 0)).alias("constant_dropped"),
    )


@query("multiclass_trees")
def multiclass_trees(spark, sf):
    """One against the rest over the three return flags, with the learner's whole rounds and depth."""
    items = spread(table(spark, sf, "lineitem")).select(
        "l_quantity",
        "l_extendedprice",
        "l_tax",
        F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0).alias("y"),
    )
    features = ["l_quantity", "l_extendedprice", "l_tax"]
    binned = md.binned_rows(items, features, "y", n_classes=3)
    model = md.train_boosted_trees(items, features, "y", n_classes=3, binned=binned)
    return model.transform(md.merged_rows(items, binned, ["y"])).groupBy("y", "prediction").agg(F.sum("n").alias("n"))


def scored_texts(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    rows = docs.select("doc_id", "text", F.log1p("n_chars").alias("size"), F.col("quality").alias("y"))
    split = stage(spread(random_split(rows, "doc_id", 0.3)))
    model = md.text_classifier("text", "y", ["size"]).fit(split.filter("split = 'train'"))
    return model.transform(split).select("split", "y", F.element_at(vector_to_array("probability"), 2).alias("score"))


@query("text_classifier")
def text_classifier(spark, sf):
    return rounded(auc_roc(scored_texts(spark, sf), "score", "y", ["split"]), "auc", places=4)


@query(
    "text_classifier_checks",
    """WITH parts AS (SELECT quality AS y, CASE WHEN CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.3
      THEN 'test' ELSE 'train' END AS split FROM documents JOIN labels USING (doc_id))
    SELECT split, count(*) FILTER (y > 0) AS n_pos, count(*) FILTER (y <= 0) AS n_neg, 1 AS in_range, 1 AS ranks FROM parts GROUP BY split""",
)
def text_classifier_checks(spark, sf):
    return checked(scored_texts(spark, sf))


# ---- prediction formats

BINARY_SQL = """
two AS (SELECT l_orderkey, l_linenumber, 1.0::DOUBLE - l_extendedprice / 105000.0 AS p0, l_extendedprice / 105000.0 AS p1,
               l_discount AS c1 FROM lineitem)"""


def binary_scores(spark, sf):
    p = F.col("l_extendedprice") / 105000.0
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array(1.0 - p, p).alias("raw"),
        F.array(1.0 - F.col("l_discount"), F.col("l_discount")).alias("cal"),
    )


@query(
    "prediction_json",
    f"""WITH {BINARY_SQL} SELECT l_orderkey, l_linenumber, '{{"legacy-score":"' || CAST(p1 AS VARCHAR) || '","calibrated-score":"' || CAST(c1 AS VARCHAR)
      || '","custom-output-label":"class-' || CASE WHEN p1 > p0 THEN 1 ELSE 0 END || '"}}' AS record FROM two""",
)
def prediction_json(spark, sf):
    record = formats.prediction_json(F.col("raw"), F.col("cal"), 2)
    return binary_scores(spark, sf).select("l_orderkey", "l_linenumber", record.alias("record"))


@query(
    "prediction_csv",
    f"""WITH {BINARY_SQL}, r AS (SELECT l_orderkey, l_linenumber, printf('%.4f', p1) || ',' || printf('%.4f', c1) || ',class-'
      || CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS record FROM two) SELECT * FROM r""",
)
def prediction_csv(spark, sf):
    record = formats.prediction_csv(F.col("raw"), F.col("cal"), 2)
    return binary_scores(spark, sf).select("l_orderkey", "l_linenumber", record.alias("record"))


@query(
    "prediction_json_multiclass",
    f"""WITH {MULTI_SQL}, s AS (SELECT y, CAST(probs[1] AS VARCHAR) AS a, CAST(probs[2] AS VARCHAR) AS b, CAST(probs[3] AS VARCHAR) AS c,
      'class-' || (list_position(probs, list_max(probs)) - 1) AS l, probs FROM multi)
    SELECT y, '{{"prob_01":"' || a || '","calibrated_prob_01":"' || a || '","prob_02":"' || b || '","calibrated_prob_02":"' || b
      || '","prob_03":"' || c || '","calibrated_prob_03":"' || c || '","custom-output-label":"' || l || '"}}' AS record,
      '{{"legacy-score":"' || a || '","prob_02":"' || b || '","prob_03":"' || c || '","output-label":"' || l || '"}}' AS text_record,
      printf('%.4f', probs[1]) || ',' || printf('%.4f', probs[2]) || ',' || printf('%.4f', probs[3]) || ',' || l AS text_csv FROM s""",
)
def prediction_json_multiclass(spark, sf):
    probs = F.col("probs")
    return class_scores(spark, sf).select(
        "y",
        formats.prediction_json(probs, probs, 3).alias("record"),
        formats.text_prediction_json(probs, 3).alias("text_record"),
        formats.text_prediction_csv(probs, 3).alias("text_csv"),
    )


@query(
    "argmax_label",
    f"WITH {MULTI_SQL} SELECT y, 'class-' || (list_position(probs, list_max(probs)) - 1) AS label, count(*) AS n FROM multi GROUP BY ALL",
)
def argmax_label(spark, sf):
    labelled = class_scores(spark, sf).select("y", formats.argmax_label(F.col("probs")).alias("label"))
    return labelled.groupBy("y", "label").agg(F.count(F.lit(1)).alias("n"))


# ---- streaming


@query(
    "stream_score",
    f"""WITH {RISK_SQL}, {MULTI_FIT_SQL}, med AS (SELECT median(l_tax) AS t FROM risk)
    SELECT l_orderkey, l_linenumber, round((coalesce(a.value, ga.d) + coalesce(b.value, gb.d)) / 2 + coalesce(l_tax, t), 6) AS score
    FROM risk LEFT JOIN fitted a ON a.var = 'supp' AND a.key = supp LEFT JOIN fitted b ON b.var = 'line' AND b.key = line
    JOIN overall ga ON ga.var = 'supp' JOIN overall gb ON gb.var = 'line', med""",
)
def stream_score(spark, sf):
    history = risk_frame(spark, sf)
    state = md.fit_features(history, "y", ["supp", "line"], ["l_tax"], 0.01, 5)
    fills, defaults = st.literals(state)

    def predict(d):
        return d.withColumn("score", (F.col("supp") + F.col("line")) / 2 + F.col("l_tax"))

    def chain(rows):
        requests = rows.select(
            "l_orderkey",
            "l_linenumber",
            F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
            F.col("l_suppkey").cast("string").alias("supp"),
            F.nullif(F.col("l_linenumber").cast("string"), F.lit("7")).alias("line"),
        )
        return st.stream_score(requests, state, fills, defaults, predict, keep=("l_orderkey", "l_linenumber"))

    out = st.replay(spark, f"{sf}/lineitem.parquet", table(spark, sf, "lineitem").schema, chain)
    return rounded(out.select("l_orderkey", "l_linenumber", "score"), "score")


REQUEST_SCHEMA = "l_quantity double, l_extendedprice double, l_tax double, l_discount double, supp string, line string"
REQUEST_SQL = """req AS (SELECT l_orderkey % 8 AS k, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id FROM lineitem),
    rec AS (SELECT row_id, CAST(unnest(CASE WHEN k = 7 THEN [0, 1] ELSE [0] END) AS INTEGER) AS pos,
      CASE k WHEN 0 THEN 'invalid record' WHEN 1 THEN 'empty input' WHEN 2 THEN 'unsupported content type' END AS error FROM req)"""


def requests(rows):
    """A request per line item: CSV, JSON, arrays of two records, and bodies that cannot be scored."""
    fields = {
        **{c: F.col(c) for c in FEATURES[:4]},
        "supp": F.col("l_suppkey").cast("string"),
        "line": F.col("l_linenumber").cast("string"),
    }
    k = F.col("l_orderkey") % 8
    record = F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))
    csv = F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in fields.values()])
    body = (
        F.when(k == 0, "{oops").when(k == 1, " ").when(k < 5, csv)
        .when(k == 7, F.concat(F.lit("["), record, F.lit(","), record, F.lit("]"))).otherwise(record)
    )
    media = F.when(k == 2, "image/png").when(k.isin(3, 4), "text/csv").otherwise("application/json")
    row_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.select(row_id.alias("row_id"), body.alias("body"), media.alias("media"))


def fitted_scorer(spark, sf):
    history = spread(risk_frame(spark, sf).filter("y <> -1"))
    return scoring.fit_scorer(history, "y", ["supp", "line"], FEATURES[:4], REQUEST_SCHEMA, SMALL, 0.01, 5)


@query(
    "score_requests",
    f"""WITH {REQUEST_SQL} SELECT row_id, pos, error, CASE WHEN error IS NULL THEN 1 ELSE 0 END AS scored,
      CASE WHEN error IS NULL THEN 1 END AS in_range FROM rec""",
)
def score_requests(spark, sf):
    """Bodies to records, features, trained trees, calibrated scores and output records."""
    out = fitted_scorer(spark, sf).score(requests(table(spark, sf, "lineitem")), "row_id")
    whole = F.col("json").contains("calibrated-score") & F.col("csv").rlike(r"^[01]\.\d{4},[01]\.\d{4},class-[01]$")
    in_range = F.col("score").between(0, 1) & F.col("calibrated").between(0, 1)
    return out.select("row_id", "pos", "error", F.coalesce(whole.cast("int"), F.lit(0)).alias("scored"), in_range.cast("int").alias("in_range"))


@query(
    "stream_score_requests",
    f"""WITH {REQUEST_SQL} SELECT error, count(*) AS n, count(*) FILTER (error IS NULL) AS scored, 1 AS same_as_batch FROM rec GROUP BY error""",
)
def stream_score_requests(spark, sf):
    """The same chain on arriving files, compared with the batch's records by sums of hashes."""
    scorer = fitted_scorer(spark, sf)
    lines = table(spark, sf, "lineitem")
    batch = scorer.score(requests(lines), "row_id")
    stream = st.replay(spark, f"{sf}/lineitem.parquet", lines.schema, lambda rows: scorer.score(requests(rows), "row_id"))
    digest = F.xxhash64("row_id", "pos", "error", "score", "calibrated", "json", "csv").cast("decimal(38,0)")
    both = batch.withColumn("_side", F.lit(1)).unionAll(stream.withColumn("_side", F.lit(-1)))
    return both.groupBy("error").agg(
        F.count_if(F.col("_side") == -1).alias("n"),
        F.count_if((F.col("_side") == -1) & F.col("json").isNotNull()).alias("scored"),
        (F.sum(digest * F.col("_side")) == 0).cast("int").alias("same_as_batch"),
    )


@query(
    "stream_dialogue",
    f"""WITH raw AS ({"WITH " + MESSAGES_SQL + " SELECT * FROM dlg"}),
    dlg AS (SELECT conv_id, turn, list_transform(msgs, lambda m: lower({squeeze_sql('m')})) AS msgs FROM raw), {chunks_sql(40)}
    SELECT * FROM rows""",
)
def stream_dialogue(spark, sf):
    def chain(rows):
        return st.stream_dialogue(rows, ["conv_id", "turn"], dg.dialogue_split(dialogue_text()), 40)

    return st.replay(spark, f"{sf}/conversations.parquet", table(spark, sf, "conversations").schema, chain)


