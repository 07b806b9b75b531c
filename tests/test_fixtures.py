"""Operators against hand-made inputs with known results."""

import math

import pytest
from pyspark.sql import functions as F, types as T

from riskloom.functions import dialogue as dg, entities, formats, numbers, responses as rs, text as tx
from riskloom.sources import readers
from riskloom.operators import binning, calibrate, curves, currency, encode, impute, labelling, metrics, quality, risk, tokens
from riskloom.operators.chain import chain, column_chains
from riskloom.plans import lookup


def one(df, column):
    return df.select(column.alias("r")).first()["r"]


@pytest.fixture(scope="module")
def text_row(spark):
    def make(value):
        return spark.createDataFrame([(value,)], "t string")

    return make


@pytest.fixture(scope="module")
def risk_input(spark):
    cats = ["A", "A", "A", "B", "B", "C", "D", "D", "E", "F", None]
    labels = [1, 1, 0, 1, 0, 1, 0, 0, 0, -1, 1]
    return spark.createDataFrame(list(zip(cats, labels)), "category string, label int")


def test_risk_table(risk_input):
    tables = risk.risk_table_fit(risk_input, ["category"], "label")
    got = {r.key: r.value for r in tables.bins.collect()}
    assert got == pytest.approx({"A": 2 / 3, "B": 0.5, "C": 1.0, "D": 0.0, "E": 0.0})
    assert tables.defaults.first().default_value == pytest.approx(4 / 9 * 9 / 9)


def test_risk_table_smoothing_and_threshold(risk_input):
    tables = risk.risk_table_fit(risk_input, ["category"], "label", smooth_factor=0.5, count_threshold=2)
    got = {r.key: r.value for r in tables.bins.collect()}
    default, s = 4 / 9, 4
    assert got["A"] == pytest.approx((3 * 2 / 3 + s * default) / (3 + s))
    assert got["C"] == pytest.approx(default)  # one row only


def test_risk_table_empty(spark):
    df = spark.createDataFrame([("X", -1)], "category string, label int")
    tables = risk.risk_table_fit(df, ["category"], "label")
    assert tables.bins.count() == 0
    assert tables.defaults.first().default_value == 0.5


def test_risk_apply(spark, risk_input):
    tables = risk.risk_table_fit(risk_input, ["category"], "label").staged()
    df = spark.createDataFrame([(1, "A"), (2, "C"), (3, "UNKNOWN"), (4, None)], "id int, category string")
    got = [r.category for r in risk.risk_map_apply(df, tables, ["category"]).orderBy("id").collect()]
    assert got == pytest.approx([2 / 3, 1.0, 4 / 9, 4 / 9])


def test_script_risk_counts_rows_without_category(risk_input):
    tables = risk.risk_table_fit_script(risk_input, ["category"], "label", 0.0, 0)
    assert tables.defaults.first().default_value == pytest.approx(0.5)
    assert {r.key for r in tables.bins.collect()} == {"A", "B", "C", "D", "E"}


def test_category_risk_ratio(spark):
    rows = [("a", 1), ("a", 0), ("a", 0), ("b", 1), ("b", 1), ("c", 0), ("d", 1), ("d", 0), ("d", -1)]
    df = spark.createDataFrame(rows, "c string, tag int")
    got = {r.key: r for r in risk.category_risk_ratio(df, "c", "tag", smoothing=2.0, cnt_threshold=1).collect()}
    p = 4 / 9
    assert got["a"].risk == pytest.approx((1 + 2 * p) / (3 + 2))
    assert got["b"].risk == pytest.approx(2 * 2.0 / 2)
    assert got["c"].risk == pytest.approx(p) and got["c"].n_positive == 0
    assert got["d"].risk == pytest.approx((1 + 2 * p) / (3 - 1 + 2))


def test_crosstab_margin(risk_input):
    rows = {r.category: r for r in risk.label_crosstab(risk_input, "category", "label").collect()}
    assert (rows["A"].label_1, rows["A"].label_0, rows["_count_"].n_all) == (2, 1, 10)


def test_impute(spark):
    df = spark.createDataFrame(
        [(25.0, 60000.0), (None, 70000.0), (35.0, None), (40.0, 80000.0), (None, 90000.0)], "age double, income double"
    )
    fitted = {r["var"]: r["value"] for r in impute.impute_fit(df, {"age": "mean", "income": "median"}).collect()}
    assert fitted == pytest.approx({"age": 100 / 3, "income": 75000.0})
    given = impute.impute_fit(df, {"age": "mean"}, {"age": 30.0, "income": 50000.0})
    filled = impute.impute_apply(df, given, ["age", "income"])
    assert filled.filter("age = 30").count() == 2 and filled.filter("income = 50000").count() == 1
    mode = impute.impute_fit(spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,), (9.0,)], "x double"), {"x": "mode"})
    assert mode.first()["value"] == 1.0
    with pytest.raises(ValueError):
        impute.impute_apply(df, given, ["other"])


@pytest.fixture(scope="module")
def bin_input(spark):
    values = [float(i) for i in range(1, 11)] + [10.0, None, 100.0]
    return spark.createDataFrame([(v,) for v in values], "value double")


def test_bins_out_of_range(spark, bin_input):
    fitted = binning.equal_width_edges(bin_input, ["value"], 3)
    probe = spark.createDataFrame([(-100.0,), (1000.0,), (None,)], "value double")
    got = [r.b for r in binning.bin_apply(probe, fitted, "value", "b").collect()]
    assert got == ["Bin_0", "Bin_2", None]
    marked = binning.bin_apply(probe, fitted, "value", "b", missing="Missing", out_of_range="OutOfRange")
    assert [r.b for r in marked.collect()] == ["OutOfRange", "OutOfRange", "Missing"]
    bare = binning.bin_apply(probe, fitted, "value", "b", labels=False)
    assert [r.b for r in bare.collect()] == [None, None, None]


def test_single_value_and_empty_edges(spark):
    same = spark.createDataFrame([(5.0,)] * 10, "value double")
    assert binning.equal_width_edges(same, ["value"], 3).first().edges == pytest.approx([4.999995, 5.000005])
    empty = spark.createDataFrame([(None,)] * 3, "value double")
    row = binning.equal_width_edges(empty, ["value"], 3).first()
    assert row.n_bins == 1 and row.edges == [float("-inf"), float("inf")]
    assert binning.quantile_edges(same, ["value"], 4).first().edges == [float("-inf"), float("inf")]


def test_quantile_edges_interpolate(spark):
    import numpy as np

    values = [float(v) for v in np.random.default_rng(3).integers(0, 50, 301)] + [0.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    edges = binning.quantile_edges(df, ["x"], 10).first().edges
    assert edges == pytest.approx(sorted(set(np.quantile(values, np.linspace(0, 1, 11)))))


def test_label_clean(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "y string")
    assert sorted(r.y for r in quality.label_clean(df, "y").collect()) == [0, 1, 1]
    numeric = spark.createDataFrame([(1.0,), (float("nan"),), (0.0,)], "y double")
    assert sorted(r.y for r in quality.label_clean(numeric, "y").collect()) == [0, 1]
    with pytest.raises(ValueError):
        quality.label_clean(df, "missing")


def test_roles(spark):
    df = spark.createDataFrame([("hi", "1", "x", "2"), (None, None, "y", "NaN")], "dialogue string, label string, cat string, n string")
    roles = quality.RoleSpec(label="label", categorical=("dialogue", "cat"), numeric=("n",))
    filled = quality.fill_missing_by_role(df, roles).collect()
    assert [tuple(r) for r in filled] == [("hi", 1, "x", 2.0), ("None", 0, "y", -1.0)]


def test_feature_quality_rejects(spark):
    df = spark.createDataFrame([(1.0, None), (float("inf"), 2.0)], "a double, b double")
    assert {r.feature: (r.nulls, r.infs) for r in quality.feature_quality(df, ["a", "b"]).collect()} == {"a": (0, 1), "b": (1, 0)}
    with pytest.raises(ValueError):
        quality.reject_bad_features(df, ["a"])


def test_currency(spark):
    df = spark.createDataFrame([(1, "1.9", None, 10.0), (2, "7", "EUR", 10.0), (3, None, None, 5.0), (4, "x", None, 3.0)],
                               "id int, market string, cur string, amount double")
    markets = lookup.local_table(spark, [(1, "CAD")], "key long, currency_code string")
    rates = lookup.local_table(spark, [("CAD", 2.0), ("EUR", 0.5)], "key string, rate double")
    out = currency.currency_convert(df, "market", ["amount", "absent"], markets, rates, currency="cur")
    got = {r.id: (r.cur, r.amount) for r in out.collect()}
    assert got == {1: ("CAD", 5.0), 2: ("EUR", 20.0), 4: ("USD", 3.0)}


def test_multiclass_codes(spark):
    df = spark.createDataFrame([(1, "x"), (2, "z"), (3, "y"), (4, "z")], "id int, v string")
    known = lookup.local_table(spark, [("x", 0)], "key string, code long")
    codes = encode.first_seen_codes(df, "v", "id", known)
    assert {r.key: r.code for r in codes.collect()} == {"x": 0, "z": 1, "y": 2}
    with pytest.raises(Exception, match="unknown label"):
        encode.multiclass_encode(df, "v", known, "c").collect()
    assert one(df, encode.one_hot(F.lit(1), 2)) == [0.0, 1.0]


# ---- text


def test_text_functions(text_row):
    t = F.col("t")
    assert one(text_row("   HeLLo    WOrld!   "), tx.text_normalize(t)) == "hello world!"
    assert one(text_row("Hello 😊! How are you? 🚀"), tx.emoji_remove(t)).strip() == "Hello ! How are you?"
    html = "<html><body><p>Hello <b>World!</b></p><script>x()</script><!-- no --></body></html>"
    assert one(text_row(html), tx.html_to_text(t)) == "Hello World!"
    assert one(text_row("<div>a<br/>b &amp; c</div>"), tx.html_clean_rules(t)) == "a\nb & c"
    assert one(text_row("no tags &amp; <b>x</b>"), tx.html_clean_rules(t)) == "no tags &amp; <b>x</b>"
    assert one(text_row("ok !!  now"), tx.text_regex_rules(t)) == "ok! now."
    assert one(text_row("it ended. The next. and"), tx.sentence_split(t)) == ["it ended.", "The next. and"]
    assert one(text_row("Dear John,\nplease send it\nKind regards\n"), tx.greeting_farewell_strip(t)) == "please send it"


def test_status_mail_is_cut(text_row):
    body = "<div>" + "Status do seu pedido<br>" * 12 + "x" * 1000 + "</div>"
    assert one(text_row(body), tx.html_clean_rules(F.col("t"))) == "\n".join(["Status do seu pedido"] * 10)


def test_template_and_quotation(text_row):
    mail = "Order Number: 12\nx Details: broken"
    assert one(text_row(mail), tx.template_strip(F.col("t"), F.lit("en"), "Shop")) == "Details: broken"
    notice = "Request received: x\nmore Sincerely,\nShop team"
    assert one(text_row("Body " + notice), tx.template_strip(F.col("t"), F.lit("en"), "Shop")) == "Body "
    assert one(text_row("hi\n> old"), tx.quotation_cut(F.col("t"))) == "hi"
    assert one(text_row("fine. On Monday A wrote: x"), tx.quotation_cut(F.col("t"))) == "fine. "
    assert one(text_row("nothing quoted"), tx.quotation_cut(F.col("t"))) == "nothing quoted"


@pytest.mark.parametrize(
    "lang, mail, left",
    [
        ("ja", "本文 返品リクエストの送信日: 5月1日 敬具 今後ともShopをよろしくお願いいたします。 Shop", "本文 "),
        ("ja", "出品者 山田 からのメッセージ： こんにちは", "こんにちは"),
        ("ja", "このメールは、出品者様および購入者様の両方にお送りしております。 Shopよりお知らせいたします。以下の商品について返品が依頼されました。 靴 返品理由: 小さい", "返品理由: 小さい"),
        ("ja", "はい 購入者様へのご連絡は、直接こちらのメールにご返信いただくか、以下セラーアカウントからご返信ください。 a 今後ともShop をよろしくお願いいたします", "はい "),
        ("en", "Dear Ann and Bob, This note has been sent by Shop to inform you and confirm that Ann has cancelled the refund request for the following order 7 Return reason: late", "Return reason: late"),
        ("fr", "Chers A et B, Cet e-mail vous est envoyé par Shop pour vous faire part du fait que A a annulé sa demande de retour pour la commande suivante 7 Raison du retour: x", "Raison du retour: x"),
        ("tr", "Sayın A ve B, Bu not, A adlı alıcının aşağıdaki siparişle ilgili iade talebini iptal ettiğine dair sizi bilgilendirmek ve bunu teyit etmek üzere Shop tarafından gönderilmiştir 7 İade nedeni: x", "İade nedeni: x"),
        ("de", "本文 返品リクエストの送信日: 今後ともShopをよろしくお願いいたします。", "本文 返品リクエストの送信日: 今後ともShopをよろしくお願いいたします。"),
    ],
)
def test_mail_templates(spark, lang, mail, left):
    df = spark.createDataFrame([(mail, lang)], "t string, lang string")
    assert df.select(tx.template_strip(F.col("t"), F.col("lang"), "Shop")).first()[0] == left


def test_dialogue_split(text_row):
    raw = "[bom]   Hello   [eom][bom]   [eom][bom]World[eom]"
    assert one(text_row(raw), dg.dialogue_split(F.col("t"))) == ["Hello", "World"]
    assert one(text_row(None), dg.dialogue_split(F.col("t"))) == []


def test_dialogue_chunk(spark):
    df = spark.createDataFrame([(["a b", "c d e", "f", "g h i j", "k"],), ([],), (["a b c d e f g", "h"],)], "m array<string>")
    got = [r.r for r in df.select(dg.dialogue_chunk(F.col("m"), 5).alias("r")).collect()]
    assert got == [["a b c d e", "f g h i j", "k"], ["."], ["a b c d e f g", "h"]]
    cut = df.select(dg.dialogue_chunk(F.col("m"), 5, truncate=True, max_total_chunks=2).alias("r")).first().r
    assert cut == ["a b c d e", "f g h i j"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        (
            "[bot]:Hello there[bot]:How can I help?[customer]:I need help[agent]:I'm here to assist",
            [("bot", "Hello there"), ("bot", "How can I help?"), ("customer", "I need help"), ("agent", "I'm here to assist")],
        ),
        ("[BOT]:x[Customer]:y", []),
        ("[bot:bad[customer]:ok[agent]bad", [("customer", "ok[agent]bad")]),
        ("[bot]:[customer]:Real message[agent]:", [("customer", "Real message")]),
        (None, []),
    ],
)
def test_chat_split(text_row, raw, expected):
    assert [tuple(x) for x in one(text_row(raw), dg.chat_split(F.col("t")))] == expected


def test_shipments(text_row):
    raw = (
        "[bom] [Shipment ID]: S1 [eom] [bom] left [eom] [bom] End of Ship Track Event for S1 [eom]"
        "[bom] [Shipment ID]: S2 [eom][bom] [Shipment ID]: S3 [eom] [bom] in [eom][bom] out [eom]"
        "[bom] End of Ship Track Event for S3 [eom][bom] ignored [eom]"
    )
    got = [(s.shipment_id, s.events) for s in one(text_row(raw), dg.shipment_events(F.col("t")))]
    assert got == [("S1", ["left"]), ("S3", ["in", "out"])]
    bare = one(text_row("[bom] a [eom][bom] b [eom]"), dg.shipment_events(F.col("t")))
    assert [(s.shipment_id, s.events) for s in bare] == [("Unknown", ["a", "b"])]
    assert one(text_row(""), dg.shipment_events(F.col("t"))) == []


# ---- responses

RESPONSE = """1. Category: TrueDNR

2. Confidence Score: 0.95

3. Key Evidence:
   * Message Evidence:
     [sep] one
     [sep] two
   * Shipping Evidence:
     [sep] s1
     [sep] s2
   * Timeline Evidence:
     [sep] t1

4. Reasoning:
   * Primary Factors:
     [sep] p
   * Supporting Evidence:
     [sep] q
   * Contradicting Evidence:
     [sep] None"""


def test_parse_response(text_row):
    r = rs.parse_response(text_row(RESPONSE), "t").first()
    assert (r.category, r.confidence_score, r.error) == ("TrueDNR", 0.95, None)
    assert (r.message_evidence, r.shipping_evidence, r.timeline_evidence) == (["one", "two"], ["s1", "s2"], ["t1"])
    assert (r.primary_factors, r.supporting_evidence, r.contradicting_evidence) == (["p"], ["q"], ["None"])
    assert rs.parse_response(text_row(""), "t").first().category == "Error"
    partial = rs.parse_response(text_row("no idea"), "t").first()
    assert partial.category == "Unknown" and partial.error.startswith("Partial parse only")
    for text, score in (("Confidence Score: 1.0", 1.0), ("Confidence Score: 1.5", 0.0), ("Confidence Score: .7", 0.7)):
        assert one(text_row(text), rs.response_confidence(F.col("t"))) == score


def test_report_round_trip(spark):
    df = spark.createDataFrame([(["[sep] one", "[sep] two"],)], "e array<string>")
    none = F.array().cast("array<string>")
    text = rs.format_analysis(F.lit("TrueDNR"), F.lit(0.955), [F.col("e"), none, none, F.col("e"), none, none])
    report = one(df, text)
    assert report.startswith("1. Category: TrueDNR\n\n2. Confidence Score: 0.95\n\n3. Key Evidence:\n   * Message Evidence:\n     [sep] one")
    assert report.endswith("   * Contradicting Evidence:\n     [sep] None")
    back = rs.parse_response(spark.createDataFrame([(report,)], "t string"), "t").first()
    assert back.message_evidence == ["one", "two"] and back.shipping_evidence == []


def test_evidence_lists(text_row, spark):
    t = F.col("t")
    assert one(text_row("['a', 'b']"), rs.evidence_list(t)) == ["a", "b"]
    assert one(text_row("plain"), rs.evidence_list(t)) == ["plain"]
    assert one(text_row("nan"), rs.evidence_list(t)) == []
    df = spark.createDataFrame([(["[sep] x", "[sep] None", "None", "", "y"],)], "e array<string>")
    assert one(df, rs.evidence_unprefix(F.col("e"))) == ["x", "y"]


def test_json_response(text_row):
    good = 'text {"category": "TrueDNR", "confidence_score": 0.9} end'
    assert one(text_row(good), rs.json_response(F.col("t"))).category == "TrueDNR"
    assert one(text_row("{bad"), rs.json_response(F.col("t"))) is None
    assert one(text_row("none"), rs.json_response(F.col("t"))) is None


def test_keyword_rules(text_row):
    t = F.col("t")
    assert one(text_row("It was LATE"), rs.keyword_fallback_v1(t)).category == "Confirmed_Delay"
    assert one(text_row("never received"), rs.keyword_fallback_v2(t)).category == "PDA_Undeliverable"
    assert one(text_row("delivered but never received"), rs.keyword_fallback_v2(t)).category == "TrueDNR"
    assert one(text_row("xyz"), rs.keyword_fallback_v2(t)).confidence_score == 0.5


def test_labelling_retries_and_errors(spark):
    df = spark.createDataFrame([(0, "a"), (1, "bad"), (2, "slow")], "id int, t string").coalesce(1)
    calls = {"n": 0}

    def labeller(case):
        if case["t"] == "bad":
            raise ValueError("broken")
        if case["t"] == "slow":
            calls["n"] += 1
            if calls["n"] < 3:
                raise labelling.Throttled("wait")
        return {"category": "TrueDNR", "confidence_score": 0.9}

    rows = labelling.label_cases(df, labeller, pause=lambda s: None).orderBy("id").collect()
    assert [(r.category, r.processing_status) for r in rows] == [
        ("TrueDNR", "success"), ("Insufficient_Information", "error"), ("TrueDNR", "success"),
    ]
    done = spark.createDataFrame([(0,)], "id int")
    left = lookup.resume_pending(df, done, "id")
    assert sorted(r.id for r in left.collect()) == [1, 2]


@pytest.mark.parametrize("in_flight", [1, 3])
def test_resume_labels_only_the_rest(spark, in_flight):
    df = spark.createDataFrame([(i, "en") for i in range(9)], "id int, lang string")
    done = spark.createDataFrame([(i, "en", "Old", 0.5, "success", None) for i in range(4)], T.StructType([*df.schema.fields, *labelling.RESULT.fields]))
    out = labelling.label_pending(df, done, ["id", "lang"], lambda case: {"category": f"New{case['id']}", "confidence_score": 1}, in_flight=in_flight)
    assert {r.id: r.category for r in out.collect()} == {i: "Old" if i < 4 else f"New{i}" for i in range(9)}
    assert labelling.error_rate(out).first()[0] == 0.0


@pytest.mark.parametrize(
    "text, masked",
    [
        ("see https://a.com/x(1) now", "see URL now"),
        ("(see www.shop.org/a(b(c))d).", "(see URL)."),
        ("https://a.com/x(1", "URL(DECIMAL"),
        ("a https://" + "." * 5000, "a https://" + "." * 5000),
        ("mail to a.b-c@shop.example.com", "mail to a.EMAIL"),
        ("track 9102, or 9612345678901234567890", "track TRACKING_ID, or TRACKING_ID"),
        ("9812345678 1234 5678 and 9812 1234 1234 123", "TRACKING_ID and TRACKING_ID"),
        ("RA123456785CN by 12 345 678 90", "TRACKING_ID by TRACKING_ID"),
        ("1Z 999 AA1 01 2345 678 4", "TRACKING_ID"),
        ("order 123-1234567-1234567", "order ORDER_ID"),
        ("up 25.5 bps to 7", "up DECIMAL to DECIMAL"),
        ("pay $12.50 or 20%", "pay DOLLAR_AMOUNT or PERCENTAGE"),
        ("in New Orleans, Louisiana 70112-1234.", "in ADDRESS."),
        ("12 Main street", "STREET"),
        ("at 12 One Two Three Four Five Six Seven Street now", "at STREET now"),
        ("Springfield, il 62704", "ADDRESS"),
        ("12 words and no kind of it", "DECIMAL words and no kind of it"),
        ("at TX 75001, or 90210", "at STATE_ZIP, or ZIP"),
        ("on 12/31/2020 at 10:30 pm", "on DATE at TIME"),
        ("Monday, March 3", "WEEKDAY, MON_DAY"),
        ("call (206) 555-0100", "call PHONE"),
    ],
)
def test_entity_mask(spark, text, masked):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(entities.entity_mask(F.col("t"))).first()[0] == masked


@pytest.mark.parametrize(
    "text, masked",
    [
        ("Sat in Texas for fifty dollars by WWW.shop.org/a from a@b.co", "WEEKDAY in STATE for DOLLAR_AMOUNT by URL from EMAIL"),
        ("ABCDEFGHIJ or no entity", "ASIN or no entity"),
        ("K1234567890 RA 123 456 789 CN xx99US", "TRACKING_ID TRACKING_ID TRACKING_ID"),
        (None, None),
    ],
)
def test_entities_are_sought_only_where_they_can_be(spark, text, masked):
    """Kinds made of digits are sought only in texts with a digit, and from no letter that cannot begin one."""
    df = spark.createDataFrame([(text,)], "t string")
    t = F.col("t")
    assert df.select(entities.entity_mask(t)).first()[0] == masked
    for name in ("TIME", "ZIP", "TRACKING_ID", "DECIMAL"):
        assert str(entities.entity_count(t, name)._jc).startswith("CASE WHEN regexp_like(t, '[0-9]')")
    count = df.select(entities.entity_count(t, "TRACKING_ID"), entities.entity_count(t, "URL")).first()
    assert tuple(count) == ((None, None) if text is None else (masked.count("TRACKING_ID"), masked.count("URL")))


def test_embed_as_written_without_padding(spark):
    df = spark.createDataFrame([(1, "Big  box"), (2, ""), (3, None)], "k int, t string")
    vectors = spark.createDataFrame([("Big", [1.0, 2.0]), ("big", [9.0, 9.0])], "token string, vector array<float>")
    out = {r.k: (r.embeddings, r["mask"]) for r in tokens.embed_tokens(df, "k", "t", vectors, 2, 5, pad=False, lower=False).collect()}
    assert out == {1: ([[1.0, 2.0], [0.0, 0.0]], [1, 0]), 2: ([], []), 3: ([], [])}
    padded = {r.k: r["mask"] for r in tokens.embed_tokens(df, "k", "t", vectors, 2, 3).collect()}
    assert padded == {1: [1, 0, 0], 2: [0, 0, 0], 3: [0, 0, 0]}


def test_pad_chunks(spark):
    df = spark.createDataFrame([(1, [[1], [2, 3]]), (2, [[4, 5, 6]])], "k int, ids array<array<int>>")
    out = {r.k: r.ids for r in tokens.pad_chunks(df, "ids", F.lit(0)).collect()}
    assert out == {1: [[1, 0, 0], [2, 3, 0]], 2: [[4, 5, 6], [0, 0, 0]]}


def test_combined_label(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (2, 0), (2, 1), (None, 0), (2, None)], "a int, b int")
    got = [r[0] for r in df.select(labelling.combined_label(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 1.0, 1.0, 2.0, 1.0, None, None]


def test_sketched_edges_are_near_the_ranks(spark):
    df = spark.range(10000).select(F.col("id").cast("double").alias("v"), F.lit(None).cast("double").alias("e"))
    rows = {r["var"]: r.edges for r in binning.approximate_quantile_edges(df, ["v", "e"], 10, k=1000).collect()}
    assert len(rows["v"]) == 11 and all(abs(e - 1000 * i) <= 10000 / 1000 for i, e in enumerate(rows["v"]))


# ---- numbers and formats


@pytest.mark.parametrize("x", [0.62645, 0.00005, 0.12345, 0.5, 0.99995, 2.5e-5, 0.00015, 1.0, 0.0, 123.45675, -0.62645])
def test_fixed_text(spark, x):
    df = spark.createDataFrame([(x,)], "x double")
    assert one(df, numbers.fixed_text(F.col("x"), 4)).replace("-0.0000", "0.0000") == f"{x:.4f}".replace("-0.0000", "0.0000")
    assert one(df, numbers.exact_round(F.col("x"), 4)) == pytest.approx(round(x, 4), abs=1e-15)


def test_fixed_text_is_short_enough_to_compile(spark):
    """One score's text: a Java method of over 8,000 bytes is never compiled, and each row then costs ten times as much."""
    text = str(numbers.fixed_text(F.element_at("scores", 2), 4)._jc)
    assert text.count("element_at") < 15
    values = [0.62645, 0.00005, 0.03125, 2.0**39 + 0.00005, -965994830239.7389, 984903112723.6271]
    df = spark.createDataFrame([([0.0, x],) for x in values], "scores array<double>")
    assert [r[0] for r in df.select(numbers.fixed_text(F.element_at("scores", 2), 4)).collect()] == [f"{x:.4f}" for x in values]


def test_request_lines(spark):
    """One-line bodies are not split; the others are, and their empty lines dropped."""
    bodies = [(0, "1,a", "text/csv"), (1, " 1,a\r\n \n2,b ", "text/csv"), (2, "[1", "application/json"), (3, '[{"n":1},{"n":2}]', "application/json"),
              (4, " ", "text/csv"), (5, "1,a", None), (6, None, "application/json"), (7, "[]", "application/json"), (8, "\n", "text/csv")]
    df = spark.createDataFrame(bodies, "k int, body string, media string")
    out = readers.parse_request_records(df, "body", "media", "k", "n int, s string")
    plan_text = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan_text.count("split(") == 1
    bad, none, kind = "invalid record", "empty input", "unsupported content type"
    assert sorted((r.k, r.pos, r.n, r.error) for r in out.collect()) == [
        (0, 0, 1, None), (1, 0, 1, None), (1, 1, 2, None), (2, 0, None, bad), (3, 0, 1, None), (3, 1, 2, None),
        (4, 0, None, none), (5, 0, None, kind), (6, 0, None, none), (7, 0, None, none), (8, 0, None, none),
    ]



@pytest.mark.parametrize("x", [0.7, 0.00012, 0.00001234, 1e-05, 1.0, 0.0, 0.001, 0.1 + 0.2])
def test_number_text(spark, x):
    assert one(spark.createDataFrame([(x,)], "x double"), numbers.number_text(F.col("x"))) == str(x)


def test_prediction_records(spark):
    df = spark.createDataFrame([([0.3, 0.7], [0.25, 0.75]), ([0.5, 0.5], [0.5])], "raw array<double>, cal array<double>")
    raw, cal = F.col("raw"), F.col("cal")
    rows = df.select(formats.prediction_json(raw, cal, 2).alias("j"), formats.prediction_csv(raw, cal, 2).alias("c")).collect()
    assert rows[0].j == '{"legacy-score":"0.7","calibrated-score":"0.75","custom-output-label":"class-1"}'
    assert rows[0].c == "0.7000,0.7500,class-1"
    assert rows[1].c == "0.5000,0.5000,class-0"
    three = spark.createDataFrame([([0.2, 0.3, 0.5],)], "p array<double>")
    assert one(three, formats.text_prediction_csv(F.col("p"), 3)) == "0.2000,0.3000,0.5000,class-2"
    assert '"prob_02":"0.3"' in one(three, formats.prediction_json(F.col("p"), F.col("p"), 3))


# ---- metrics


def test_auc_examples(spark):
    a = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.6, 1), (0.8, 1)], "p double, y int")
    assert curves.auc_roc(a, "p", "y").first().auc == 1.0
    ties = spark.createDataFrame([(0.5, 0), (0.5, 1)], "p double, y int")
    assert curves.auc_roc(ties, "p", "y").first().auc == 0.5


def test_auc_matches_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(5000).select((F.rand(1) > 0.7).cast("double").alias("y"), F.round(F.rand(2), 2).alias("p"))
    df = df.withColumn("p", F.col("p") + F.col("y") * 0.2).persist()
    ours = curves.auc_roc(df, "p", "y").first().auc
    theirs = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(df)
    assert ours == pytest.approx(theirs)


def test_curves_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    seg = rng.integers(0, 3, 400)
    df = spark.createDataFrame([(int(s), float(a), int(b)) for s, a, b in zip(seg, p, y)], "seg int, p double, y int")
    got = {(r.seg, round(r.threshold, 2)): (r.fpr, r.tpr) for r in curves.roc_curve(df, "p", "y", ["seg"]).collect()}
    for s in range(3):
        ys, ps = y[seg == s], p[seg == s]
        for t in set(ps):
            hit = ps >= t
            assert got[(s, round(float(t), 2))] == pytest.approx(
                ((hit & (ys == 0)).sum() / (ys == 0).sum(), (hit & (ys == 1)).sum() / (ys == 1).sum())
            )


def test_kl(spark):
    df = spark.createDataFrame([([0.9, 0.1], [0.8, 0.2]), ([0.6, 0.4], [0.5, 0.5])], "p array<double>, q array<double>")
    got = df.agg(F.avg(metrics.kl_divergence(F.col("p"), F.col("q")))).first()[0]
    want = [sum(a * math.log(a / b) for a, b in zip(p, q)) for p, q in (([0.9, 0.1], [0.8, 0.2]), ([0.6, 0.4], [0.5, 0.5]))]
    assert got == pytest.approx(sum(want) / 2)


def test_confusion_without_positives(spark):
    df = spark.createDataFrame([(0.1, 0)], "p double, y int")
    got = {r.metric: r.value for r in metrics.confusion_metrics(df, "p", "y").collect()}
    assert got["accuracy"] == 1.0 and got["precision"] == 0.0 and got["f1_score"] == 0.0


# ---- calibration


@pytest.fixture(scope="module")
def scores(spark):
    df = spark.range(4000).select(F.round(F.rand(3), 2).alias("p"), F.rand(4).alias("u"))
    return df.select("p", (F.col("u") < F.col("p") * F.col("p")).cast("int").alias("y")).persist()


def test_isotonic_is_monotone_and_keeps_the_mean(scores):
    out = calibrate.isotonic_fit(scores, "p", "y").apply(scores, "p", "c")
    m = out.agg(F.avg("c").alias("c"), F.avg("y").alias("y")).first()
    assert m.c == pytest.approx(m.y)
    values = [r.c for r in out.groupBy("p").agg(F.first("c").alias("c")).orderBy("p").collect()]
    assert values == sorted(values)


@pytest.mark.parametrize("method", ["isotonic", "platt", "gam"])
def test_calibration_reduces_error(scores, method):
    fit = calibrate.fit_calibrator(scores, "p", "y", method)
    out = fit.apply(scores, "p", "c")
    before = calibrate.ece_mce_brier(scores, "p", "y").first()
    after = calibrate.ece_mce_brier(out, "c", "y").first()
    assert after.ece < before.ece and after.brier < before.brier


def test_gam_is_monotone(scores):
    out = calibrate.gam_fit(scores, "p", "y").apply(scores, "p", "c")
    values = [r.c for r in out.groupBy("p").agg(F.first("c").alias("c")).orderBy("p").collect()]
    assert all(b >= a - 1e-12 for a, b in zip(values, values[1:]))


def test_multiclass_calibration_normalises(spark):
    df = spark.range(600).select(
        (F.col("id") % 3).cast("int").alias("y"),
        F.array(F.rand(1), F.rand(2), F.rand(3)).alias("probs"),
    ).persist()
    fits = calibrate.multiclass_calibrate_fit(df, "probs", "y", 3)
    out = calibrate.multiclass_calibrate_apply(df, "probs", [fits[0], None, fits[2]], "c")
    assert out.agg(F.max(F.abs(F.col("c")[0] + F.col("c")[1] + F.col("c")[2] - 1))).first()[0] < 1e-9


def test_chain(spark):
    df = spark.createDataFrame([(" A ",)], "t string")
    both = chain(lambda d: d.withColumn("n", F.lit(1)), lambda d: d.withColumn("m", F.col("n") + 1))(df)
    assert both.first().m == 2
    out = column_chains(df, {"t": [tx.text_normalize]}, drop=["t"])
    assert out.columns == ["t_processed"] and out.first()[0] == "a"
