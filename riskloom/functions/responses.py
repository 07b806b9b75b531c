"""Labelling responses: parse text or JSON answers, fall back to keywords, format reports, fill prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions import fixed_values as fv
from riskloom.functions.numbers import fixed_text
from riskloom.functions.text import strip
from riskloom.plans.lookup import local_table

SEP = "[sep]"
JSON_SCHEMA = (
    "category string, confidence_score double, "
    "key_evidence struct<message_evidence: array<string>, shipping_evidence: array<string>, "
    "timeline_evidence: array<string>>, "
    "reasoning struct<primary_factors: array<string>, supporting_evidence: array<string>, "
    "contradicting_evidence: array<string>>"
)
FIELDS = tuple(s.lower().replace(" ", "_") for s in fv.EVIDENCE_SECTIONS)


def response_category(c: Column) -> Column:
    found = F.regexp_extract(c, r"Category:\s*([A-Za-z_]+(?:\s*\([^)]*\))?)", 1)
    return F.when(found == "", "Unknown").otherwise(found)


def response_confidence(c: Column) -> Column:
    found = F.regexp_extract(c, r"Confidence Score:\s*(0?\.\d+|1\.00?)", 1)
    return F.when(found == "", 0.0).otherwise(found.cast("double"))


def response_evidence(c: Column, section: str) -> Column:
    """Items of ``* <section>:`` up to the next section, numbered heading or the end."""
    body = F.regexp_extract(c, rf"(?s)(\* {section}:.*?)(?:\n\s*\* |\n\d\.|\z)", 1)
    after = F.split(body, r"\[sep\]")
    items = F.transform(F.slice(after, 2, F.greatest(F.size(after) - 1, F.lit(0))), _one_item)
    return F.filter(items, lambda x: x != "")


def _one_item(x: Column) -> Column:
    return strip(F.element_at(F.split(x, r"\n\s*\*"), 1))


def parse_response(df: DataFrame, response: str) -> DataFrame:
    """Add category, confidence_score, the six evidence lists and an error text."""
    c = F.col(response)
    empty = c.isNull() | (c == "")
    category, confidence = response_category(c), response_confidence(c)
    no_category = category == "Unknown"
    partial = no_category & (confidence == 0.0)
    error = (
        F.when(empty, "Invalid or empty response")
        .when(partial, "Partial parse only: Missing required fields: category and confidence score")
        .when(no_category, "Missing category in response")
    )
    none = F.array().cast("array<string>")
    lists = {
        field: F.when(empty | partial, none).otherwise(response_evidence(c, section))
        for field, section in zip(FIELDS, fv.EVIDENCE_SECTIONS)
    }
    return df.withColumns(
        {
            "category": F.when(empty, "Error").otherwise(category),
            "confidence_score": F.when(empty, 0.0).otherwise(confidence),
            **lists,
            "error": error,
        }
    )


def json_response(c: Column) -> Column:
    """Typed struct of the text from the first ``{`` to the last ``}``; NULL if there is none or it is broken."""
    body = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.nullif(body, F.lit("")), JSON_SCHEMA)
    return F.when(parsed["category"].isNotNull(), parsed)


def _has(text: Column, *words: str) -> Column:
    hit = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        hit = hit | F.contains(text, F.lit(w))
    return hit


# fixed values: ordered keyword rules (any of the words), category and confidence
KEYWORD_RULES_V1 = (
    (("never received", "not delivered"), "TrueDNR", 0.6),
    (("late", "delayed"), "Confirmed_Delay", 0.6),
    (("damaged", "defective"), "Buyer_Received_WrongORDefective_Item", 0.6),
    (("cancel",), "BuyerCancellation", 0.6),
)


def _decide(rules: Sequence[tuple[Column, str, float]]) -> Column:
    def answer(category: str, confidence: float) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence_score"))

    first, *rest = rules
    out = F.when(first[0], answer(*first[1:]))
    for cond, category, confidence in rest:
        out = out.when(cond, answer(category, confidence))
    return out.otherwise(answer("Insufficient_Information", 0.5))


def keyword_fallback_v1(c: Column) -> Column:
    text = F.lower(c)
    return _decide([(_has(text, *words), cat, conf) for words, cat, conf in KEYWORD_RULES_V1])


def keyword_fallback_v2(c: Column) -> Column:
    """The longer decision list: information requests, refund-only cases, returns."""
    t = F.lower(c)
    undelivered = _has(t, "never received", "not delivered")
    return _decide(
        [
            (
                _has(t, "invoice", "receipt", "specification", "instruction", "troubleshoot"),
                "Product_Information_Support",
                0.6,
            ),
            (_has(t, "early refund") | (_has(t, "refund") & _has(t, "before delivery")), "PDA_Early_Refund", 0.7),
            (undelivered & _has(t, "delivered"), "TrueDNR", 0.6),
            (undelivered, "PDA_Undeliverable", 0.6),
            (_has(t, "late", "delayed"), "Confirmed_Delay", 0.6),
            (_has(t, "failed delivery", "delivery attempt"), "Delivery_Attempt_Failed", 0.6),
            (_has(t, "unable to ship", "out of stock"), "Seller_Unable_To_Ship", 0.6),
            (_has(t, "cancel") & _has(t, "before"), "BuyerCancellation", 0.6),
            (_has(t, "keep the item", "no need to return"), "Returnless_Refund", 0.7),
            (_has(t, "damaged", "defective", "wrong item"), "Buyer_Received_WrongORDefective_Item", 0.6),
            (_has(t, "no longer needed", "changed mind"), "Return_NoLongerNeeded", 0.6),
        ]
    )


def evidence_prefix(items: Column) -> Column:
    """Every item starts with ``[sep] ``."""
    mark = F.lit(f"{SEP} ")
    return F.transform(items, lambda x: F.when(x.startswith(f"{SEP} "), x).otherwise(F.concat(mark, x)))


def evidence_unprefix(items: Column) -> Column:
    """Items without the prefix; empty ones, ``None`` and marked stock phrases drop."""
    stock = [F.lit(s) for s in fv.STOCK_EVIDENCE]

    def clean(x: Column) -> Column:
        t = strip(x)
        bare = strip(F.substring(t, len(SEP) + 1, 1 << 30))
        marked = F.when(~F.array_contains(F.array(*stock), bare), bare)
        return F.when(t.startswith(SEP), marked).when(t != "None", t)

    cleaned = F.transform(F.coalesce(items, F.array().cast("array<string>")), clean)
    return F.filter(cleaned, lambda x: x.isNotNull() & (x != ""))


def evidence_list(text: Column) -> Column:
    """A stringified list (JSON quotes or single quotes) as an array; other text is one item."""
    t = strip(text)
    as_json = F.from_json(t, "array<string>")
    single = F.from_json(F.replace(t, F.lit("'"), F.lit('"')), "array<string>")
    listed = F.when(t.startswith("["), F.coalesce(as_json, single))
    missing = t.isNull() | (t == "") | (t == "nan")
    return F.when(missing, F.array().cast("array<string>")).otherwise(F.coalesce(listed, F.array(t)))


def format_analysis(category: Column, confidence: Column, evidence: Sequence[Column]) -> Column:
    """The fixed multi-line report; ``evidence`` holds the six lists in section order."""
    lists = list(evidence)
    none = F.array(F.lit(f"{SEP} None"))
    lists[5] = F.when(F.size(lists[5]) > 0, lists[5]).otherwise(none)

    def section(name: str, items: Column) -> list[Column]:
        lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("     "), x)), "\n")
        # concat_ws leaves out the NULL of an empty list
        return [F.lit(f"   * {name}:"), F.when(F.size(items) > 0, lines)]

    sections = [section(n, c) for n, c in zip(fv.EVIDENCE_SECTIONS, lists)]
    parts = [
        F.concat(F.lit("1. Category: "), category),
        F.lit(""),
        F.concat(F.lit("2. Confidence Score: "), fixed_text(confidence, 2)),
        F.lit(""),
        F.lit("3. Key Evidence:"),
        *sections[0], *sections[1], *sections[2],
        F.lit(""),
        F.lit("4. Reasoning:"),
        *sections[3], *sections[4], *sections[5],
    ]
    return F.concat_ws("\n", *parts)


def case_string_parse(c: Column) -> Column:
    """``{dialogue, shiptrack}`` of a case written as parts joined by `` | ``; the last of a kind counts."""
    parts = F.split(c, r" \| ")

    def part(prefix: str) -> Column:
        hits = F.filter(parts, lambda p: p.startswith(prefix))
        text = strip(F.replace(F.try_element_at(hits, F.lit(-1)), F.lit(prefix), F.lit("")))
        return F.coalesce(text, F.lit(""))

    return F.struct(part("Customer Dialogue:").alias("dialogue"), part("Shipping History:").alias("shiptrack"))


def reason_groups(spark: SparkSession) -> DataFrame:
    """The twelve categories with group, group name and risk level."""
    rows = [(code, *facts) for code, facts in fv.REASON_CODES.items()]
    return local_table(spark, rows, "category string, reason_group string, group_name string, risk_level string")


def reason_group(df: DataFrame, category: str = "category") -> DataFrame:
    groups = reason_groups(df.sparkSession).withColumnRenamed("category", "_c")
    return df.join(F.broadcast(groups), F.col(category) == F.col("_c"), "left").drop("_c")


def render_prompt(template: str, dialogue: Column, shiptrack: Column, date: Column) -> Column:
    """Fill ``{dialogue}``, ``{shiptrack}`` and ``{max_estimated_arrival_date}`` of a template."""
    known = F.when(date.isNull() | (date == ""), "Not provided").otherwise(date)
    out = F.lit(template)
    for name, value in (("shiptrack", shiptrack), ("max_estimated_arrival_date", known), ("dialogue", dialogue)):
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def category_summary(df: DataFrame, category: str = "category", confidence: str = "confidence_score") -> DataFrame:
    return df.groupBy(F.col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("avg_confidence")
    )


def run_summary(df: DataFrame, status: str = "processing_status") -> DataFrame:
    """One row: totals, successes, failures and the mean confidence of the successes."""
    ok = F.col(status) == "success"
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.avg(F.when(ok, F.col("confidence_score"))).alias("avg_confidence"),
    )
