"""Queries on text cleaning, dialogues, shipments, entities and labelling responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.features import sql_list
from riskloom.catalog.registry import query, rounded, table
from riskloom.functions import dialogue as dg, entities as en, fixed_values as fv, responses as rs, text as tx
from riskloom.operators import labelling, subwords as sw, tokens as tk
from riskloom.operators.chain import column_chains
from riskloom.operators.quality import unexpected_fields
from riskloom.plans.lookup import local_table, lookup_with_default
from riskloom.plans.partitions import spread
from riskloom.plans.staging import new_stage_path, stage


def texts(spark, sf, name):
    return spread(table(spark, sf, name))


def esc(pattern: str) -> str:
    return pattern.replace("'", "''")


S = esc(tx.SPACE)


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{S}+|{S}+\\z', '', 'g')"


def squeeze_sql(c: str) -> str:
    return f"regexp_replace({strip_sql(c)}, '{S}+', ' ', 'g')"


# ---- cleaning


@query("text_normalize", f"SELECT doc_id, md5(lower({squeeze_sql('text')})) AS h, length(lower({squeeze_sql('text')})) AS n FROM documents")
def text_normalize(spark, sf):
    c = tx.text_normalize(F.col("text"))
    return texts(spark, sf, "documents").select("doc_id", F.md5(c).alias("h"), F.length(c).cast("long").alias("n"))


@query("text_upper", f"SELECT conv_id, turn, upper(replace({squeeze_sql('text')}, 'ß', 'ss')) AS t FROM conversations")
def text_upper(spark, sf):
    return texts(spark, sf, "conversations").select("conv_id", "turn", tx.text_upper(F.col("text")).alias("t"))


EMOJI_TEXT_SQL = "replace(replace(text, 'é', 'é😀'), '. ', '✈ ㊗日本 ')"


def emoji_text():
    return F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("é😀")), F.lit(". "), F.lit("✈ ㊗日本 "))


@query(
    "emoji_remove",
    f"SELECT conv_id, turn, regexp_replace({EMOJI_TEXT_SQL}, '{tx.EMOJI}', '', 'g') AS t FROM conversations",
)
def emoji_remove(spark, sf):
    return texts(spark, sf, "conversations").select("conv_id", "turn", tx.emoji_remove(emoji_text()).alias("t"))


# text nodes by regular expressions: enough for the given pages, whose markup is regular
NODES_SQL = (
    "regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<template.*?</template>|<!--.*?-->|<[^>]+>', chr(1), 'g')"
)
for _entity, _char in (
    ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
):
    NODES_SQL = f"replace({NODES_SQL}, '{_entity}', '{_char}')"
PAGE_TEXT_SQL = f"array_to_string(list_filter(list_transform(string_split({NODES_SQL}, chr(1)), lambda x: {strip_sql('x')}), lambda x: x <> ''), ' ')"


@query("html_to_text", f"SELECT page_id, {PAGE_TEXT_SQL} AS t FROM pages")
def html_to_text(spark, sf):
    return texts(spark, sf, "pages").select("page_id", tx.html_to_text("html").alias("t"))


def html_rules_sql(c: str) -> str:
    out = c
    for pattern, repl in tx.HTML_RULES:
        value = "chr(10) || chr(10)" if repl == "\n\n" else "chr(10)" if repl == "\n" else f"'{repl}'"
        out = f"regexp_replace({out}, '{esc(pattern)}', {value}, 'g')"
    for entity, char in fv.HTML_ENTITIES:
        out = f"replace({out}, '{esc(entity)}', '{esc(char)}')"
    return strip_sql(f"regexp_replace({out}, 'https?://\\S{{50,}}', '[URL]', 'g')")


HAS_TAG_SQL = " OR ".join(f"contains(lower(html), '{t}')" for t in ("<html>", "<div>", "<span>", "<table>"))


@query(
    "html_clean_rules",
    f"SELECT page_id, CASE WHEN {HAS_TAG_SQL} THEN {html_rules_sql('html')} ELSE html END AS t FROM pages",
)
def html_clean_rules(spark, sf):
    return texts(spark, sf, "pages").select("page_id", tx.html_clean_rules(F.col("html")).alias("t"))


def rules_sql(c: str, rules) -> str:
    for pattern, repl in rules:
        c = f"regexp_replace({c}, '{esc(pattern)}', '{esc(repl)}', 'g')"
    return c


@query(
    "text_regex_rules",
    f"""SELECT doc_id, md5(t) AS h, CAST(length(t) AS BIGINT) AS n FROM
        (SELECT doc_id, {rules_sql('text', tx.PLAIN_RULES)} AS t FROM documents)""",
)
def text_regex_rules(spark, sf):
    c = tx.plain_rules(F.col("text"))
    return texts(spark, sf, "documents").select("doc_id", F.md5(c).alias("h"), F.length(c).cast("long").alias("n"))


def chained_sql(c: str, *rules: tuple[str, str]) -> str:
    for pattern, repl in rules:
        c = f"regexp_replace({c}, '{pattern}', '{repl}', 'g')"
    return c


# the rules with look-around, in a dialect without: neighbours are captured and put back, twice, as matches
# may share a neighbour, and a repeated mark is a rule per mark
MARKS_SQL = chained_sql(
    "t",
    *[(rf"{mark}{{2,}}", mark[-1]) for mark in (r"\.", ",", "!", r"\?", ":", ";")],
    *[(r"(\S)\s+([.,!?:;])", r"\1\2")] * 2,
    *[(r"([.,!?:;])(\S)", r"\1 \2")] * 2,
    (r"[.!?,:;_\s]+([.!?])", r"\1"),
)


@query(
    "text_regex_rules_full",
    f"""WITH plain AS (SELECT doc_id, {rules_sql('text', tx.PLAIN_RULES)} AS t FROM documents), marked AS (SELECT doc_id, {MARKS_SQL} AS t FROM plain)
    SELECT doc_id, t || CASE WHEN t = '' OR right(t, 1) IN ('.', '!', '?') THEN '' ELSE '.' END AS t FROM marked""",
)
def text_regex_rules_full(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", tx.text_regex_rules(F.col("text")).alias("t"))


SENTENCES_SQL = (
    "string_split(regexp_replace(text, '([a-z0-9][.?!]\"?)(?:\\r\\n|\\s)(\"?[A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
)


@query(
    "sentence_split",
    f"""SELECT doc_id, CAST(len({SENTENCES_SQL}) AS INTEGER) AS sentences,
      CAST(list_max(list_transform({SENTENCES_SQL}, lambda x: length(x))) AS INTEGER) AS longest FROM documents""",
)
def sentence_split(spark, sf):
    parts = texts(spark, sf, "documents").select("doc_id", tx.sentence_split(F.col("text")).alias("s"))
    return parts.select(
        "doc_id",
        F.size("s").alias("sentences"),
        F.aggregate("s", F.lit(0), lambda a, x: F.greatest(a, F.length(x))).alias("longest"),
    )


GREETED_SQL = "CASE lang WHEN 'en' THEN 'Dear Ann, ' WHEN 'fr' THEN 'Bonjour ' ELSE '' END || text || CASE lang WHEN 'de' THEN chr(10) || 'Viele Grüße' ELSE '' END"


@query(
    "greeting_farewell_strip",
    f"""SELECT doc_id, CAST(length(t) AS INTEGER) AS n, md5(t) AS h FROM (SELECT doc_id, {strip_sql(
        f"regexp_replace(regexp_replace({GREETED_SQL}, '{esc(tx.GREETING_LINE)}', '', 'g'), '{esc(tx.FAREWELL_LINE)}', '', 'g')"
    )} AS t FROM documents)""",
)
def greeting_farewell_strip(spark, sf):
    lang = F.col("lang")
    head = F.when(lang == "en", "Dear Ann, ").when(lang == "fr", "Bonjour ").otherwise("")
    tail = F.when(lang == "de", "\nViele Grüße").otherwise("")
    c = tx.greeting_farewell_strip(F.concat(head, F.col("text"), tail))
    return texts(spark, sf, "documents").select("doc_id", F.length(c).alias("n"), F.md5(c).alias("h"))


@query(
    "informative_tokens",
    f"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{S}+'), lambda t: t <> '' AND NOT list_contains(
        [{', '.join("'" + t + "'" for t in fv.NONINFORMATIVE_TOKENS)}], lower(t)))) AS INTEGER) AS n FROM documents""",
)
def informative_tokens(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.size(tx.informative_tokens(F.col("text"))).alias("n"))


# what stays of the planted mail parts, written by hand
@query(
    "template_strip",
    """WITH m AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'Details: ' WHEN 'fr' THEN 'Détails: ' ELSE '' END || text AS t FROM documents)
    SELECT doc_id, lang, CAST(length(t) AS INTEGER) AS n, md5(t) AS h FROM m""",
)
def template_strip(spark, sf):
    docs = texts(spark, sf, "documents")
    head = F.when(F.col("lang") == "en", "Order Number: 1\nDetails: ").when(F.col("lang") == "fr", "Numéro de commande: 1\nDétails: ")
    mail = F.concat(F.coalesce(head, F.lit("")), F.col("text"))
    c = tx.template_strip(mail, F.col("lang"), "Shop")
    return docs.select("doc_id", "lang", F.length(c).alias("n"), F.md5(c).alias("h"))


@query("quotation_cut", "SELECT conv_id, turn, text || ' ' AS t FROM conversations")
def quotation_cut(spark, sf):
    reply = F.concat(F.col("text"), F.lit(" -- Original Message -- "), F.col("role"))
    c = tx.removed_part_strip(tx.quotation_cut(reply))
    return texts(spark, sf, "conversations").select("conv_id", "turn", c.alias("t"))


# ---- entities

# the SQL dialect knows ASCII letters only in \b and \w, so other letters are folded to "_" there
FOLD_SQL = "regexp_replace(text, '[^\\x00-\\x7F\\PL]', '_', 'g')"
ENTITY_NAMES = tuple(name for name, _ in en.PATTERNS)


@query(
    "job_entity_scan",
    "SELECT source, lang, count(*) AS docs, "
    + ", ".join(
        f"CAST(sum(len(regexp_extract_all(t, '{esc(p)}'))) AS BIGINT) AS {n.lower()}" for n, p in en.PATTERNS
    )
    + f" FROM (SELECT *, {FOLD_SQL} AS t FROM documents) GROUP BY source, lang",
)
def job_entity_scan(spark, sf):
    counts = [F.sum(en.entity_count(F.col("text"), n)).alias(n.lower()) for n in ENTITY_NAMES]
    return texts(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), *counts)


@query(
    "entity_mask",
    f"SELECT doc_id, md5({rules_sql(FOLD_SQL, [(p, n) for n, p in en.PATTERNS])}) AS h FROM documents",
)
def entity_mask(spark, sf):
    folded = F.regexp_replace(en.entity_mask(F.col("text")), r"[^\x00-\x7F\PL]", "_")
    return texts(spark, sf, "documents").select("doc_id", F.md5(folded).alias("h"))


# ---- dialogues: every turn is one dialogue text, its lines are the messages

DIALOGUE_SQL = "'[bom] ' || replace(text, chr(10), ' [eom][bom]  ') || ' [eom][bom]   [eom]'"
MESSAGES_SQL = f"""
dlg AS (SELECT conv_id, turn, role, list_filter(list_transform(regexp_extract_all({DIALOGUE_SQL}, '(?s)\\[bom\\](.*?)\\[eom\\]', 1),
          lambda m: {strip_sql('m')}), lambda m: m <> '') AS msgs FROM conversations)"""


def dialogue_text():
    body = F.replace(F.col("text"), F.lit("\n"), F.lit(" [eom][bom]  "))
    return F.concat(F.lit("[bom] "), body, F.lit(" [eom][bom]   [eom]"))


def dialogues(spark, sf):
    return texts(spark, sf, "conversations").select("conv_id", "turn", "role", dg.dialogue_split(dialogue_text()).alias("msgs"))


@query(
    "dialogue_split",
    f"WITH {MESSAGES_SQL} SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, msgs[i] AS msg FROM (SELECT *, unnest(range(1, len(msgs) + 1)) AS i FROM dlg)",
)
def dialogue_split(spark, sf):
    return dialogues(spark, sf).select("conv_id", "turn", F.posexplode("msgs").alias("pos", "msg"))


def tokens_sql(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{S}+'), lambda w: w <> ''))"


def chunks_sql(max_tokens: int) -> str:
    return f"""
fold AS (SELECT conv_id, turn, list_reduce(list_transform(msgs, lambda m: {{'done': []::VARCHAR[], 'cur': m, 'tok': {tokens_sql('m')}}}),
    lambda a, x: {{'done': CASE WHEN a.tok + x.tok > {max_tokens} AND a.cur IS NOT NULL THEN list_append(a.done, {strip_sql('a.cur')}) ELSE a.done END,
                   'cur': CASE WHEN a.tok + x.tok > {max_tokens} OR a.cur IS NULL THEN x.cur ELSE a.cur || ' ' || x.cur END,
                   'tok': CASE WHEN a.tok + x.tok > {max_tokens} THEN x.tok ELSE a.tok + x.tok END}},
    {{'done': []::VARCHAR[], 'cur': NULL::VARCHAR, 'tok': 0::BIGINT}}) AS f FROM dlg),
chunks AS (SELECT conv_id, turn, CASE WHEN f.cur IS NULL THEN ['.'] ELSE list_append(f.done, {strip_sql('f.cur')}) END AS ch FROM fold),
rows AS (SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS chunk_no, ch[i] AS chunk FROM (SELECT *, unnest(range(1, len(ch) + 1)) AS i FROM chunks))"""


@query(
    "dialogue_chunk",
    f"WITH {MESSAGES_SQL}, {chunks_sql(40)} SELECT * FROM rows",
)
def dialogue_chunk(spark, sf):
    return dialogues(spark, sf).select(
        "conv_id", "turn", F.posexplode(dg.dialogue_chunk(F.col("msgs"), 40)).alias("chunk_no", "chunk")
    )


@query(
    "job_dialogue_chunks",
    f"""WITH {MESSAGES_SQL}, {chunks_sql(40)}
    SELECT conv_id, count(*) AS chunks, CAST(sum({tokens_sql('chunk')}) AS BIGINT) AS tokens,
           CAST(max({tokens_sql('chunk')}) AS INTEGER) AS largest, count(DISTINCT turn) AS dialogues FROM rows GROUP BY conv_id""",
)
def job_dialogue_chunks(spark, sf):
    rows = dialogue_chunk(spark, sf).withColumn("tok", tx.token_count(F.col("chunk")))
    per_dialogue = rows.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("c"), F.sum("tok").alias("t"), F.max("tok").alias("m")
    )
    return per_dialogue.groupBy("conv_id").agg(
        F.sum("c").alias("chunks"),
        F.sum("t").alias("tokens"),
        F.max("m").alias("largest"),
        F.count(F.lit(1)).alias("dialogues"),
    )


CHAT_SQL = "'[bot]:' || replace(replace(text, chr(10), '[customer]: '), '. ', '[agent]:')"
TURNS_SQL = f"""
parts AS (SELECT conv_id, turn, list_transform((string_split(
            regexp_replace({CHAT_SQL}, '\\[(bot|customer|agent)\\]:', chr(1) || '\\1' || chr(2), 'g'), chr(1)))[2:],
          lambda p: {{'role': string_split(p, chr(2))[1], 'content': {strip_sql("string_split(p, chr(2))[2]")}}}) AS t FROM conversations),
turns AS (SELECT conv_id, turn, list_filter(t, lambda x: x.content <> '') AS t FROM parts),
chat AS (SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, t[i].role AS role, t[i].content AS content
         FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM turns))"""


def chat_text():
    body = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("[customer]: ")), F.lit(". "), F.lit("[agent]:"))
    return F.concat(F.lit("[bot]:"), body)


@query("job_chat_turns", f"WITH {TURNS_SQL} SELECT * FROM chat")
def job_chat_turns(spark, sf):
    turns = texts(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(dg.chat_split(chat_text())).alias("pos", "t")
    )
    return turns.select("conv_id", "turn", "pos", "t.role", "t.content")


@query(
    "chat_split",
    f"WITH {TURNS_SQL} SELECT role, count(*) AS turns, CAST(sum(length(content)) AS BIGINT) AS chars FROM chat GROUP BY role",
)
def chat_split(spark, sf):
    return job_chat_turns(spark, sf).groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.length("content")).alias("chars")
    )


@query(
    "chat_clean",
    f"""SELECT conv_id, turn, {strip_sql("regexp_replace(" + squeeze_sql(CHAT_SQL) + ", '\\[(?:bot|customer|agent)\\]:', '', 'g')")} AS t
    FROM conversations""",
)
def chat_clean(spark, sf):
    return texts(spark, sf, "conversations").select("conv_id", "turn", dg.chat_clean(chat_text()).alias("t"))


@query(
    "chat_format",
    f"WITH {TURNS_SQL} SELECT conv_id, turn, array_to_string(list_transform(t, lambda x: '[' || x.role || ']: ' || x.content), chr(10)) AS t FROM turns",
)
def chat_format(spark, sf):
    lines = F.array_join(dg.chat_format(dg.chat_split(chat_text())), "\n")
    return texts(spark, sf, "conversations").select("conv_id", "turn", lines.alias("t"))


# sentences are events; every line starts a shipment, system turns carry no shipment ids
SHIP_ID_SQL = "' [eom] [bom] [Shipment ID]: S' || conv_id || '-' || turn || ' [eom] [bom] '"
SHIP_TEXT_SQL = f"""CASE WHEN role = 'system' THEN '[bom] ' || replace(text, '. ', ' [eom][bom] ') || ' [eom]'
  ELSE '[bom] start' || {SHIP_ID_SQL} || replace(replace(text, '. ', ' [eom][bom] '), chr(10), {SHIP_ID_SQL})
       || ' [eom] [bom] End of Ship Track Event for S [eom] [bom] after [eom]' END"""
EVENTS_SQL = f"""
ship AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all({SHIP_TEXT_SQL}, '(?s)\\[bom\\](.*?)\\[eom\\]', 1),
           lambda m: {strip_sql('m')}), lambda m: m <> '') AS msgs FROM conversations),
m AS (SELECT conv_id, turn, i, msgs[i] AS msg, starts_with(msgs[i], '[Shipment ID]:') AS is_id,
             starts_with(msgs[i], 'End of Ship Track Event') AS is_end
      FROM (SELECT *, unnest(range(1, len(msgs) + 1)) AS i FROM ship)),
n AS (SELECT *, sum(CAST(is_id AS INTEGER)) OVER w AS no, sum(CAST(is_end AS INTEGER)) OVER w AS ended,
             max(CASE WHEN is_id THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn) AS any_id
      FROM m WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
ev AS (SELECT conv_id, turn, no, i, msg, CASE WHEN any_id = 0 THEN 'Unknown' ELSE 'S' || conv_id || '-' || turn END AS shipment_id
       FROM n WHERE NOT is_id AND NOT is_end AND ((any_id = 0) OR (no > 0 AND ended = 0)))"""


def shipment_text():
    new_id = F.concat(
        F.lit(" [eom] [bom] [Shipment ID]: S"), F.col("conv_id"), F.lit("-"), F.col("turn"), F.lit(" [eom] [bom] ")
    )
    events = F.replace(F.col("text"), F.lit(". "), F.lit(" [eom][bom] "))
    plain = F.concat(F.lit("[bom] "), events, F.lit(" [eom]"))
    end = F.lit(" [eom] [bom] End of Ship Track Event for S [eom] [bom] after [eom]")
    return F.when(F.col("role") == "system", plain).otherwise(
        F.concat(F.lit("[bom] start"), new_id, F.replace(events, F.lit("\n"), new_id), end)
    )


@query(
    "job_shipment_events",
    f"""WITH {EVENTS_SQL} SELECT conv_id, turn, shipment_id,
      CAST(dense_rank() OVER (PARTITION BY conv_id, turn ORDER BY no) - 1 AS INTEGER) AS shipment_no,
      CAST(row_number() OVER (PARTITION BY conv_id, turn, no ORDER BY i) - 1 AS INTEGER) AS pos, msg AS event FROM ev""",
)
def job_shipment_events(spark, sf):
    ships = texts(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(dg.shipment_events(shipment_text())).alias("shipment_no", "s")
    )
    return ships.select("conv_id", "turn", "shipment_no", "s.shipment_id", F.posexplode("s.events").alias("pos", "event"))


@query(
    "shipment_events",
    f"""WITH {EVENTS_SQL}, s AS (SELECT conv_id, turn, no, count(*) AS e FROM ev GROUP BY ALL)
    SELECT conv_id, turn, count(*) AS shipments, CAST(sum(e) AS BIGINT) AS events FROM s GROUP BY conv_id, turn""",
)
def shipment_events(spark, sf):
    ships = texts(spark, sf, "conversations").select(
        "conv_id", "turn", dg.shipment_events(shipment_text()).alias("s")
    )
    return ships.filter(F.size("s") > 0).select(
        "conv_id",
        "turn",
        F.size("s").cast("long").alias("shipments"),
        F.aggregate("s", F.lit(0), lambda a, x: a + F.size(x["events"])).cast("long").alias("events"),
    )


@query(
    "message_totals",
    f"""WITH {MESSAGES_SQL}, {EVENTS_SQL}, s AS (SELECT conv_id, turn, no, count(*) AS e FROM ev GROUP BY ALL)
    SELECT (SELECT CAST(sum(len(msgs)) AS BIGINT) FROM dlg) AS messages, count(*) AS shipments, CAST(sum(e) AS BIGINT) AS events FROM s""",
)
def message_totals(spark, sf):
    cases = texts(spark, sf, "conversations").select(
        dialogue_text().alias("dialogue_x"), shipment_text().alias("shiptrack_event_history_by_order")
    )
    return dg.message_totals(dg.add_parsed_columns(cases), "dialogue_x_parsed", "shiptrack_parsed")


@query(
    "add_parsed_columns",
    f"""WITH {MESSAGES_SQL}, {EVENTS_SQL}, s AS (SELECT conv_id, turn, count(DISTINCT no) AS k FROM ev GROUP BY ALL)
    SELECT conv_id, turn, CAST(len(msgs) AS INTEGER) AS messages, CAST(coalesce(k, 0) AS INTEGER) AS shipments
    FROM dlg LEFT JOIN s USING (conv_id, turn)""",
)
def add_parsed_columns(spark, sf):
    cases = texts(spark, sf, "conversations").select(
        "conv_id", "turn", dialogue_text().alias("dialogue_x"), shipment_text().alias("shiptrack_event_history_by_order")
    )
    return dg.add_parsed_columns(cases).select(
        "conv_id", "turn", F.size("dialogue_x_parsed").alias("messages"), F.size("shiptrack_parsed").alias("shipments")
    )


@query(
    "strip_arrival_prefix",
    f"""WITH s AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '[Arrival Time]: ' || text ELSE text END AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN starts_with(t, '[Arrival Time]:') THEN {strip_sql("replace(t, '[Arrival Time]:', '')")} ELSE t END AS t FROM s""",
)
def strip_arrival_prefix(spark, sf):
    t = F.when(F.col("role") == "user", F.concat(F.lit("[Arrival Time]: "), F.col("text"))).otherwise(F.col("text"))
    return texts(spark, sf, "conversations").select("conv_id", "turn", dg.strip_arrival_prefix(t).alias("t"))


@query(
    "column_chains",
    f"""WITH {MESSAGES_SQL} SELECT conv_id, turn, array_to_string(list_transform(msgs, lambda m: lower({squeeze_sql("regexp_replace(m, '" + tx.EMOJI + "', '', 'g')")})), '|') AS dialogue_processed
    FROM dlg""",
)
def column_chain_query(spark, sf):
    rows = texts(spark, sf, "conversations").select("conv_id", "turn", dialogue_text().alias("dialogue"))
    steps = [
        dg.dialogue_split,
        tx.each(tx.emoji_remove),
        tx.each(tx.text_normalize),
        lambda c: F.array_join(c, "|"),
    ]
    return column_chains(rows, {"dialogue": steps}, drop=["dialogue"])


@query(
    "job_page_text",
    f"""WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, {PAGE_TEXT_SQL} AS t FROM pages)
    SELECT host, count(*) AS pages, CAST(sum(length(t)) AS BIGINT) AS chars,
           CAST(sum(len(list_filter(regexp_split_to_array(t, '{S}+'), lambda w: w <> ''))) AS BIGINT) AS tokens FROM p GROUP BY host""",
)
def job_page_text(spark, sf):
    pages = texts(spark, sf, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), tx.html_to_text("html").alias("t")
    )
    return pages.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.length("t")).alias("chars"), F.sum(tx.token_count(F.col("t"))).alias("tokens")
    )


# ---- tokens

TOKEN_SQL = f"""
tok AS (SELECT conv_id * 1000 + turn AS k, i - 1 AS pos, w[i] AS token FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT conv_id, turn, list_filter(regexp_split_to_array(lower({squeeze_sql('text')}), '{S}+'), lambda x: x <> '') AS w FROM conversations))),
vocab AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS id, count(*) AS n FROM tok GROUP BY token)"""


def token_input(spark, sf):
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("k")
    return texts(spark, sf, "conversations").select(key, "text")


@query(
    "tokenize_chunks",
    f"""WITH {TOKEN_SQL} SELECT k, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids, count(*) AS n
    FROM tok JOIN vocab USING (token) WHERE pos < 64 GROUP BY k""",
)
def tokenize_chunks(spark, sf):
    df = token_input(spark, sf)
    vocab = stage(tk.token_vocabulary(df, "k", "text"))
    out = tk.tokenize_chunks(df, "k", "text", vocab, 64)
    ids = F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("ids")
    return out.select("k", ids, F.size("attention_mask").cast("long").alias("n"))


# pieces: characters that begin or continue a word, and frequent beginnings and endings of three characters
PIECES_SQL = f"""
sub_texts AS (SELECT conv_id * 1000 + turn AS k, text FROM conversations WHERE {squeeze_sql('text')} <> ''),
sub_words AS (SELECT k, i, w[i] AS w FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT k, regexp_extract_all(strip_accents(lower(text)), '[\\p{{P}}$+<=>^`|~]|[^\\p{{P}}$+<=>^`|~\\s]+') AS w FROM sub_texts))),
sub_distinct AS (SELECT DISTINCT w FROM sub_words),
sub_pieces AS (
  SELECT p, row_number() OVER (ORDER BY encode(p)) + 3 AS id FROM (
    SELECT substr(w, 1, 1) AS p FROM sub_distinct WHERE substr(w, 1, 1) <> 'q' UNION SELECT '##' || c FROM (SELECT unnest(string_split(substr(w, 2), '')) AS c FROM sub_distinct WHERE length(w) > 1)
    UNION SELECT substr(w, 1, 3) FROM sub_distinct WHERE length(w) > 3 AND substr(w, 1, 1) <> 'q' GROUP BY 1 HAVING count(*) >= 3
    UNION SELECT '##' || right(w, 3) FROM sub_distinct WHERE length(w) > 3 GROUP BY 1 HAVING count(*) >= 3)),
sub_steps(w, b, ids) AS (
  SELECT w, 1::BIGINT, []::BIGINT[] FROM sub_distinct
  UNION ALL
  SELECT s.w, s.b + l.n, list_append(s.ids, l.id)
  FROM sub_steps s, LATERAL (
    SELECT max_by(id, n) AS id, max(n) AS n FROM (
      SELECT n, id FROM (VALUES (1), (3)) x(n) JOIN sub_pieces ON p = CASE WHEN s.b > 1 THEN '##' ELSE '' END || substr(s.w, s.b, n)
      WHERE s.b + n - 1 <= length(s.w))) l
  WHERE s.b <= length(s.w) AND l.n IS NOT NULL),
sub_ids AS (SELECT d.w, CASE WHEN length(d.w) <= 100 THEN coalesce(any_value(s.ids) FILTER (s.b = length(d.w) + 1), [1]) ELSE [1] END AS ids
  FROM sub_distinct d LEFT JOIN sub_steps s ON s.w = d.w GROUP BY d.w)"""


@query(
    "subword_ids",
    f"""WITH RECURSIVE {PIECES_SQL},
    every AS (SELECT k, list_slice(flatten(list(ids ORDER BY i)), 1, 62) AS ids FROM sub_words JOIN sub_ids USING (w) GROUP BY k)
    SELECT k, array_to_string([2::BIGINT] || coalesce(ids, []::BIGINT[]) || [3::BIGINT], ',') AS ids, least(len(coalesce(ids, []::BIGINT[])), 62) + 2 AS n
    FROM (SELECT DISTINCT k FROM sub_texts) LEFT JOIN every USING (k)""",
)
def subword_ids(spark, sf):
    """Ids of at most 64 pieces, special ones included; the vocabulary is a file built from the words."""
    df = token_input(spark, sf)
    distinct = stage(df.select(F.explode(sw.words_of(F.col("text"))).alias("w")).distinct(), "words")
    inner = F.col("w").substr(F.lit(2), F.length("w"))
    often = lambda column: distinct.filter(F.length("w") > 3).groupBy(column.alias("p")).count().filter("count >= 3").select("p")
    pieces = (
        distinct.select(F.substring("w", 1, 1).alias("p"))
        .unionAll(distinct.select(F.explode(F.transform(F.split(inner, ""), lambda c: F.concat(F.lit("##"), c))).alias("p")).filter("p <> '##'"))
        .unionAll(often(F.substring("w", 1, 3)))
        .unionAll(often(F.concat(F.lit("##"), F.right(F.col("w"), F.lit(3)))))
        .filter("NOT startswith(p, 'q')")
        .distinct()
    )
    listed = sorted((r["p"] for r in pieces.collect()), key=lambda p: p.encode())  # characters and frequent triples
    path = sw.write_pieces(spark, ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *listed], new_stage_path(spark, "pieces"))
    encoded = sw.subword_chunks(df, F.array("text"), sw.read_pieces(spark, path), max_length=64)
    ids = F.element_at("encoded", 1)["input_ids"]
    rows = encoded.filter(F.size("encoded") > 0)
    return rows.select("k", F.array_join(ids.cast("array<string>"), ",").alias("ids"), F.size(ids).cast("long").alias("n"))


@query(
    "embed_tokens",
    f"""WITH {TOKEN_SQL}, e AS (SELECT k, list_sum(embedding) AS s FROM tok JOIN vocab USING (token)
       LEFT JOIN embeddings ON vec_id = id - 2 WHERE pos < 32)
    SELECT k, 32 AS width, CAST(count(s) AS INTEGER) AS known, round(coalesce(sum(s), 0.0), 3) + 0.0 AS total FROM e GROUP BY k""",
)
def embed_tokens(spark, sf):
    df = token_input(spark, sf)
    vocab = stage(tk.token_vocabulary(df, "k", "text"))
    vectors = stage(tk.token_vectors(table(spark, sf, "embeddings"), vocab))
    # the width of the vectors, also where none belongs to a known token
    dim = table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    out = tk.embed_tokens(df, "k", "text", vectors, dim, 32)
    total = F.aggregate(
        "embeddings", F.lit(0.0), lambda a, v: F.aggregate(v, a, lambda b, x: b + x.cast("double"))
    )
    known = F.aggregate("mask", F.lit(0), lambda a, x: a + x)
    return out.select(
        "k", F.size("embeddings").alias("width"), known.alias("known"), (F.round(total, 3) + 0.0).alias("total")
    )


@query(
    "pad_batch",
    f"""WITH {TOKEN_SQL}, s AS (SELECT k, k % 8 AS b, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids, count(*) AS n
       FROM tok JOIN vocab USING (token) WHERE pos < 64 GROUP BY k)
    SELECT k, ids || repeat(',0', max(n) OVER (PARTITION BY b) - n) AS ids FROM s""",
)
def pad_batch(spark, sf):
    df = token_input(spark, sf)
    vocab = stage(tk.token_vocabulary(df, "k", "text"))
    ids = tk.tokenize_chunks(df, "k", "text", vocab, 64).select("k", F.col("input_ids").cast("array<long>").alias("ids"))
    padded = tk.pad_batch(ids, "ids", F.col("k") % 8)
    return padded.select("k", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


AS_WRITTEN_SQL = TOKEN_SQL.replace(f"lower({squeeze_sql('text')})", squeeze_sql("text"))


@query(
    "embed_tokens_as_written",
    f"""WITH {AS_WRITTEN_SQL}, e AS (SELECT k, list_sum(embedding) AS s FROM tok JOIN vocab USING (token)
       LEFT JOIN embeddings ON vec_id = id - 2 WHERE pos < 32)
    SELECT k, CAST(count(*) AS INTEGER) AS width, CAST(count(s) AS INTEGER) AS known, round(coalesce(sum(s), 0.0), 3) + 0.0 AS total
    FROM e GROUP BY k""",
)
def embed_tokens_as_written(spark, sf):
    df = token_input(spark, sf)
    vocab = stage(tk.token_vocabulary(df, "k", "text", lower=False))
    embeddings = table(spark, sf, "embeddings")
    vectors = stage(tk.token_vectors(embeddings, vocab))
    dim = embeddings.agg(F.max(F.size("embedding"))).first()[0]
    out = tk.embed_tokens(df, "k", "text", vectors, dim, 32, pad=False, lower=False)
    total = F.aggregate(F.flatten("embeddings"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    known = F.aggregate("mask", F.lit(0), lambda a, x: a + x)
    return out.select(
        "k", F.size("embeddings").alias("width"), known.alias("known"), (F.round(total, 3) + 0.0).alias("total")
    )


@query(
    "pad_chunks",
    """WITH w AS (SELECT conv_id * 1000 + turn AS k,
         list_transform(string_split(text, chr(10)), lambda x: list_transform(string_split(x, ' '), lambda y: length(y))) AS ids FROM conversations),
    s AS (SELECT k, len(ids) AS n, list_max(list_transform(ids, lambda x: len(x))) AS m, list_sum(flatten(ids)) AS total FROM w)
    SELECT k, max(n) OVER b AS chunks, max(m) OVER b AS width, CAST(total AS BIGINT) AS total FROM s WINDOW b AS (PARTITION BY k % 8)""",
)
def pad_chunks(spark, sf):
    lengths = F.transform(F.split("text", "\n"), lambda x: F.transform(F.split(x, " "), F.length))
    padded = tk.pad_chunks(token_input(spark, sf).select("k", lengths.alias("ids")), "ids", F.col("k") % 8)
    total = F.aggregate(F.flatten("ids"), F.lit(0).cast("long"), lambda a, x: a + x)
    return padded.select(
        "k",
        F.size("ids").cast("long").alias("chunks"),
        F.size(F.element_at("ids", -1)).cast("long").alias("width"),
        total.alias("total"),
    )


@query(
    "job_token_features",
    f"""WITH {TOKEN_SQL} SELECT token, CAST(id AS BIGINT) AS token_id, n, round(list_sum(embedding), 3) + 0.0 AS weight
    FROM vocab LEFT JOIN embeddings ON vec_id = id - 2""",
)
def job_token_features(spark, sf):
    vocab = tk.token_vocabulary(token_input(spark, sf), "k", "text")
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    joined = vocab.join(emb, vocab.token_id - 2 == emb.vec_id, "left")
    weight = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return joined.select("token", "token_id", "n", (F.round(weight, 3) + 0.0).alias("weight"))


# ---- labelling responses, rendered from events and parsed back

CODES_SQL = "[" + ", ".join(f"'{c}'" for c in fv.REASON_CODES) + "]"
REPORT_SQL = """'1. Category: ' || code || chr(10) || chr(10) || '2. Confidence Score: ' || printf('%.2f', conf) || chr(10) || chr(10)
  || '3. Key Evidence:' || chr(10) || '   * Message Evidence:' || chr(10) || '     [sep] ' || event_type || chr(10) || '     [sep] ' || props
  || chr(10) || '   * Shipping Evidence:' || chr(10) || '     [sep] user ' || user_id || chr(10) || '   * Timeline Evidence:' || chr(10) || chr(10)
  || '4. Reasoning:' || chr(10) || '   * Primary Factors:' || chr(10) || '     [sep] value ' || CAST(value AS VARCHAR) || chr(10)
  || '   * Supporting Evidence:' || chr(10) || '     [sep] ' || event_type || chr(10) || '   * Contradicting Evidence:' || chr(10) || '     [sep] None'"""
RESPONSE_SQL = f"""
base AS (SELECT *, {CODES_SQL}[user_id % 12 + 1] AS code, (user_id % 101) / 100.0::DOUBLE AS conf FROM events),
report AS (SELECT *, {REPORT_SQL} AS report FROM base),
resp AS (SELECT event_id, event_type, code, conf, report,
                CASE event_type WHEN 'error' THEN '' WHEN 'signup' THEN 'no answer ' || props
                     WHEN 'view' THEN substr(report, length('1. Category: ' || code) + 3) ELSE report END AS response FROM report),
parsed AS (
  SELECT *, CASE WHEN response = '' THEN 'Error' ELSE coalesce(nullif(regexp_extract(response, 'Category:\\s*([A-Za-z_]+(?:\\s*\\([^)]*\\))?)', 1), ''), 'Unknown') END AS category,
         coalesce(CAST(nullif(regexp_extract(response, 'Confidence Score:\\s*(0?\\.\\d+|1\\.00?)', 1), '') AS DOUBLE), 0.0::DOUBLE) AS confidence_score,
         regexp_extract(response, '(?s)(\\* Message Evidence:.*?)(?:\\n\\s*\\* |\\n\\d\\.|\\z)', 1) AS ev FROM resp),
items AS (SELECT *, list_filter(list_transform((string_split(ev, '[sep]'))[2:], lambda x: {strip_sql('x')}), lambda x: x <> '') AS message_evidence FROM parsed)"""


def responses(spark, sf):
    codes = F.array(*[F.lit(c) for c in fv.REASON_CODES])
    sep = F.lit("[sep] ")
    base = table(spark, sf, "events").withColumns(
        {
            "code": F.element_at(codes, (F.col("user_id") % 12 + 1).cast("int")),
            "conf": (F.col("user_id") % 101) / 100.0,
        }
    )
    kind = F.concat(sep, F.col("event_type"))
    evidence = [
        F.array(kind, F.concat(sep, F.col("props"))),
        F.array(F.concat(F.lit("[sep] user "), F.col("user_id"))),
        F.array().cast("array<string>"),
        F.array(F.concat(F.lit("[sep] value "), F.col("value").cast("string"))),
        F.array(kind),
        F.array().cast("array<string>"),
    ]
    report = base.withColumn("report", rs.format_analysis(F.col("code"), F.col("conf"), evidence))
    headless = F.substring(
        "report", F.length(F.concat(F.lit("1. Category: "), F.col("code"))) + 3, F.length("report")
    )
    response = (
        F.when(F.col("event_type") == "error", "")
        .when(F.col("event_type") == "signup", F.concat(F.lit("no answer "), F.col("props")))
        .when(F.col("event_type") == "view", headless)
        .otherwise(F.col("report"))
    )
    return report.withColumn("response", response)


@query("format_analysis", f"WITH {RESPONSE_SQL} SELECT event_id, report FROM resp")
def format_analysis(spark, sf):
    return responses(spark, sf).select("event_id", "report")


@query(
    "llm_category",
    f"WITH {RESPONSE_SQL} SELECT event_id, category, confidence_score FROM parsed WHERE response <> ''",
)
def response_category(spark, sf):
    c = F.col("response")
    return responses(spark, sf).filter(c != "").select(
        "event_id", rs.response_category(c).alias("category"), rs.response_confidence(c).alias("confidence_score")
    )


@query(
    "llm_confidence",
    f"WITH {RESPONSE_SQL} SELECT confidence_score, count(*) AS n FROM parsed GROUP BY 1",
)
def response_confidence(spark, sf):
    scored = responses(spark, sf).select(rs.response_confidence(F.col("response")).alias("confidence_score"))
    return scored.groupBy("confidence_score").agg(F.count(F.lit(1)).alias("n"))


@query(
    "llm_evidence",
    f"WITH {RESPONSE_SQL} SELECT event_id, array_to_string(message_evidence, '|') AS items, CAST(len(message_evidence) AS INTEGER) AS n FROM items",
)
def response_evidence(spark, sf):
    items = rs.response_evidence(F.col("response"), "Message Evidence")
    return responses(spark, sf).select("event_id", F.array_join(items, "|").alias("items"), F.size(items).alias("n"))


@query(
    "llm_parse",
    f"""WITH {RESPONSE_SQL} SELECT event_id, category, confidence_score,
      CAST(CASE WHEN response = '' OR (category = 'Unknown' AND confidence_score = 0) THEN 0 ELSE len(message_evidence) END AS INTEGER) AS n_message,
      CASE WHEN response = '' THEN 'Invalid or empty response'
           WHEN category = 'Unknown' AND confidence_score = 0 THEN 'Partial parse only: Missing required fields: category and confidence score'
           WHEN category = 'Unknown' THEN 'Missing category in response' END AS error FROM items""",
)
def parse_responses(spark, sf):
    parsed = rs.parse_response(responses(spark, sf), "response")
    return parsed.select("event_id", "category", "confidence_score", F.size("message_evidence").alias("n_message"), "error")


JSON_SQL = f"""
base AS (SELECT *, {CODES_SQL}[user_id % 12 + 1] AS code, (user_id % 101) / 100.0::DOUBLE AS conf FROM events),
js AS (SELECT event_id, event_type, code, conf, props, CASE event_type WHEN 'error' THEN 'the item is late ' || props
        WHEN 'signup' THEN 'broken {{ ' || props ELSE 'Answer: {{"category": "' || code || '", "confidence_score": ' || printf('%.2f', conf)
        || ', "key_evidence": {{"message_evidence": ["[sep] ' || event_type || '"]}}}} end' END AS response FROM base)"""


def json_responses(spark, sf):
    codes = F.array(*[F.lit(c) for c in fv.REASON_CODES])
    code = F.element_at(codes, (F.col("user_id") % 12 + 1).cast("int"))
    conf = F.format_string("%.2f", (F.col("user_id") % 101) / 100.0)
    body = F.concat(
        F.lit('Answer: {"category": "'), code, F.lit('", "confidence_score": '), conf,
        F.lit(', "key_evidence": {"message_evidence": ["[sep] '), F.col("event_type"), F.lit('"]}} end'),
    )
    response = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("the item is late "), F.col("props")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("broken { "), F.col("props")))
        .otherwise(body)
    )
    return table(spark, sf, "events").select("event_id", response.alias("response"))


@query(
    "llm_json_parse",
    f"""WITH {JSON_SQL} SELECT event_id,
      CASE WHEN event_type = 'error' THEN 'Confirmed_Delay' WHEN event_type = 'signup' THEN 'Insufficient_Information' ELSE code END AS category,
      CASE WHEN event_type = 'error' THEN 0.6 WHEN event_type = 'signup' THEN 0.5 ELSE conf END AS confidence_score,
      CASE WHEN event_type IN ('error', 'signup') THEN 'fallback' ELSE 'json' END AS source FROM js""",
)
def json_parse(spark, sf):
    c = F.col("response")
    rows = json_responses(spark, sf).withColumns({"j": rs.json_response(c), "k": rs.keyword_fallback_v1(c)})
    return rows.select(
        "event_id",
        F.coalesce("j.category", "k.category").alias("category"),
        F.coalesce("j.confidence_score", "k.confidence_score").alias("confidence_score"),
        F.when(F.col("j").isNull(), "fallback").otherwise("json").alias("source"),
    )


def words_sql(*words: str) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


V1_SQL = " ".join(f"WHEN {words_sql(*w)} THEN '{c}'" for w, c, _ in rs.KEYWORD_RULES_V1)


@query(
    "keyword_fallback_v1",
    f"""SELECT doc_id, CASE {V1_SQL} ELSE 'Insufficient_Information' END AS category,
      CASE WHEN {words_sql(*[x for w, _, _ in rs.KEYWORD_RULES_V1 for x in w])} THEN 0.6::DOUBLE ELSE 0.5 END AS confidence_score
    FROM (SELECT doc_id, lower(text) AS t FROM documents)""",
)
def keyword_fallback_v1(spark, sf):
    k = rs.keyword_fallback_v1(F.col("text"))
    return texts(spark, sf, "documents").select("doc_id", k.alias("k")).select("doc_id", "k.*")


# every rule of the long list is met by some phrase, chosen by the row's numbers
PHRASES = (
    "Invoice please", "early refund asked", "refund before delivery", "never received it", "marked delivered, never received",
    "arrived late", "failed delivery", "out of stock", "cancel before it ships", "keep the item", "wrong item", "changed mind",
    "hello",
)
V2_SQL = f"""CASE WHEN {words_sql("invoice", "receipt", "specification", "instruction", "troubleshoot")} THEN 'Product_Information_Support|0.6'
  WHEN {words_sql("early refund")} OR ({words_sql("refund")} AND {words_sql("before delivery")}) THEN 'PDA_Early_Refund|0.7'
  WHEN {words_sql("never received", "not delivered")} AND {words_sql("delivered")} THEN 'TrueDNR|0.6'
  WHEN {words_sql("never received", "not delivered")} THEN 'PDA_Undeliverable|0.6'
  WHEN {words_sql("late", "delayed")} THEN 'Confirmed_Delay|0.6'
  WHEN {words_sql("failed delivery", "delivery attempt")} THEN 'Delivery_Attempt_Failed|0.6'
  WHEN {words_sql("unable to ship", "out of stock")} THEN 'Seller_Unable_To_Ship|0.6'
  WHEN {words_sql("cancel")} AND {words_sql("before")} THEN 'BuyerCancellation|0.6'
  WHEN {words_sql("keep the item", "no need to return")} THEN 'Returnless_Refund|0.7'
  WHEN {words_sql("damaged", "defective", "wrong item")} THEN 'Buyer_Received_WrongORDefective_Item|0.6'
  WHEN {words_sql("no longer needed", "changed mind")} THEN 'Return_NoLongerNeeded|0.6' ELSE 'Insufficient_Information|0.5' END"""


@query(
    "keyword_fallback_v2",
    f"""WITH s AS (SELECT event_id, lower([{', '.join("'" + p + "'" for p in PHRASES)}][user_id % {len(PHRASES)} + 1] || ' ' || props) AS t FROM events),
    k AS (SELECT event_id, {V2_SQL} AS k FROM s)
    SELECT event_id, string_split(k, '|')[1] AS category, CAST(string_split(k, '|')[2] AS DOUBLE) AS confidence_score FROM k""",
)
def keyword_fallback_v2(spark, sf):
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("user_id") % len(PHRASES) + 1).cast("int"))
    k = rs.keyword_fallback_v2(F.concat_ws(" ", phrase, F.col("props")))
    return table(spark, sf, "events").select("event_id", k.alias("k")).select("event_id", "k.*")


@query(
    "evidence_prefix",
    f"""WITH {MESSAGES_SQL} SELECT conv_id, turn, array_to_string(list_transform(
        list_append(msgs, '[sep] ' || role), lambda x: CASE WHEN starts_with(x, '[sep] ') THEN x ELSE '[sep] ' || x END), chr(10)) AS t FROM dlg""",
)
def evidence_prefix(spark, sf):
    items = F.array_append("msgs", F.concat(F.lit("[sep] "), F.col("role")))
    return dialogues(spark, sf).select("conv_id", "turn", F.array_join(rs.evidence_prefix(items), "\n").alias("t"))


@query(
    "evidence_unprefix",
    f"""WITH {MESSAGES_SQL} SELECT conv_id, turn, array_to_string(list_transform(msgs, lambda x: x), chr(10)) || chr(10) || role AS t FROM dlg""",
)
def evidence_unprefix(spark, sf):
    items = F.concat(
        rs.evidence_prefix(F.col("msgs")),
        F.array(F.lit("None"), F.lit("[sep] None"), F.lit(""), F.lit("[sep] Fallback analysis based on keywords"), F.col("role")),
    )
    return dialogues(spark, sf).select("conv_id", "turn", F.array_join(rs.evidence_unprefix(items), "\n").alias("t"))


@query(
    "case_string_parse",
    f"SELECT conv_id, turn, {strip_sql('text')} AS dialogue, role AS shiptrack FROM conversations",
)
def case_string_parse(spark, sf):
    case = F.concat(F.lit("Customer Dialogue: "), F.col("text"), F.lit(" | Other: x | Shipping History: "), F.col("role"))
    parsed = rs.case_string_parse(case)
    return texts(spark, sf, "conversations").select("conv_id", "turn", parsed.alias("c")).select("conv_id", "turn", "c.*")


GROUP_ROWS = [(c, *f) for c, f in fv.REASON_CODES.items()]
GROUPS_SQL = f"groups(category, reason_group, group_name, risk_level) AS (VALUES {sql_list(GROUP_ROWS)})"


@query(
    "reason_group",
    f"""WITH {GROUPS_SQL}, b AS (SELECT event_id, {CODES_SQL}[user_id % 12 + 1] AS category FROM events)
    SELECT event_id, category, reason_group, group_name, risk_level FROM b LEFT JOIN groups USING (category)""",
)
def reason_group(spark, sf):
    codes = F.array(*[F.lit(c) for c in fv.REASON_CODES])
    code = F.element_at(codes, (F.col("user_id") % 12 + 1).cast("int"))
    return rs.reason_group(table(spark, sf, "events").select("event_id", code.alias("category")))


TEMPLATE = "Dialogue: {dialogue}\nShip Track Events: {shiptrack}\nEstimated Delivery: {max_estimated_arrival_date}"


@query(
    "render_prompt",
    """SELECT conv_id, turn, 'Dialogue: ' || text || chr(10) || 'Ship Track Events: ' || role || chr(10) || 'Estimated Delivery: '
      || CASE WHEN turn = 0 THEN 'Not provided' ELSE CAST(turn AS VARCHAR) END AS prompt FROM conversations""",
)
def render_prompt(spark, sf):
    date = F.nullif(F.col("turn").cast("string"), F.lit("0"))
    prompt = rs.render_prompt(TEMPLATE, F.col("text"), F.col("role"), date)
    return texts(spark, sf, "conversations").select("conv_id", "turn", prompt.alias("prompt"))


@query(
    "category_summary",
    f"WITH {RESPONSE_SQL} SELECT category, count(*) AS n, round(avg(confidence_score), 6) AS avg_confidence FROM parsed GROUP BY category",
)
def category_summary(spark, sf):
    return rounded(rs.category_summary(rs.parse_response(responses(spark, sf), "response")), "avg_confidence")


LABEL_SQL = f"""
lab AS (SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN 'Insufficient_Information'
          WHEN contains(text, chr(10)) THEN 'TrueDNR' ELSE 'Confirmed_Delay' END AS category,
        CASE WHEN role = 'system' THEN 0.0::DOUBLE WHEN contains(text, chr(10)) THEN 0.9 ELSE 0.7 END AS confidence_score,
        CASE WHEN role = 'system' THEN 'error' ELSE 'success' END AS processing_status FROM conversations)"""


def line_labeller(case: dict) -> dict:
    if case["role"] == "system":
        raise ValueError("no dialogue")
    many = "\n" in case["text"]
    return {"category": "TrueDNR" if many else "Confirmed_Delay", "confidence_score": 0.9 if many else 0.7}


def labelled(spark, sf):
    return labelling.label_cases(texts(spark, sf, "conversations"), line_labeller)


@query("batch_label_cases", f"WITH {LABEL_SQL} SELECT conv_id, turn, category, confidence_score, processing_status FROM lab")
def batch_label_cases(spark, sf):
    return labelled(spark, sf).select("conv_id", "turn", "category", "confidence_score", "processing_status")


@query("label_pending", f"WITH {LABEL_SQL} SELECT conv_id, turn, category, confidence_score, processing_status FROM lab")
def label_pending(spark, sf):
    """Half of the conversations have their results; the others are labelled, four calls at a time."""
    cases = texts(spark, sf, "conversations")
    done = stage(labelling.label_cases(cases.filter("conv_id % 2 = 0"), line_labeller), "labelled")
    out = labelling.label_pending(cases, done, ["conv_id", "turn"], line_labeller, in_flight=4)
    return out.select("conv_id", "turn", "category", "confidence_score", "processing_status")


@query("batch_label_resumed", f"WITH {LABEL_SQL} SELECT conv_id, turn, category, confidence_score, processing_status FROM lab")
def batch_label_resumed(spark, sf):
    """Cases arrive as files and are labelled in micro-batches; a second start finds nothing left to do."""
    arriving, out, mark = (new_stage_path(spark, n) for n in ("cases", "labels", "mark"))
    cases = texts(spark, sf, "conversations")
    cases.repartition(3, "conv_id").write.parquet(arriving)
    for _ in range(2):
        stream = spark.readStream.schema(cases.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
        done = labelling.label_arriving(stream, out, mark, line_labeller, in_flight=2)
    return done.select("conv_id", "turn", "category", "confidence_score", "processing_status")


@query(
    "label_error_rate",
    f"WITH {LABEL_SQL} SELECT round(avg(CASE WHEN processing_status <> 'success' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS error_rate FROM lab",
)
def label_error_rate(spark, sf):
    return rounded(labelling.error_rate(labelled(spark, sf)), "error_rate")


@query(
    "reject_unexpected_fields",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'note' ELSE '' END AS extra,
      CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END AS valid FROM conversations""",
)
def reject_unexpected_fields(spark, sf):
    note = F.when(F.col("turn") % 3 == 0, "seen").alias("note")
    body = F.to_json(F.struct("role", "turn", note))  # a null field is left out
    extra = unexpected_fields(("role", "turn"), F.json_object_keys(body))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(extra, ",").alias("extra"), (F.size(extra) == 0).cast("int").alias("valid")
    )


CLAIM_ROWS = tuple(fv.CLAIM_ACTIONS.items())
CUSTOMER_ROWS = tuple(fv.CUSTOMER_ACTIONS.items())


def action_sql(rows) -> str:
    """A row's action by its number; one number in each round has an action that is not listed."""
    return "[" + ", ".join(f"'{code}'" for code, _ in (*rows, ("OTHER", None))) + "]"


@query(
    "decode_actions",
    f"""WITH claims(code, claim) AS (VALUES {sql_list(CLAIM_ROWS)}), customers(code, customer) AS (VALUES {sql_list(CUSTOMER_ROWS)}),
    e AS (SELECT event_id, {action_sql(CLAIM_ROWS)}[event_id % {len(CLAIM_ROWS) + 1} + 1] AS a,
                 {action_sql(CUSTOMER_ROWS)}[user_id % {len(CUSTOMER_ROWS) + 1} + 1] AS b FROM events)
    SELECT event_id, claim, customer, CASE WHEN customer IS NULL THEN NULL WHEN claim = 0 THEN CASE customer WHEN 0 THEN 0.0::DOUBLE ELSE 1.0 END
             WHEN claim = 1 THEN 1.0 WHEN claim = 2 THEN CASE customer WHEN 0 THEN 2.0 ELSE 1.0 END END AS label
    FROM e LEFT JOIN claims c ON c.code = a LEFT JOIN customers u ON u.code = b""",
)
def decode_actions(spark, sf):
    def action(rows, number):
        codes = F.array(*[F.lit(code) for code, _ in (*rows, ("OTHER", None))])
        return F.element_at(codes, (F.col(number) % (len(rows) + 1) + 1).cast("int"))

    none = F.lit(None).cast("int")
    out = table(spark, sf, "events").select("event_id", action(CLAIM_ROWS, "event_id").alias("a"), action(CUSTOMER_ROWS, "user_id").alias("b"))
    for column, rows, name in (("a", CLAIM_ROWS, "claim"), ("b", CUSTOMER_ROWS, "customer")):
        codes = local_table(spark, rows, "code string, class int")
        out = lookup_with_default(out, codes, F.col(column), "class", none, name, table_key="code")
    label = labelling.combined_label(F.col("claim"), F.col("customer")).alias("label")
    return out.select("event_id", "claim", "customer", label)


@query(
    "run_summary",
    f"""WITH {LABEL_SQL} SELECT count(*) AS total, count(*) FILTER (processing_status = 'success') AS successful,
      count(*) FILTER (processing_status <> 'success') AS failed,
      round(avg(confidence_score) FILTER (processing_status = 'success'), 6) AS avg_confidence FROM lab""",
)
def run_summary(spark, sf):
    return rounded(rs.run_summary(labelled(spark, sf)), "avg_confidence")


@query(
    "job_label_responses",
    f"""WITH {RESPONSE_SQL}, {GROUPS_SQL},
    v AS (SELECT category, confidence_score, CASE WHEN NOT list_contains({CODES_SQL}, category) THEN 'category' END AS reject_reason FROM parsed)
    SELECT v.category, reason_group, risk_level, reject_reason, count(*) AS n, round(avg(confidence_score), 6) AS avg_confidence
    FROM v LEFT JOIN groups USING (category) GROUP BY ALL""",
)
def job_label_responses(spark, sf):
    from riskloom.operators.quality import enum_and_range_check

    parsed = rs.parse_response(responses(spark, sf), "response").select("category", "confidence_score")
    checked = enum_and_range_check(parsed, "category", "confidence_score", list(fv.REASON_CODES))
    summed = checked.groupBy("category", "reject_reason").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence_score"), 6).alias("avg_confidence")
    )
    return rs.reason_group(summed).drop("group_name")
