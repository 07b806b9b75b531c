"""Dialogue, chat and shipment texts as arrays of messages, turns and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.text import SPACE, squeeze, strip, token_count

MESSAGE = r"(?s)\[bom\](.*?)\[eom\]"
ROLE = r"\[(?:bot|customer|agent)\]:"
SHIPMENT = rf"\[bom\]\s*\[Shipment ID\]:\s*([^\[]+?)\s*\[eom\]"
SHIPMENT_END = r"\[bom\]\s*End of Ship Track Event for\s+[^\[]+\[eom\]"


def dialogue_split(c: Column, min_length: int = 1) -> Column:
    """Trimmed, non-empty messages between the markers; NULL gives no messages."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MESSAGE), 1), strip)
    return F.filter(found, lambda m: F.length(m) >= max(min_length, 1))


def dialogue_chunk(
    messages: Column,
    max_tokens: int = 512,
    truncate: bool = False,
    max_total_chunks: int = 5,
    count: Callable[[Column], Column] = token_count,
) -> Column:
    """Pack messages in order into chunks of at most ``max_tokens``; a longer message stands alone.

    A fold over the row's own message array. An empty result becomes one chunk ``.``.
    """
    nothing = F.lit(None).cast("string")
    start = F.struct(
        F.array().cast("array<string>").alias("done"), nothing.alias("cur"), F.lit(0).alias("tok")
    )

    def full(done: Column) -> Column:
        return F.size(done) >= max_total_chunks if truncate else F.lit(False)

    def closed(acc: Column) -> Column:
        return F.concat(acc["done"], F.array(strip(acc["cur"])))

    def step(acc: Column, m: Column) -> Column:
        cur, tok, done = acc["cur"], acc["tok"], acc["done"]
        over = tok + m["n"] > max_tokens
        new_done = F.when(over & cur.isNotNull(), closed(acc)).otherwise(done)
        joined = F.when(over | cur.isNull(), m["m"]).otherwise(F.concat(cur, F.lit(" "), m["m"]))
        new_tok = F.when(over, m["n"]).otherwise(tok + m["n"])
        moved = F.struct(new_done.alias("done"), joined.alias("cur"), new_tok.alias("tok"))
        return F.when(full(done), acc).otherwise(moved) if truncate else moved

    def finish(acc: Column) -> Column:
        chunks = F.when(acc["cur"].isNotNull() & ~full(acc["done"]), closed(acc)).otherwise(acc["done"])
        return F.when(F.exists(chunks, lambda x: x != ""), chunks).otherwise(F.array(F.lit(".")))

    counted = F.transform(messages, lambda m: F.struct(m.alias("m"), count(m).alias("n")))
    return F.aggregate(counted, start, step, finish)


def chat_split(c: Column) -> Column:
    """Ordered ``{role, content}`` turns; turns without content are dropped."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), f"(?={ROLE})"), lambda p: p.rlike(f"^{ROLE}"))
    turns = F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, r"^\[(\w+)\]:", 1).alias("role"),
            strip(F.regexp_replace(p, f"^{ROLE}", "")).alias("content"),
        ),
    )
    return F.filter(turns, lambda t: t["content"] != "")


def chat_clean(c: Column) -> Column:
    return strip(F.regexp_replace(squeeze(c), ROLE, ""))


def chat_format(turns: Column) -> Column:
    """Turns as ``[role]: content`` lines."""
    return F.transform(turns, lambda t: F.concat(F.lit("["), t["role"], F.lit("]: "), t["content"]))


def shipment_events(c: Column) -> Column:
    """Array of ``{shipment_id, events}``; a text without id markers is one ``Unknown`` shipment."""
    text = F.coalesce(c, F.lit(""))
    parts = F.filter(F.split(text, f"(?={SHIPMENT})"), lambda p: p.rlike(f"^{SHIPMENT}"))
    last = F.size(parts) - 1

    def body(p: Column, i: Column) -> Column:
        rest = F.regexp_replace(p, f"^{SHIPMENT}", "")
        # only the last shipment ends at the end marker
        cut = F.element_at(F.split(F.regexp_replace(rest, f"^{SHIPMENT_END}", ""), SHIPMENT_END, 2), 1)
        return F.when(i == last, cut).otherwise(rest)

    def events(t: Column) -> Column:
        def is_event(m: Column) -> Column:
            return ~(m.startswith("[Shipment ID]:") | m.startswith("End of Ship Track Event"))

        return F.filter(dialogue_split(t), is_event)

    named = F.transform(
        parts,
        lambda p, i: F.struct(
            F.regexp_extract(p, f"^{SHIPMENT}", 1).alias("shipment_id"), events(body(p, i)).alias("events")
        ),
    )
    single = F.array(F.struct(F.lit("Unknown").alias("shipment_id"), dialogue_split(text).alias("events")))
    found = F.when(F.size(parts) > 0, named).otherwise(single)
    return F.filter(found, lambda s: F.size(s["events"]) > 0)


def strip_arrival_prefix(c: Column) -> Column:
    marker = "[Arrival Time]:"
    return F.when(c.startswith(marker), strip(F.replace(c, F.lit(marker), F.lit("")))).otherwise(c)


def add_parsed_columns(
    df: DataFrame, dialogue: str = "dialogue_x", shiptrack: str = "shiptrack_event_history_by_order"
) -> DataFrame:
    if dialogue in df.columns:
        df = df.withColumn(f"{dialogue}_parsed", dialogue_split(F.col(dialogue)))
    if shiptrack in df.columns:
        df = df.withColumn("shiptrack_parsed", shipment_events(F.col(shiptrack)))
    return df


def message_totals(df: DataFrame, messages: str, shipments: str) -> DataFrame:
    """Totals of messages, shipments and events over all rows."""
    events = F.aggregate(shipments, F.lit(0), lambda acc, s: acc + F.size(s["events"]))
    return df.agg(
        F.sum(F.size(messages)).alias("messages"),
        F.sum(F.size(shipments)).alias("shipments"),
        F.sum(events).alias("events"),
    )
