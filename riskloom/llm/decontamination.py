"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Texts are normalised by lower-casing A-Z and taking the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
(ASCII letters and digits, and all other characters). A window is ``size`` consecutive words of
an item; an item of fewer words, but not none, is one window. The automaton's alphabet are the
words of the items: a document is scanned once, as the sequence of its words' codes, where any
word that no item has is code 0. Places found are mapped back to code points of the original text.

Bounds: an automaton holds about ``most_windows`` windows (100,000 by default, 1 million nodes at
most with windows of ten words, about 90 MB a task), each with the items that contain it. Their
number is counted first. More windows are dealt by hash into several automata, the documents are
scanned once by each, and the findings for a text are united, so no window is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.common import stage, text_bytes

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: byte by byte: A-Z lower-cased, what separates words to a space
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
PIECE = 1 << 20  # bytes split into words at a time
PASSAGE = "struct<first_word: bigint, n_words: bigint, start: bigint, end: bigint>"


class Windows:
    """An automaton over windows, each with the items that contain it."""

    def __init__(self, pairs: Iterable[tuple[str, str | None]]):
        import ahocorasick

        self.codes: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        numbers: dict[str, int] = {}
        self.longest = 0
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for text, item in pairs:
            number = numbers.get(text)
            if number is None:
                number = numbers[text] = len(self.items)
                self.items.append(set())
                words = text.encode().split(b" ")
                key = tuple(self.codes.setdefault(w, len(self.codes) + 1) for w in words)
                self.automaton.add_word(key, (len(key), number))
                self.longest = max(self.longest, len(key))
            if item is not None:
                self.items[number].add(item)
        if self.items:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        """Number of words; passages (first word, words, start, end), apart and in order; items found."""
        plain = text.translate(FOLD)
        code, count, start, carry = self.codes.get, 0, 0, []
        spans: list[tuple[int, int]] = []
        numbers = set()
        while start < len(plain):
            end = plain.find(b" ", min(start + PIECE, len(plain)))
            end = len(plain) if end < 0 else end
            codes = carry + [code(w, 0) for w in plain[start:end].split()]
            first = count - len(carry)
            if self.items:
                for last, (length, number) in self.automaton.iter(tuple(codes)):
                    spans.append((first + last + 1 - length, first + last + 1))
                    numbers.add(number)
            count = first + len(codes)
            carry = codes[len(codes) - min(len(codes), self.longest - 1) :] if self.longest > 1 else []
            start = end
        passages = located(text, plain, merged(spans)) if spans else []
        return count, passages, sorted(set().union(*(self.items[n] for n in numbers)))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def located(text: bytes, plain: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(first word, words, start, end): where spans of words stand in the original, in code points."""
    letter = np.concatenate(([False], np.frombuffer(plain, dtype=np.uint8) != 32, [False]))
    change = np.flatnonzero(letter[1:] != letter[:-1])
    begins, ends = change[::2], change[1::2]
    heads = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80  # first bytes of code points
    out, at, passed = [], 0, 0
    for a, b in spans:
        start, end = int(begins[a]), int(ends[b - 1])
        passed += int(np.count_nonzero(heads[at:start]))
        inside = int(np.count_nonzero(heads[start:end]))
        out.append((a, b - a, passed, passed + inside))
        at, passed = end, passed + inside
    return out


_ready: dict[str, Windows] = {}  # the automaton a worker built last


def _scan(pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = pairs.value[0]
        if key not in _ready:
            _ready.clear()
            _ready[key] = Windows(pairs.value[1])
        windows = _ready[key]
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "n_words", "start", "end")]))
        for batch in batches:
            found = [windows.scan(t) for t in text_bytes(batch.column("_text"))]
            passages = [[dict(zip(("first_word", "n_words", "start", "end"), p, strict=True)) for p in f[1]] for f in found]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array(passages, kind), pa.array([f[2] for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), *columns], names=["_id", "_key", "n_words", "passages", "items"])

    return run


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Distinct (window, item) of all items; the item's id as text."""
    text = F.translate(F.col(f"`{text_col}`").cast("string"), UPPER, LOWER)
    words = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.regexp_extract_all(text, F.lit(WORD), 0).alias("_w"))
    words = words.filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("_w", i, size), " "))
    return words.select(F.explode(windows).alias("window"), "item").distinct()


def _united(found: list[DataFrame]) -> DataFrame:
    """The findings of several automata for each distinct (id, text): passages and items united."""
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    # equal rows have equal findings, so copies leave before the lists of a text meet
    every = every.dropDuplicates(["_id", "_key", "passages", "items"])
    lists = every.groupBy("_id", "_key").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("passages"))).alias("_p"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def join(done, p):
        last = F.element_at(done, -1)
        end = F.greatest(last["first_word"] + last["n_words"], p["first_word"] + p["n_words"])
        wide = F.struct(
            last["first_word"].alias("first_word"), (end - last["first_word"]).alias("n_words"),
            last["start"].alias("start"), F.greatest(last["end"], p["end"]).alias("end"),
        )
        touches = p["first_word"] <= last["first_word"] + last["n_words"]
        body = F.slice(done, 1, F.size(done) - 1)
        return F.when(F.size(done) == 0, F.array(p)).when(touches, F.concat(body, F.array(wide))).otherwise(F.concat(done, F.array(p)))

    passages = F.aggregate("_p", F.lit(None).cast(f"array<{PASSAGE}>"), lambda done, p: join(F.coalesce(done, F.array().cast(f"array<{PASSAGE}>")), p))
    return lists.select("_id", "_key", "n_words", F.coalesce(passages, F.array().cast(f"array<{PASSAGE}>")).alias("passages"), "items")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    most_windows: int = 100_000,
) -> DataFrame:
    """One row per document: its id, ``n_words``, the ``passages`` inside windows, the ``items`` with windows in it.

    A passage is a struct of its first word, number of words, and its start and end (exclusive)
    in code points of the original text; passages that overlap or touch are one. ``items`` are
    distinct ids as text, in text order.

    A null or empty text has no words and no passages. A null or empty item has no window; the
    windows of an item without id mark words, but it is not listed. Repeated items count once,
    repeated documents and null ids are kept row by row. Other columns are not read, whatever their
    names. No items: nothing is found; no documents: an empty result.
    """
    spark = docs.sparkSession
    windows = stage(item_windows(items, item_col, item_text_col, size), "windows")
    blocks = max(1, -(-windows.count() // most_windows))
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"))
    keyed = rows.withColumn("_key", F.lit("") if blocks == 1 else F.sha2(F.coalesce("_text", F.lit("")), 256))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _key string, n_words bigint, passages array<{PASSAGE}>, items array<string>"
    found = []
    for block in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == block)
        pairs = [(r["window"], r["item"]) for r in part.toLocalIterator()]  # about most_windows rows
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, pairs))
        found.append(keyed.mapInArrow(_scan(shared), schema))
    if blocks == 1:
        result = found[0]
    else:
        united = stage(_united(found), "findings")
        same = F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._key") == F.col("b._key"))
        result = keyed.select("_id", "_key").alias("a").join(united.alias("b"), same).select("b.*")
    return result.select(F.col("_id").alias(id_col), "n_words", "passages", "items")
