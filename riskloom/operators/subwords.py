"""Subword ids: the longest piece of a vocabulary at each place of a word, continuation pieces after the first.

A vocabulary is a text file, one piece per line, whose line numbers are the ids; pieces that
continue a word begin with ``##``. It goes to every task, so its size is checked.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CONTINUES = "##"
MOST_PIECES = 1_000_000
LONGEST_WORD = 100  # longer words are unknown
MEMO = 200_000  # words of a task whose ids are kept


def _separate(c: str) -> bool:
    """Punctuation and symbols, and characters of scripts without spaces, are words of their own."""
    if 33 <= ord(c) <= 126 and not c.isalnum():
        return True
    return unicodedata.category(c)[0] == "P" or 0x4E00 <= ord(c) <= 0x9FFF or 0x3400 <= ord(c) <= 0x4DBF or 0xF900 <= ord(c) <= 0xFAFF


def split_words(text: str, lower: bool = True) -> list[str]:
    """Words without control characters; lower case and without accents if asked."""
    if lower:
        text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    out: list[str] = []
    word: list[str] = []
    for c in text:
        if c.isspace() or _separate(c):
            if word:
                out.append("".join(word))
                word = []
            if not c.isspace():
                out.append(c)
        elif c != "�" and unicodedata.category(c)[0] != "C":
            word.append(c)
    if word:
        out.append("".join(word))
    return out


def words_of(text: Column, lower: bool = True) -> Column:
    """The words of a text as an array; none for NULL."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([split_words(t or "", lower) for t in texts.to_pylist()], pa.list_(pa.string()))

    return split(text)


@dataclass
class Pieces:
    """A vocabulary as a tree of characters: a node's children by character, and the id of the piece that ends there."""

    ids: Mapping[str, int]
    unknown: str = "[UNK]"
    start: str = "[CLS]"
    end: str = "[SEP]"
    pad: str = "[PAD]"
    lower: bool = True
    roots: tuple[dict, dict] = field(init=False)
    memo: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        missing = [s for s in (self.unknown, self.start, self.end, self.pad) if s not in self.ids]
        if missing:
            raise ValueError(f"special pieces are not in the vocabulary: {missing}")
        self.roots = ({}, {})
        for piece, number in self.ids.items():
            inner = piece.startswith(CONTINUES) and len(piece) > len(CONTINUES)
            node = self.roots[inner]
            for c in piece[len(CONTINUES) :] if inner else piece:
                node = node.setdefault(c, {})
            node[""] = number

    def word(self, word: str) -> list[int]:
        """Ids of a word; one unknown id if no pieces make it up."""
        known = self.memo.get(word)
        if known is not None:
            return known
        out: list[int] = []
        at = 0 if len(word) <= LONGEST_WORD else -1
        while 0 <= at < len(word):
            node, found, to = self.roots[at > 0], None, at
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if "" in node:
                    found, to = node[""], i + 1
            if found is None:
                at = -1
                break
            out.append(found)
            at = to
        if at < 0:
            out = [self.ids[self.unknown]]
        if len(self.memo) >= MEMO:  # a memo only: emptied, not kept growing
            self.memo.clear()
        self.memo[word] = out
        return out

    def encode(self, text: str, max_length: int | None = 512, special: bool = True) -> list[int]:
        """Ids of a text, special ones around it, cut so that all together are ``max_length``."""
        room = None if max_length is None else max(0, max_length - 2 * special)
        out: list[int] = []
        for w in split_words(text, self.lower):
            out += self.word(w)
            if room is not None and len(out) >= room:
                out = out[:room]
                break
        return [self.ids[self.start], *out, self.ids[self.end]] if special else out


def read_pieces(spark: SparkSession, path: str) -> dict[str, int]:
    """The vocabulary of a file that Spark can read; of a repeated piece the last line counts."""
    text = spark.read.text(path, wholetext=True).first()
    lines = text[0].splitlines() if text else []
    if len(lines) > MOST_PIECES:
        raise ValueError(f"a vocabulary of {len(lines)} pieces; at most {MOST_PIECES} can go to every task")
    return {line.rstrip(): i for i, line in enumerate(lines)}


def write_pieces(spark: SparkSession, pieces: Iterable[str], path: str) -> str:
    """A vocabulary file from a list of pieces; returns the name that Spark gave it."""
    spark.createDataFrame([("\n".join(pieces),)], "value string").coalesce(1).write.text(path)
    return path


def subword_chunks(
    df: DataFrame,
    chunks: Column,
    vocabulary: Mapping[str, int],
    out: str = "encoded",
    max_length: int | None = 512,
    special: bool = True,
    pad: bool = False,
    lower: bool = True,
    **special_names: str,
) -> DataFrame:
    """Add, for each non-blank chunk of an array of texts, ``input_ids`` and ``attention_mask``.

    With ``pad`` every list is ``max_length`` long. NULL chunks count as blank; NULL arrays give NULL.
    """
    pieces = Pieces(vocabulary, lower=lower, **special_names)
    filler = vocabulary[pieces.pad]
    kind = pa.list_(pa.struct([("input_ids", pa.list_(pa.int32())), ("attention_mask", pa.list_(pa.int32()))]))

    @F.arrow_udf("array<struct<input_ids: array<int>, attention_mask: array<int>>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for texts in batch.to_pylist():
                if texts is None:
                    rows.append(None)
                    continue
                row = []
                for text in texts:
                    if text and text.strip():
                        ids = pieces.encode(text, max_length, special)
                        short = max(0, max_length - len(ids)) if pad and max_length else 0
                        row.append({"input_ids": ids + [filler] * short, "attention_mask": [1] * len(ids) + [0] * short})
                rows.append(row)
            yield pa.array(rows, kind)

    return df.withColumn(out, encode(chunks))
