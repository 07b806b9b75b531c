"""Periodic runs of words, found by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q (words q apart are identical)
and at least ``min_length`` and ``min_exponent`` times q words, which no neighbouring word
extends keeping period q.

The words are appended one by one to a suffix automaton. Its suffix links form a tree in which
the suffixes of the text read so far are the path from the newest state to the root. A link-cut
tree keeps that tree as preferred paths, each a splay tree whose root carries one colour: the
position where all strings of its states last ended. Reading word i accesses the newest state.
The access meets the path from the newest state as segments of equal colour, recolours them to i
and joins them to one preferred path. A segment that last ended at e, and whose longest string
has L words, says that the last L words stood i - e words before as well. With L >= i - e this
is a square, a repetition of smallest period d = i - e that begins at i - d - L + 1. It is
extended to a run by the later words that yield the same beginning and period. The number of
segments met is O(n log n) for n words.

Not every word needs the automaton. Every ``window(min_length, min_exponent)`` consecutive words
of a run (five, with the defaults) stand in that run again, one period before or behind. A text
is cut where its windows stand only once in it, and each stretch is cut again by its own windows
until nothing changes: a run never spans a cut, so each stretch is read by an automaton of its
own. The windows are compared by hash; equal hashes of unequal windows only leave a stretch
longer. A text without stretches costs no automaton.

Every text is read whole, by the task that reads its row; nothing is shuffled or collected.
Memory is linear in the longest stretch, about half a kilobyte per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.common import text_bytes

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def window(min_length: int, min_exponent: int) -> int:
    """Words of the longest window that stands twice in every run, wherever it lies in the run.

    A window of k words of a run of n words and period q stands there again if k <= n - 2q + 1.
    """
    below, above = min_length // min_exponent, -(-min_length // min_exponent)
    sizes = [max(min_length, min_exponent * q) - 2 * q + 1 for q in {below, above} if q]
    return max(1, min(sizes))


class RunFinder:
    """Reads words one by one and keeps the repetitions of at least ``min_exponent`` periods.

    States are numbered from 1, the empty string; 0 stands for none.
    """

    def __init__(self, min_exponent: int):
        self.factor = min_exponent - 1
        self.length, self.link = [0, 0], [0, 0]
        self.next: list[dict] = [{}, {}]
        self.last = 1
        self.up, self.left, self.right = [0, 0], [0, 0], [0, 0]  # splay trees; a tree's root points up to the path above
        self.colour = [-1, -1]  # at the root of a splay tree: where its strings last ended
        self.found: dict[tuple[int, int], int] = {}  # (start, period) to last word

    def _state(self, length: int, link: int, following: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        self.up.append(link)
        self.left.append(0)
        self.right.append(0)
        self.colour.append(-1)
        return len(self.length) - 1

    def _append(self, word: int) -> int:
        """Extend the automaton by a word; returns the state of the whole text."""
        nexts, link, length = self.next, self.link, self.length
        state = self._state(length[self.last] + 1, 0, {})
        p = self.last
        while p and word not in nexts[p]:
            nexts[p][word] = state
            p = link[p]
        if not p:
            target = 1
        else:
            q = nexts[p][word]
            target = q if length[q] == length[p] + 1 else self._split(p, q, word)
        link[state] = self.up[state] = target
        self.last = state
        return state

    def _split(self, p: int, q: int, word: int) -> int:
        """Divide state q: its strings up to one word longer than p's become a state above q."""
        nexts, link = self.next, self.link
        above = self._state(self.length[p] + 1, link[q], nexts[q].copy())
        link[q] = above
        while p and nexts[p].get(word) == q:
            nexts[p][word] = above
            p = link[p]
        # the new state stands directly above q on q's preferred path and shares its colour
        self._splay(q)
        upper = self.left[q]
        self.left[above] = upper
        if upper:
            self.up[upper] = above
        self.left[q] = above
        self.up[above] = q
        return above

    def _splay(self, x: int) -> None:
        """Make x the root of its splay tree."""
        up, left, right, colour = self.up, self.left, self.right, self.colour
        f = up[x]
        while f and (left[f] == x or right[f] == x):
            g = up[f]
            straight = g and ((left[g] == f and left[f] == x) or (right[g] == f and right[f] == x))
            bent = g and not straight and (left[g] == f or right[g] == f)
            for y in (f, x) if straight else (x, x) if bent else (x,):
                z = up[y]
                if left[z] == y:
                    child = left[z] = right[y]
                    right[y] = z
                else:
                    child = right[z] = left[y]
                    left[y] = z
                if child:
                    up[child] = z
                above = up[z]
                up[y] = above
                up[z] = y
                if above and left[above] == z:
                    left[above] = y
                elif above and right[above] == z:
                    right[above] = y
                else:  # y is the root now
                    colour[y] = colour[z]
            f = up[x]

    def read(self, words: Sequence[int]) -> None:
        up, right, colour, length, factor, found = self.up, self.right, self.colour, self.length, self.factor, self.found
        splay = self._splay
        for i, word in enumerate(words, self.length[self.last]):
            at, below = self._append(word), 0
            newest = at
            while at:
                splay(at)
                ended = colour[at]
                rest = right[at]
                if rest:  # longer strings that do not end here keep their colour
                    colour[rest] = ended
                if ended >= 0:
                    period = i - ended
                    longest = length[at]
                    if longest >= factor * period:
                        found[i - longest - period + 1, period] = i
                right[at] = below
                below, at = at, up[at]
            colour[below] = i
            splay(newest)


def stretches(marks: np.ndarray, size: int, least: int) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` words outside of which no window of ``size`` words stands twice in its stretch."""
    if len(marks) < least:
        return []
    grams = marks[: len(marks) - size + 1].copy()
    for k in range(1, size):
        grams *= MULTIPLIER
        grams += marks[k : len(marks) - size + 1 + k]
    ready, open_ = [], [(0, len(grams))]
    while open_:
        start, end = open_.pop()
        piece = grams[start:end]
        order = np.argsort(piece)
        same = np.diff(piece[order]) == 0
        twice = np.zeros(len(piece), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if twice.all():
            ready.append((start, end + size - 1))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], twice.view(np.int8), [0]))))
        parts = edges.reshape(-1, 2)
        long = parts[parts[:, 1] - parts[:, 0] + size - 1 >= least]
        open_.extend((start + int(a), start + int(b)) for a, b in long)
    return sorted(ready)


def find_runs(words: Sequence[bytes], min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    marks = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    size = window(min_length, min_exponent)
    runs = []
    for start, end in stretches(marks, size, max(min_length, size)):
        codes: dict[bytes, int] = {}
        finder = RunFinder(min_exponent)
        finder.read([codes.setdefault(w, len(codes)) for w in words[start:end]])
        for (first, period), last in finder.found.items():
            if last - first + 1 >= min_length:
                runs.append((start + first, last - first + 1, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that any run contains after its first period."""
    if not runs:
        return b" ".join(words)
    dropped = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        dropped[start + period : start + length] = True
    return b" ".join(words[i] for i in np.flatnonzero(~dropped).tolist())


def _read(min_length: int, min_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            runs, texts, counts = [], [], []
            for text in text_bytes(batch.column("_text")):
                words = text.split()  # bytes: split at the six ASCII white spaces alone
                found = find_runs(words, min_length, min_exponent)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(collapse(words, found).decode("utf-8", "replace"))
                counts.append(len(words))
            columns = [batch.column("_id"), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """One row per document: its id, ``n_words``, ``runs`` (start, length, period) and the ``collapsed`` text.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words, no runs and an empty
    collapsed text. Null and repeated ids and equal rows are kept row by row. Runs that begin
    together are told apart by their periods. Other columns are not read, whatever their names;
    an empty table gives an empty result.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has at least two periods and two words")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, n_words bigint, runs array<{RUN}>, collapsed string"
    return rows.mapInArrow(_read(min_length, min_exponent), schema).withColumnRenamed("_id", id_col)

