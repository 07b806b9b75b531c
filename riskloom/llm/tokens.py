"""Token ids of texts, from public vocabulary files whose path is a parameter."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
LONG = 50_000  # a run of white space beyond this overflows the stack of the fast encoder
_SPACES = re.compile(r"\s{%d}" % LONG)


@lru_cache(maxsize=4)
def _encoders(vocabulary: str, ranks: str):
    """The vocabulary in two libraries. Their ids were compared on every code point of Unicode
    and agree; tests/llm repeats it on those below U+3000 and every 97th beyond.

    The second is four times as fast; the first is used for what the second cannot encode.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary)
    with open(public_tokenizers.path(ranks) if "/" not in ranks else ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return slow, fast


def encode(text: str | None, special: bool = True, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> list[int]:
    """Ids of a text (null: none). ``special``: the text of the special token is that token, else ordinary text."""
    if not text:
        return []
    slow, fast = _encoders(vocabulary, ranks)
    runs = len(text) >= LONG and _SPACES.search(text)
    if runs or (special and SPECIAL in text):
        slow.encode_special_tokens = not special
        return slow.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def crc32_of(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
