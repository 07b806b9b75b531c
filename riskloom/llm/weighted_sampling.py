"""Document fingerprints by consistent weighted sampling.

Terms are five-word shingles weighted by their number of occurrences. For every sample k and
term, gamma variates r and c of shape 2 and a uniform b follow from hash bits, and with weight w

    t = floor(ln w / r + b),   ln a = ln c - r (t - b + 1)

the term of the smallest a is the sample, identified by the term and t. Two documents take the
same sample with a probability equal to the generalised Jaccard similarity of their weights
(sum of minima over sum of maxima), so the share of equal components estimates it.

Every (term, sample) has variates of its own, drawn in an order that makes the common weight of
one cheap. With w = 1, t is 0 and a is exponential of rate 1, so a increases with a uniform: the
mixed hash itself is compared. Only repeated terms need the rest, drawn given a: r (1 - b) and
r b are independent exponentials of rate 1, and given a the first is ln(1 + e / a) with another
such exponential e, hence c = a + e. The a of a repeated term is turned back into the scale of
hashes. A component is written as 16 bits, a document as ``samples`` components in hex.

Documents are dealt to buckets by id ranges and sorted by falling id inside them, so texts are
shuffled once; the first document of each bucket is also sent to the bucket before it, as the
next document of that bucket's last. Ids must be numbers. Null ids come last; rows of equal id
follow in the order of a hash of their text. A null or empty text has no terms: its fingerprint
is all ``f``, equal to itself (likeness 1) and unlike any other (0). A text shorter than five
words is one term. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskloom.llm.common import chunks, stage

SHINGLE = 5
NONE = 0xFFFF


def _mix(h: np.ndarray, factor: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(factor)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _uniform(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0 and below 1."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Sampler:
    """Signatures of ``samples`` components; the same seed gives the same signatures everywhere."""

    def __init__(self, samples: int = 128, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.samples = samples
        self.factor = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
        self.place = rng.integers(0, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.words: dict[bytes, int] = {}

    @staticmethod
    def _heavy(mixed: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a in the scale of hashes, identity) of terms with weight e**ln_w."""
        a = -np.log1p(-_uniform(mixed))
        e, v = -np.log(_uniform(_mix(mixed, 0xD6E8FEB86659FD93))), -np.log(_uniform(_mix(mixed, 0xA0761D6478BD642F)))
        r = np.log1p(e / a) + v
        t = np.floor((ln_w + v) / r)
        least = np.exp(np.log(a + e) - r * (t + 1.0) + v)
        key = np.minimum(-np.expm1(-least) * 2.0**64, 2.0**64 - 2048.0).astype(np.uint64)
        first = t == 0  # as with weight one
        return np.where(first, mixed, key), np.where(first, mixed, _mix(mixed + t.astype(np.uint64), 0xE7037ED1A0B428DB))

    def _word_hashes(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        known = self.words
        if len(known) > 500_000:  # a memo only: emptied, not kept growing
            known.clear()
        out = [known.get(w) or known.setdefault(w, xxh64_intdigest(w)) for w in words]
        return np.array(out, dtype=np.uint64)

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct term hashes and their weights."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        h = self._word_hashes(words)
        if len(words) < SHINGLE:
            mixed = (h * self.place[: len(words)]).sum(keepdims=True) + self.place[SHINGLE : SHINGLE + 1] * np.uint64(len(words))
        else:
            n = len(words) - SHINGLE + 1
            mixed = h[:n] * self.place[0]
            for k in range(1, SHINGLE):
                mixed = mixed + h[k : n + k] * self.place[k]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return np.unique(mixed ^ (mixed >> np.uint64(29)), return_counts=True)

    def signatures(self, texts: list[str]) -> np.ndarray:
        """One row of 16-bit components per text."""
        out = np.full((len(texts), self.samples), NONE, dtype=np.uint16)
        found = [self.terms(t) for t in texts]
        filled = [i for i, (h, _) in enumerate(found) if len(h)]
        if not filled:
            return out
        hashes = np.concatenate([found[i][0] for i in filled])
        weights = np.concatenate([found[i][1] for i in filled])
        starts = np.concatenate(([0], np.cumsum([len(found[i][0]) for i in filled])))[:-1]
        heavy = np.flatnonzero(weights > 1)
        ln_w = np.log(weights[heavy])
        owner = np.repeat(np.arange(len(filled)), np.diff(np.append(starts, len(hashes))))[heavy]
        best = np.empty((self.samples, len(filled)), dtype=np.uint64)
        for k in range(self.samples):
            key = hashes * self.factor[k]
            key += self.shift[k]
            if not len(heavy):
                best[k] = np.minimum.reduceat(key, starts)
                continue
            key[heavy], identity = self._heavy(key[heavy], ln_w)
            best[k] = least = np.minimum.reduceat(key, starts)
            won = np.flatnonzero(key[heavy] == least[owner])
            best[k][owner[won]] = identity[won]
        best = _mix(best, 0xD6E8FEB86659FD93)
        # 16 bits of the identity; the value that stands for "no terms" is never used
        out[filled] = np.minimum(best.T >> np.uint64(48), np.uint64(NONE - 1)).astype(np.uint16)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal components, row by row; 1 for two texts without terms."""
    return (a == b).mean(axis=1)


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the next text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def _fingerprint(samples: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples, seed)
        names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held: list[tuple] = []  # the last row, whose next one is still to come

        def flush(rows: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            sizes = [r[3].encode("utf-8", "surrogatepass") for r in rows]
            for start, stop in chunks(sizes[:-1], 1 << 20):
                part = rows[start : stop + 1]
                texts = [r[3] for r in part]
                own = [i for i in range(len(part) - 1) if not part[i][1]]
                if not own:
                    continue
                edited = [edited_text(texts[i], texts[i + 1]) for i in own]
                plain = sampler.signatures(texts)
                changed = sampler.signatures(edited)
                at = np.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part[i][2] for i in own], kind),
                        pa.array([len(texts[i]) for i in own], pa.int64()),
                        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                        pa.array(_hex(plain[at])),
                        pa.array(_hex(changed)),
                        pa.array(likeness(plain[at], changed)),
                        pa.array(likeness(plain[at], plain[at + 1])),
                    ],
                    names=names,
                )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_bucket", "_ahead", "_id", "_t")]
            rows = held + list(zip(*columns, strict=True))
            yield from flush(rows, batch.schema.field("_id").type)
            held = rows[-1:]

    return run


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = 128, seed: int = 42, spread: int = 4
) -> DataFrame:
    """Per row: id, ``n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    ``spread``: id ranges per shuffle partition.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_t"))
    ranges = spread * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = rows.agg(F.percentile_approx("_id", shares, 10 * ranges)).first()[0]  # one id per range
    bounds = np.unique(np.array(cuts or [], dtype=np.float64))

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        values = ids.cast(pa.float64(), safe=False)
        at = len(bounds) - np.searchsorted(bounds, values.fill_null(-np.inf).to_numpy(zero_copy_only=False), "right")
        return pa.array(at.astype(np.int32))

    rows = rows.withColumn("_bucket", bucket("_id"))
    # the first row of each bucket is the next one of the last row of the bucket before
    firsts = rows.groupBy("_bucket").agg(F.max(F.struct("_id", "_h")).alias("_first"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("_bucket")  # one row per range
    back = F.coalesce(F.lag("_bucket").over(in_order), F.max("_bucket").over(Window.partitionBy(F.lit(0))))
    firsts = firsts.select(back.alias("_to"), F.col("_first._id").alias("_fid"), F.col("_first._h").alias("_fh"))
    firsts = stage(firsts, "firsts")
    own = rows.select("_bucket", F.lit(False).alias("_ahead"), "_id", "_h", "_t")
    is_first = rows["_id"].eqNullSafe(firsts["_fid"]) & (rows["_h"] == firsts["_fh"])
    ahead = rows.join(F.broadcast(firsts), is_first).select(F.col("_to"), F.lit(True), "_id", "_h", "_t")
    order = ["_bucket", "_ahead", F.col("_id").desc_nulls_last(), F.col("_h").desc()]
    dealt = own.unionAll(ahead).repartition("_bucket").sortWithinPartitions(*order).drop("_h")
    kind = rows.schema["_id"].dataType.simpleString()
    schema = (
        f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return dealt.mapInArrow(_fingerprint(samples, seed), schema).withColumnRenamed("_id", id_col)
