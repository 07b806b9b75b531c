"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

1. **Targets.** The sources share ``share`` times all words by weight; a target stops at
   ``max_copies`` times its source's words and the excess goes to the others by weight.
2. **Expected copies.** A document of weight w is expected ``e = min(max_copies, k w)`` times,
   with k per source such that the expected words equal the target. The weight is the number
   of binary digits of the word count, so fragments are repeated less than full texts; it takes
   few values, and k is solved on one row per source and value.
3. **Certain copies.** ``floor(e)`` whole copies are taken at once.
4. **Pareto order sampling** for the rest: with inclusion probability ``p = e - floor(e)`` and
   a uniform number u from the hash of id and text, documents are ranked by the ratio of random odds
   ``u / (1 - u)`` to inclusion odds ``p / (1 - p)``, and taken in this order while their words
   fit the source's remaining target. The sample size is fixed in words, not random.
5. **Last document.** Of the documents not reached, the one whose words come nearest to the
   words still missing is added if that brings the source nearer to its target.

The order is never sorted as a whole: words are summed per source and rank bucket, and only
the bucket that holds the cut is sorted, so a source with a third of all rows is spread over
all tasks. Equal rows are counted before they are sorted. All sums are of whole numbers, so
reruns agree.

Sizes and states: nulls and empty texts have size 0 and are never taken. A null source is a
source of its own, last in order. Rows equal in id and text differ by the hash of their other
columns; rows equal in all columns stand in a row, and where the cut falls among them, or the
last document is one of them, as many are taken as fit: they are interchangeable, so they are
counted, and the count is dealt out again. So repeated rows, and rows without id, do not
overshoot a target. An empty table gives no rows.
The per-source tables have one row per source, which are the entries a mix is configured by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.llm.common import WORD, stage, unwrap, whole_row

BUCKETS = 4096
#: equal rows that are dealt out together
DEAL = 8192
#: order of the sample; rows that agree in it are interchangeable
ORDER = ("_q", "_id", "_m", "_r")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _binary_digits(size: Column) -> Column:
    return F.length(F.bin(size)).cast("double")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_copies: float) -> DataFrame:
    """``_s, source_size, target`` per source of ``sizes(_s, _source, _m)``; weights repeat in source order."""
    per = sizes.groupBy("_s", "_source").agg(F.sum("_m").alias("source_size"))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("_source").asc_nulls_last()))
    per = per.withColumn("_w", F.element_at(pattern, (place - 1) % len(weights) + 1))
    cap = F.lit(float(max_copies)) * F.col("source_size")
    per = per.withColumn("_cap", cap).withColumn("_level", F.col("_cap") / F.col("_w"))
    # sources in the order in which they reach their cap; the level is what an uncapped source gets per weight
    order = everything.orderBy("_level", "_source")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    left = F.lit(float(share)) * total - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))
    weight_left = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_candidate", left / weight_left)
    # the first source that does not reach its cap sets the level; none: all are at their caps
    level = F.min(F.when(F.col("_candidate") < F.col("_level"), F.struct("_level", "_source", "_candidate"))).over(everything)
    per = per.withColumn("_set", level)
    reached = F.col("_set").isNull() | (F.col("_level") <= F.col("_set._candidate"))
    target = F.when(reached, F.col("_cap")).otherwise(F.col("_w") * F.col("_set._candidate"))
    return per.select("_s", "source_size", target.alias("target"))


def _copies_per_weight(classes: DataFrame, targets: DataFrame, max_copies: float) -> DataFrame:
    """``k`` and the words left to sample, per source. ``classes``: words per source and weight."""
    own = Window.partitionBy("_s")
    falling = own.orderBy(F.col("_w").desc())
    capped_words = F.coalesce(F.sum("_m").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    load = F.sum(F.col("_w") * F.col("_m")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    k = (F.col("target") - float(max_copies) * capped_words) / F.nullif(load, F.lit(0.0))
    solved = classes.join(targets, "_s").withColumn("_k", k)
    fits = F.col("_k") * F.col("_w") <= float(max_copies)
    first = F.max(F.when(fits, F.struct("_w", "_k"))).over(own)
    solved = solved.withColumn("_k", first["_k"])
    certain = F.floor(expected_copies(F.col("_k"), F.col("_w"), max_copies)) * F.col("_m")
    return solved.groupBy("_s").agg(
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.first("_k").alias("_k"),
        (F.first("target") - F.sum(certain)).alias("_rest"),
    )


def expected_copies(k: Column, weight: Column, max_copies: float) -> Column:
    return F.coalesce(F.least(F.lit(float(max_copies)), k * weight), F.lit(float(max_copies)))


def _uniform(id_col: Column, text: Column, seed: str) -> Column:
    """A number between 0 and 1 from the hash of id and text."""
    told = F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit(""))))
    return (F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _rank(u: Column, size: Column, expected: Column) -> Column:
    """Random odds over inclusion odds; null where nothing is left to chance."""
    p = expected - F.floor(expected)
    return F.when((p > 0) & (size > 0), (u / (1.0 - u)) / (p / (1.0 - p)))


def _row_hash(df: DataFrame) -> Column:
    """Hash of all columns that Spark can hash: not of maps and variants."""
    kinds = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return F.xxhash64(F.lit(0), *[F.col(f"`{name}`") for name, kind in kinds if "map<" not in kind and "variant" not in kind])


def _bucket(rank: Column) -> Column:
    return F.floor(rank / (1.0 + rank) * float(BUCKETS)).cast("int")


class Mix:
    """The plan of a mix: a small table per source, and the copies of a row as an expression of it."""

    def __init__(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
        weights: Sequence[float] = (5, 2, 1),
        share: float = 1.5,
        max_copies: float = 2.0,
        seed: str = "",
    ):
        self.names = (id_col, text_col, source_col)
        self.max_copies, self.seed = max_copies, seed
        rows = self._keyed(docs, F.col(source_col).alias("_source"))
        self.rows = stage(rows, "sizes")
        classes = stage(self.rows.groupBy("_s", "_source", "_w").agg(F.sum("_m").alias("_m")), "classes")
        targets = source_targets(classes, weights, share, max_copies)
        self.plan = self._cut(stage(_copies_per_weight(classes, targets, max_copies), "shares"))

    def _keyed(self, docs: DataFrame, *more: Column) -> DataFrame:
        """Source key, id, size, weight, random number and hash of every row."""
        id_col, text_col, source_col = self.names
        rows = docs.select(
            *more,
            F.col(id_col).alias("_id"),
            _source_key(F.col(source_col)).alias("_s"),
            word_count(F.col(text_col)).alias("_m"),
            _uniform(F.col(id_col), F.col(text_col), self.seed).alias("_u"),
            _row_hash(docs).alias("_r"),
        )
        return rows.withColumn("_w", _binary_digits(F.col("_m")))

    def _placed(self, rows: DataFrame) -> DataFrame:
        e = expected_copies(F.col("_k"), F.col("_w"), self.max_copies)
        placed = rows.withColumn("_e", e).withColumn("_q", _rank(F.col("_u"), F.col("_m"), F.col("_e")))
        return placed.withColumn("_b", _bucket(F.col("_q")))

    def _cut(self, shares: DataFrame) -> DataFrame:
        ranked = self._placed(self.rows.join(shares.select("_s", "_k", "_rest"), "_s")).filter("_q IS NOT NULL")
        buckets = ranked.groupBy("_s", "_rest", "_b").agg(F.sum("_m").alias("_m"))
        running = F.sum("_m").over(Window.partitionBy("_s").orderBy("_b"))  # at most BUCKETS rows of a source
        buckets = buckets.withColumn("_upto", running)
        edge = buckets.filter((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_m") <= F.col("_rest")))
        edge = stage(edge.select("_s", F.col("_b").alias("_edge"), (F.col("_upto") - F.col("_m")).alias("_before")), "edges")

        # inside the bucket of the cut: equal rows counted, then in order as long as they fit
        inside = ranked.join(edge, "_s").filter("_b = _edge")
        inside = inside.groupBy("_s", "_rest", "_before", *ORDER).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum(F.col("_n") * F.col("_m")).over(Window.partitionBy("_s").orderBy(*ORDER))
        inside = inside.withColumn("_sum", F.col("_before") + upto)
        # of the first equal rows that do not all fit, those that do
        room = F.floor((F.col("_rest") - F.col("_sum")) / F.col("_m")) + F.col("_n")
        part = F.when((F.col("_sum") > F.col("_rest")) & (room > 0), F.struct(*ORDER, room.alias("_c")))
        fits = F.col("_sum") <= F.col("_rest")
        last = inside.groupBy("_s").agg(
            F.max(F.when(fits, F.struct(*ORDER))).alias("_last"),
            F.max(F.when(fits, F.col("_sum"))).alias("_sum"),
            F.min(part).alias("_part"),
        )
        cut = shares.join(edge, "_s", "left").join(last, "_s", "left")
        reached = F.coalesce("_sum", "_before") + F.coalesce(F.col("_part._c") * F.col("_part._m"), F.lit(0))
        cut = stage(cut.withColumn("_gap", F.col("_rest") - reached), "cuts")

        # the row beyond the cut whose words come nearest to the gap
        beyond = ranked.join(cut.select("_s", "_edge", "_last", "_gap"), "_s").filter(~self._before_cut())
        beyond = beyond.withColumn("_d", F.abs(F.col("_m") - F.col("_gap"))).filter("_d < _gap")
        nearest = stage(beyond.groupBy("_s").agg(F.min("_d").alias("_d")), "nearest")
        filler = beyond.join(nearest, ["_s", "_d"]).groupBy("_s", *ORDER).agg(F.count(F.lit(1)).alias("_n"))
        filler = filler.groupBy("_s").agg(F.min(F.struct(*ORDER, "_n")).alias("_fill"))
        return stage(cut.join(filler, "_s", "left"), "mix")

    @staticmethod
    def _before_cut() -> Column:
        inside = F.coalesce((F.col("_b") == F.col("_edge")) & (F.struct(*ORDER) <= F.col("_last")), F.lit(False))
        return F.col("_edge").isNull() | (F.col("_b") < F.col("_edge")) | inside

    @staticmethod
    def _is(name: str) -> Column:
        """The row is one of those that ``_part`` or ``_fill`` names."""
        named = F.struct(*[F.col(f"{name}.{c}").alias(c) for c in ORDER])
        return F.col(name).isNotNull() & F.coalesce(F.struct(*ORDER).eqNullSafe(named), F.lit(False))

    def with_copies(self, rows: DataFrame, *kept: str) -> DataFrame:
        """``kept``, the source's figures and ``_copies`` of the rows of ``_keyed``."""
        joined = self._placed(rows.join(self.plan, "_s"))
        certain, in_part, in_fill = F.floor("_e"), self._is("_part"), self._is("_fill")
        chance = F.col("_q").isNotNull() & (self._before_cut() | in_fill)
        copies = F.when(F.col("_m") > 0, certain + F.when(chance, 1).otherwise(0)).otherwise(0)
        figures = ["source_size", "target"]
        out = [*kept, *figures]
        if self.plan.filter("_part IS NOT NULL OR _fill._n > 1").isEmpty():
            return joined.select(*out, copies.cast("long").alias("_copies"))
        shared = in_part | (in_fill & (F.col("_fill._n") > 1))
        alone = joined.filter(~shared).select(*out, copies.cast("long").alias("_copies"))
        taken = F.when(in_part, F.col("_part._c")).otherwise(0) + F.when(in_fill, 1).otherwise(0)
        groups = joined.filter(shared).select("_s", *ORDER, F.struct(*out).alias("_out"), certain.alias("_whole"), taken.alias("_x"))
        groups = groups.groupBy("_s", *ORDER, "_whole", "_x").agg(F.count(F.lit(1)).alias("_n"), F.first("_out").alias("_out"))
        # a count is dealt out again in portions of DEAL rows, over all tasks
        portions = groups.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(DEAL).cast("long"))))
        portions = portions.repartition("_s", "_at")
        ends = F.least(F.col("_n"), F.col("_at") + DEAL) - 1
        dealt = portions.withColumn("_i", F.explode(F.sequence(F.col("_at"), ends)))
        one = (F.col("_whole") + F.when(F.col("_i") < F.col("_x"), 1).otherwise(0)).cast("long")
        return alone.unionByName(dealt.select("_out.*", one.alias("_copies")))

    def report(self) -> DataFrame:
        """Per input row: id, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted) and ``copies``."""
        return self.with_copies(self.rows, "_id", "_m").select(
            F.col("_id").alias(self.names[0]),
            F.col("_m").alias("size"),
            "source_size",
            "target",
            (F.col("_copies") * F.col("_m")).alias("taken"),
            F.col("_copies").alias("copies"),
        )

    def apply(self, docs: DataFrame) -> DataFrame:
        """The mixed rows: each row of ``docs`` as often as it is taken, with all its columns."""
        taken = self.with_copies(self._keyed(docs, whole_row(docs)), "_row").filter("_copies > 0")
        return unwrap(taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")))
