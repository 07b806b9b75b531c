"""URL filter: explicit host and path rules, and token rules mined by FP-growth.

A URL's tokens are its scheme, its host labels, and the words of path, query and fragment. Spark's FP-growth
mines token combinations of the URLs labelled "block"; rules stay if
enough blocked URLs have them and their confidence among all labelled URLs is high enough, and if no rule with fewer
tokens is as confident. A rule is filed in an inverted index under its rarest token. URLs meet the index by
their tokens, and a rule matches when all its tokens are there. Only distinct URLs
are matched, so a page that is met often costs one row.

Null URLs and URLs without ``://`` have an empty host and path and no tokens; they are allowed.
Labels of null ids, and null labels, teach nothing; with no labels there are no mined rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.common import hash_sample, stage

#: (rule, verdict): host, then path; a rule holds for subdomains too
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``; path: from there up to ``? #``; else both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    found = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def tokens(url: Column) -> Column:
    """Distinct scheme, host labels, and words of path, query and fragment, marked by where they stand.

    The fragment is what follows the first ``#`` after the scheme, the query what stands between
    the first ``?`` and it.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    scheme = F.when(at > 0, ascii_lower(F.substring(url, F.lit(1), at - 1)))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host, path = host_and_path(url)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(rest, r"^[^#]*#([\s\S]*)", 1)

    def marked(mark: str, words: Column) -> Column:
        return F.transform(words, lambda x: F.concat(F.lit(mark), x))

    found = [marked("s:", F.array(F.coalesce(scheme, F.lit("")))), marked("h:", F.split(host, r"\."))]
    for mark, text in (("p:", path), ("q:", query), ("f:", fragment)):
        found.append(marked(mark, F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")))
    return F.array_distinct(F.filter(F.concat(*found), lambda x: F.length(x) > 2))


def mine_rules(labelled: DataFrame, min_count: int = 20, min_confidence: float = 0.5) -> DataFrame:
    """``tokens, confidence, support`` of the rules for "block" from ``_tokens, _block`` rows.

    Token combinations are mined from the blocked rows: at least ``min_count`` of them have the
    tokens of a rule, however many rows there are. The other rows that have them are counted by
    looking each combination up under its rarest token, so confidence is exact.
    """
    spark = labelled.sparkSession
    baskets = stage(labelled.select(F.col("_tokens").alias("items"), "_block").filter(F.size("items") > 0), "baskets")
    blocked = baskets.filter("_block").select("items")
    n, n_blocked = baskets.count(), blocked.count()
    if n_blocked < min_count:
        return spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    # the miner rounds up support times rows; half a row less keeps that at min_count
    model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / n_blocked).fit(blocked)
    sets = stage(model.freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("_both")), "sets")
    # equal baskets are looked up once; they are few bytes but much work, so they are dealt to all cores
    allowed = baskets.filter("NOT _block").groupBy(F.array_sort("items").alias("_tokens")).agg(F.count(F.lit(1)).alias("_n"))
    allowed = stage(allowed, "allowed")
    filed = inverted_index(sets.select("tokens"), allowed)
    spread = allowed.repartition(2 * spark.sparkContext.defaultParallelism, "_tokens")
    met = spread.select("_tokens", "_n", F.explode("_tokens").alias("token")).join(filed, "token")
    met = met.filter(F.size(F.array_except("tokens", "_tokens")) == 0).groupBy("tokens").agg(F.sum("_n").alias("_other"))
    both = sets.join(met, "tokens", "left").withColumn("freq", F.col("_both") + F.coalesce("_other", F.lit(0)))
    confidence = F.col("_both") / F.col("freq")
    rules = both.filter(confidence >= min_confidence)
    rules = stage(rules.select("tokens", confidence.alias("confidence"), (F.col("_both") / n).alias("support")), "rules")
    # drop a rule if one with fewer of its tokens is as confident: look its parts up, one token left out at a time
    part = F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part")
    parts = rules.select("tokens", "confidence", part)
    shorter = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("c"))
    idle = parts.join(shorter, "part").filter("c >= confidence").select("tokens").distinct()
    return stage(rules.join(idle, "tokens", "left_anti"), "rules")


def inverted_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Each rule under the token of it that occurs in the fewest URLs."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode("_tokens").alias("token")).groupBy("token").count()
    rare = wanted.join(seen, "token", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    filed = rules.select("*", F.explode("tokens").alias("token")).join(rare, "token")
    best = filed.groupBy(*rules.columns).agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return stage(best, "index")


def judge(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    rules: Sequence[tuple[str, str]] = RULES,
    max_labelled: int = 20_000,
    **mining: float,
) -> DataFrame:
    """Per page: id, ``host, path, rule, verdict``, and the ``confidence`` of the mined rule that matched.

    ``labels`` has 0/1 columns ``quality`` and ``toxic``; a page is labelled "block" when the row
    with its id says quality 0 or toxic 1, "allow" when it says neither. Rules are learnt from at
    most ``max_labelled`` labelled pages, the first in hash order of id and URL, and judge every page.

    Repeated pages are judged, and teach, once each; a URL is read whole, however long. Other columns are not read, whatever their names; no pages give
    no rows, and without enough blocked labels nothing is mined.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), host.alias("host"), path.alias("path"))
    urls = stage(rows.select("_url").distinct().withColumn("_tokens", tokens(F.col("_url"))), "urls")

    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    known = labels.filter(F.coalesce("quality", "toxic").isNotNull()).groupBy(F.col(label_id).alias("_id"))
    known = known.agg(F.max(bad).alias("_block"))
    labelled = rows.join(known, "_id").withColumn("_tokens", tokens(F.col("_url")))
    labelled = hash_sample(labelled, max_labelled, "_id", "_url")
    index = inverted_index(mine_rules(labelled, **mining), urls)

    met = urls.select("_url", "_tokens", F.explode("_tokens").alias("token")).join(index, "token")
    matched = met.filter(F.size(F.array_except("tokens", "_tokens")) == 0)
    mined = stage(matched.groupBy("_url").agg(F.max("confidence").alias("confidence")), "matched")

    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return rows.join(mined, "_url", "left").select(
        F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), "confidence"
    )
