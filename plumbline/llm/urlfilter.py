"""URL filters: explicit host and path rules first, then association rules mined from labels.

A URL's tokens are its scheme, host suffixes, the words of its host and of its path, its extension
and its query keys. FP-growth mines token combinations over the labelled URLs, with the
label as one more item; rules `tokens => bad` of up to MAX_TOKENS tokens are kept that reach the
least support (a share of the labelled pages, and MIN_COUNT bad pages), the least confidence, and the
least lift over the share of bad pages; and of those only such as no kept rule with
fewer of the same tokens makes redundant. They are matched by an inverted index: each rule stands under
that of its tokens which fewest URLs have, a URL's tokens look rules up there, and a rule holds if
the URL has all its tokens. DataFrame functions and Spark's FP-growth only.

Defined cases: a null url, or one without "://", has an empty host and path and only the
empty token list; equal URLs get equal verdicts; labels of null count as good; a page with
several labels is bad if one of them says so; without labelled URLs no rule is mined; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.6
#: Least number of bad pages behind a rule, and least ratio of its confidence to the share of bad pages.
MIN_COUNT, MIN_LIFT = 8, 1.5
#: Most tokens of a rule.
MAX_TOKENS = 3
#: Up to so many mined rules are broadcast; beyond, the rule index is joined by a shuffle.
BROADCAST_RULES = 20_000
BAD = "=bad"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, k), F.lit(""))


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased."""
    return F.translate(_part(url, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return _part(url, 2)


def explicit_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the (verdict, host, path) rules that fit, as a struct(rule, verdict); null if none does."""
    found: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; none without ://."""
    labels = F.split(host(url), "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    apart = "[^\\p{L}\\p{N}]+"
    names = F.transform(F.split(host(url), apart), lambda w: F.concat(F.lit("w:"), w))
    words = F.transform(F.split(F.lower(path(url)), apart), lambda w: F.concat(F.lit("p:"), w))
    keys = F.transform(
        F.split(F.regexp_extract(F.coalesce(url, F.lit("")), "\\?([^#]*)", 1), "&"),
        lambda q: F.concat(F.lit("q:"), F.lower(F.substring_index(q, "=", 1))),
    )
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(url, "://", 1))))
    every = F.array_distinct(F.concat(scheme, suffixes, names, words, keys))
    useful = F.filter(every, lambda t: F.length(t) > 2)
    return F.when(F.instr(F.coalesce(url, F.lit("")), "://") > 0, useful).otherwise(F.array().cast("array<string>"))


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT,
    min_lift: float = MIN_LIFT,
) -> DataFrame:
    """labelled(tokens, bad) -> (antecedent, confidence, support) of the rules tokens => bad, pruned."""
    items = F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens"))
    baskets = materialize(labelled.select(items.alias("items")).filter(F.size("items") > 0), "baskets")
    total, bad = baskets.agg(F.count("*"), F.sum(F.array_contains("items", BAD).cast("int"))).first()
    least = min(1.0, max(min_support, (min_count - 0.5) / max(total, 1)))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).select("antecedent", "confidence", "support")
    rules = rules.filter((F.size("antecedent") <= MAX_TOKENS) & (F.col("confidence") * max(total, 1) >= min_lift * (bad or 0)))
    rules = materialize(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "rules")
    # A rule is redundant if one with a token fewer is kept and as sure.
    less = rules.select(
        F.explode(F.sequence(F.lit(0), F.size("antecedent") - 1)).alias("i"), "antecedent", "confidence", "support"
    ).filter(F.size("antecedent") > 1)
    shorter = F.filter("antecedent", lambda t, k: k != F.col("i"))
    redundant = less.select("antecedent", "confidence", shorter.alias("general")).join(
        rules.select(F.col("antecedent").alias("general"), F.col("confidence").alias("sure")), "general"
    ).filter("sure >= confidence").select("antecedent").distinct()
    return rules.join(redundant, "antecedent", "left_anti")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of urls(url, tokens), distinct, that some rule fits: (url)."""
    rules = materialize(rules.withColumn("rule", F.monotonically_increasing_id()), "kept-rules")
    if (n := rules.count()) == 0:
        return urls.select("url").limit(0)
    small = F.broadcast if n <= BROADCAST_RULES else lambda frame: frame  # a rule has MAX_TOKENS tokens at most
    held = rules.select("rule", "antecedent", F.explode("antecedent").alias("token"))
    looked = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    frequency = looked.join(small(held.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    index = held.join(frequency, "token").groupBy("rule").agg(
        F.min_by("token", F.struct("n", "token")).alias("token"), F.first("antecedent").alias("antecedent")
    )
    index = small(materialize(index, "rule-index"))
    return looked.join(index, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0).select("url").distinct()


def judge(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, min_lift: float = MIN_LIFT,
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    labels(doc_id, quality, toxic) tell of the page with that id: bad if quality is 0 or toxic is 1."""
    rows = pages.select("page_id", "url")
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    known = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    told = rows.join(known, "page_id").select(tokens(F.col("url")).alias("tokens"), "bad")
    mined = mine(told, min_support, min_confidence, min_count, min_lift)
    urls = rows.filter("url is not null").select("url").distinct().select("url", tokens(F.col("url")).alias("tokens"))
    blocked = match(urls, mined).withColumn("mined", F.lit(True))
    # Null urls have no tokens; they stay out of the join, where they would meet in one task.
    joined = rows.filter("url is not null").join(blocked, "url", "left").select("page_id", "url", "mined")
    joined = joined.union(rows.filter("url is null").select("page_id", "url", F.lit(None).cast("boolean")))
    parts = joined.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "mined")
    return parts.withColumn("r", explicit_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"),
    )
