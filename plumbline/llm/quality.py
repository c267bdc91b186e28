"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean Column that is true for a rejected text. A text is split into words and
lines once, and every measure is taken from those. `order_rules` times every rule on
a bounded sample that holds what the plan has at hand when the rule is asked, takes off what
a job costs that asks none, and counts what the rule rejects; rules are sorted by rejections per second.
`cascade` nests them in that order into one CASE, so that a later rule is evaluated only for
texts that all earlier ones let pass. The order changes how long a verdict takes and never the
verdict, which is the disjunction of all rules.

Defined cases: null and blank texts have no words, fail `base` and are rejected; a text
of one huge line or word is measured whole; repeated rows are judged alike; an empty
table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, let, materialize, words

#: Rows used to estimate the cost and selectivity of the rules.
SAMPLE_ROWS = 2000
#: Longest text in that sample.
SAMPLE_CHARS = 1 << 15


#: Times that a rule is timed on the sample, after one run that compiles it.
TRIALS = 2


def lines(text: Column) -> Column:
    """The \\n-split lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACES}]"))


def _covered(hashes: Column, width: int) -> Column:
    """How many word positions lie in windows whose hash occurs twice or more."""

    def positions(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(
        let(ordered, positions),
        lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))),
            F.lit(0),
            lambda a, b: a + b,
        ),
    )


def n_repeat_words(w: Column, width: int = 5) -> Column:
    """Words in windows of `width` words that are found twice or more, the first one included."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h, width)).otherwise(0))
    return F.when(F.size(w) >= width, counted).otherwise(0)


@dataclass(frozen=True)
class Rule:
    """rejects(metric) is true for a bad text; metric gives the named measure of this text as a Column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


#: Measures of a text, from the text, its words and its lines.
METRICS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "n_words": lambda t, w, l: F.size(w),
    "word_chars": lambda t, w, l: F.length(F.array_join(w, "")),
    "n_symbols": lambda t, w, l: _count(t, "[#*$%&|<>]"),
    "n_dup_lines": lambda t, w, l: F.size(l) - F.size(F.array_distinct(l)),
    "n_repeat_words": lambda t, w, l: n_repeat_words(w),
    "n_lines": lambda t, w, l: F.size(l),
    "n_bangs": lambda t, w, l: _count(t, "!"),
    "n_upper": lambda t, w, l: _count(t, "\\p{Lu}"),
}
#: Those that `judge` returns.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(text: Column, names: tuple[str, ...]) -> Column:
    """A struct of the named measures; words and lines are found once."""
    found = F.struct(words(text).alias("w"), lines(text).alias("l"))
    return let(found, lambda x: F.struct(*[METRICS[n](text, x["w"], x["l"]).cast("long").alias(n) for n in names]))


#: Rejects what is short or repeats itself.
BASE_RULES = (
    Rule("too_few_words", lambda m: m("n_words") < 10),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
)

#: The method's own rules, with limits far from what prose shows.
RULES = (
    Rule("symbols", lambda m: 100 * m("n_symbols") > 20 * m("n_words")),
    Rule("exclamations", lambda m: 100 * m("n_bangs") > 50 * m("n_words")),
    Rule("capitals", lambda m: 100 * m("n_upper") > 50 * m("word_chars")),
    Rule("duplicate_lines", lambda m: 100 * m("n_dup_lines") > 60 * m("n_lines")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
)


def sample_of(docs: DataFrame, text: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(t): at most `sample_rows` texts of SAMPLE_CHARS or fewer.

    take() reads as few partitions as hold that many rows, whatever the size of docs; longer
    texts are left out of the sample, and only of the sample."""
    rows = docs.select(F.col(text).alias("t")).filter(F.coalesce(F.length("t"), F.lit(0)) <= SAMPLE_CHARS).take(sample_rows)
    return docs.sparkSession.createDataFrame(rows, "t string")


def order_rules(sample: DataFrame, rules: tuple[Rule, ...], metric: Callable[[str], Column]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, rejected share) on a sample that has the columns which metric reads, best rejection per second first."""
    held = materialize(sample, "rule-sample")

    def seconds(asked: Column) -> tuple[float, int]:
        took = []
        for _ in range(1 + TRIALS):
            began = time.perf_counter()
            n = held.agg(F.sum(asked.cast("long"))).first()[0]
            took.append(time.perf_counter() - began)
        return min(took[1:]), n or 0

    idle, rows = seconds(F.lit(True))
    found = []
    for rule in rules:
        took, rejected = seconds(F.coalesce(rule.rejects(metric), F.lit(False)))
        found.append((rule, max(took - idle, 1e-4), rejected / max(rows, 1)))
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(rules: list[Rule] | tuple[Rule, ...], metric: Callable[[str], Column]) -> Column:
    """The first rule, in the given order, that rejects the text; null if none does."""
    out: Column = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        out = F.when(F.coalesce(rule.rejects(metric), F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def _from_parts(text: Column, w: Column, l: Column) -> Callable[[str], Column]:
    return lambda name: METRICS[name](text, w, l)


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, columns unchanged."""
    t = F.col("t")
    sample = sample_of(docs, text).select("t", words(t).alias("w"), lines(t).alias("l"))
    ordered = [x[0] for x in order_rules(sample, rules, _from_parts(t, F.col("w"), F.col("l")))]
    t = F.col(text)
    found = F.struct(words(t).alias("w"), lines(t).alias("l"))
    return docs.filter(let(found, lambda x: cascade(ordered, _from_parts(t, x["w"], x["l"]))).isNull())


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All measures of each text, base_failed and kept. The measures are shared by the cascade."""

    def measured(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("m", measures(F.col("t"), (*REPORTED, "n_lines")))
        return rows.select(*[c for c in rows.columns if c != "m"], "m.*")

    def metric(name: str) -> Column:
        return F.col(name) if name in (*REPORTED, "n_lines") else METRICS[name](F.col("t"), F.lit(None), F.lit(None))

    ordered = [x[0] for x in order_rules(measured(sample_of(docs, text)), rules, metric)]
    base = cascade(BASE_RULES, metric)
    return measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))).select(
        "doc_id", *REPORTED, base.isNotNull().alias("base_failed"),
        F.when(base.isNotNull(), F.lit(False)).otherwise(cascade(ordered, metric).isNull()).alias("kept"),
    )
