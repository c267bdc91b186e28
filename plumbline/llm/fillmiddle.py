"""Fill-in-the-middle transformation of documents, in DataFrame functions only.

A text is split into units (lines, unless another pattern is given), two cuts among its n + 1
places are drawn from a hash of seed and document id, and the three parts are arranged as prefix,
suffix, middle (psm) or suffix, prefix, middle (spm) behind one sentinel each. `restore` takes the
output apart at its sentinels and joins the parts in their first order. The draw depends on
nothing but seed and id, so that a lost task gives the same rows again.

Defined cases: a null text is an empty one; an empty text, a text that holds a sentinel and a text
that the rate leaves out are `plain`: their output is the text itself. A null id is hashed as an empty one.
What no unit of the pattern covers would be lost, so that such a text is plain, too. Texts are never cut short; one text and its
output must fit into a string of Spark's. Repeated rows give equal rows, ties of the
two cuts give an empty middle, an empty table gives an empty result. All columns of the input
pass through, whatever their names; only one named like the result (`out`) is replaced by it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let

#: Lines with their line ends.
LINES = "[^\\n]*\\n|[^\\n]+"


@dataclass(frozen=True)
class Sentinels:
    """Marks before prefix, suffix and middle. No mark may hold another one or begin as one ends, or outputs could be read in two ways."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                meets = any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (i != j)))
                if not a or meets or i != j and b in a:
                    raise ValueError(f"sentinels {a!r} and {b!r} can't be told apart")

    @property
    def pattern(self) -> str:
        return "|".join(re.sub(r"([^\w ])", r"\\\1", x) for x in (self.prefix, self.suffix, self.middle))


@dataclass(frozen=True)
class Shares:
    """Percentages: of texts that are transformed, and of those that put the suffix first."""

    transformed: int = 100
    suffix_first: int = 50


def _hash_group(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentinels: Sentinels = Sentinels(),
    shares: Shares = Shares(), seed: int = 7, units: str = LINES, out: str = "fim",
) -> DataFrame:
    """docs, with column `out`, a struct(n_units, form, prefix_chars, middle_chars, output); the lengths are null if the form is plain.

    Each step is a projection of its own: regular expression and digest are found once a row."""
    row = "__row"
    while row in docs.columns:
        row += "_"
    t, u, d = (F.col(f"{row}.{x}") for x in "tud")
    first = F.struct(F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = F.struct(
        t.alias("t"), F.regexp_extract_all(t, F.lit(units), F.lit(0)).alias("u"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256).alias("d"),
    )
    cut = [_hash_group(d, k) % (F.size(u) + 1) for k in (0, 1)]
    holds = F.contains(t, F.lit(sentinels.prefix)) | F.contains(t, F.lit(sentinels.suffix)) | F.contains(t, F.lit(sentinels.middle))
    plain = (t == "") | holds | (_hash_group(d, 2) % 100 >= shares.transformed) | (F.array_join(u, "") != t)
    form = F.when(plain, "plain").when(_hash_group(d, 3) % 100 < shares.suffix_first, "spm").otherwise("psm")
    cuts = F.struct(t.alias("t"), u.alias("u"), F.least(*cut).cast("int").alias("i"), F.greatest(*cut).cast("int").alias("j"), form.alias("f"))
    i, j, n = F.col(f"{row}.i"), F.col(f"{row}.j"), F.size(u)
    part = lambda a, size: F.array_join(F.slice(u, a, size), "")
    parts = F.struct(
        t.alias("t"), n.cast("long").alias("n"), F.col(f"{row}.f").alias("f"),
        part(F.lit(1), i).alias("p"), part(i + 1, j - i).alias("m"), part(j + 1, n - j).alias("s"),
    )
    p, m, s, f = (F.col(f"{row}.{x}") for x in "pmsf")
    marks = {"p": F.lit(sentinels.prefix), "s": F.lit(sentinels.suffix), "m": F.lit(sentinels.middle)}
    arranged = F.when(f == "plain", t).when(f == "spm", F.concat(marks["s"], s, marks["p"], p, marks["m"], m))
    arranged = arranged.otherwise(F.concat(marks["p"], p, marks["s"], s, marks["m"], m))
    made = F.struct(
        F.col(f"{row}.n").alias("n_units"), f.alias("form"), F.when(f != "plain", F.length(p)).cast("long").alias("prefix_chars"),
        F.when(f != "plain", F.length(m)).cast("long").alias("middle_chars"), arranged.alias("output"),
    )
    rows = docs
    for step in (first, found, cuts, parts):
        rows = rows.withColumn(row, step)
    return rows.withColumn(out, made).drop(row)


def restore(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that an output of `transform` was made from: what stands behind the sentinels, in its first order."""

    def joined(x: Column) -> Column:
        part = [F.get(x, F.lit(k)) for k in range(4)]
        return F.when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.concat(part[1], part[3], part[2]))

    return F.when(form == "plain", output).otherwise(let(F.split(output, sentinels.pattern, -1), joined))
