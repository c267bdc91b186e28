"""Columns that make or read text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a file that a format is told from.
SNIFF_BYTES = 4096

# Formats by extension.
EXTENSIONS = {
    "landxml": ("xml",), "carlson-dtm": ("tin",), "dxf": ("dxf",), "dwg": ("dwg",),
    "geotiff": ("tif", "tiff", "geotiff"), "pdf": ("pdf",), "las": ("las",),
}


def sniff(name: Column, head: Column) -> Column:
    """Format of a file by its first characters (Latin-1), else by its name's extension."""
    h = F.substring(head, 1, SNIFF_BYTES)
    out = (
        F.when(h.contains("<LandXML"), "landxml")
        .when(h.contains("#Carlson DTM"), "carlson-dtm")
        .when(h.rlike("(^|\\r?\\n)[ \\t]*0[ \\t]*\\r?\\n[ \\t]*SECTION") | h.contains("AutoCAD"), "dxf")
        .when(h.rlike("^AC10[0-9][0-9]"), "dwg")
        .when(h.startswith("II*\0") | h.startswith("MM\0*"), "geotiff")
        .when(h.startswith("%PDF-"), "pdf")
        .when(h.startswith("LASF"), "las")
    )
    ext = F.lower(F.substring_index(name, ".", -1))
    for kind, names in EXTENSIONS.items():
        out = out.when(ext.isin(*names), kind)
    return out.otherwise("unknown")


def compact(n: Column, largest: str = "B") -> Column:
    """1.2M and the like: three digits at most before the letter, but for the `largest` one, and one decimal below 100 of it."""
    out = None
    steps = ((1_000_000_000, "B"), (1_000_000, "M"), (1_000, "K"), (1, ""))
    steps = steps[[letter for _, letter in steps].index(largest) :]
    for k, (size, letter) in enumerate(steps):
        tenths = F.floor(n * 10 / size + 0.5)
        whole = F.floor(n / size + 0.5)
        text = F.when(tenths < 1000, F.concat(
            F.floor(tenths / 10).cast("string"),
            F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""),
        )).otherwise(whole.cast("string"))
        text = F.concat(text, F.lit(letter))
        least = size if k == len(steps) - 1 else size - size / 2000
        out = F.when(n >= least, text) if out is None else out.when(n >= least, text)
    return out.otherwise("0")


def byte_size(n: Column) -> Column:
    """Bytes with a binary unit: none or one decimal."""
    label = lambda size, unit: F.concat(
        F.when(n / size >= 100, F.format_string("%.0f", n / size)).otherwise(F.format_string("%.1f", n / size)), F.lit(f" {unit}")
    )
    return (
        F.when(n.isNull() | (n < 0), "--")
        .when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, label(1024.0, "KB"))
        .when(n < 1024**3, label(1024.0**2, "MB"))
        .when(n < 1024**4, label(1024.0**3, "GB"))
        .otherwise(label(1024.0**4, "TB"))
    )


def escape_xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def decimals(literal: Column) -> Column:
    """Decimal places that a number is written with."""
    return F.length(F.regexp_extract(literal, "\\.([0-9]*)", 1)).cast("int")


def numbers(text: Column) -> Column:
    """struct(values, max_decimals, bad) of a list of numbers parted by white space."""
    tokens = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), "\\s+"), lambda t: t != "")
    read = F.transform(tokens, lambda t: t.try_cast("double"))
    good = F.filter(tokens, lambda t: t.try_cast("double").isNotNull())
    return F.struct(
        F.filter(read, lambda v: v.isNotNull()).alias("values"),
        F.coalesce(F.array_max(F.transform(good, decimals)), F.lit(0)).alias("max_decimals"),
        (F.size(tokens) - F.size(good)).alias("bad"),
    )


def clean_crs(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(text, "\\x00", ""), "[|\\s]+", " ")), F.lit(""))


def trimmed_number(value: Column, places: int = 2) -> Column:
    return F.regexp_replace(F.format_string(f"%.{places}f", value), "\\.?0+$", "")


def header_sha(preamble: Column, size: Column) -> Column:
    """SHA-256 of a file's first bytes and its size in decimal digits."""
    return F.sha2(F.concat(preamble, F.encode(size.cast("string"), "UTF-8")), 256)


def decode_entities(text: Column) -> Column:
    """The five named entities of XML; others are left as they are."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def boundary_kind(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin("island", "include", "inclusion"), "inclusion").when(
        low.isin("void", "exclude", "exclusion"), "exclusion"
    ).otherwise("outer")


def linear_unit(raw: Column) -> Column:
    """The linear unit of a surface file: feet of two kinds, or metres, also where it is missing or unknown."""
    r = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(F.contains(r, F.lit("ussurvey")), "usSurveyFoot").when(F.contains(r, F.lit("foot")) | F.contains(r, F.lit("feet")), "foot").otherwise("meter")


def linear_unit_note(raw: Column) -> Column:
    """Why `linear_unit` had to guess; null where it did not. Fixed values."""
    known = F.lower(raw).rlike("ussurvey|foot|feet|met")
    unknown = F.concat(F.lit('unrecognized linearUnit "'), raw, F.lit('" — assuming meter'))
    return F.when(raw.isNull(), "no <Units> element — assuming meter").when(~known, unknown)
