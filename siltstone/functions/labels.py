"""Labels, display texts and small parses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import columns as C

#: Ordered rules from a file name to a source type; the first that matches wins.
FILE_RULES = (
    (r"rbi|reserve.?bank", "rbi"), (r"sebi", "sebi"), (r"\bmca\b|company.?law", "mca"), (r"annual.?report|\bar\d{2}", "annual_report"),
    (r"transcript|concall|earnings.?call", "earnings_transcript"), (r"broker|research|initiat", "broker_research"), (r"tax|gst", "tax_law"), (r"news|press", "news"), (r"blog", "blog"),
)

FILLERS = ("the", "a", "an", "of", "and", "to", "in", "for", "on", "with", "is", "are", "will")


def first_rule(text: Column, rules=FILE_RULES, default: str = "unknown") -> Column:
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return out


def file_year(name: Column) -> Column:
    return F.regexp_extract(name, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1).try_cast("int")


def display(value: Column, unit: Column) -> Column:
    """``4.20%``, ``25 bps``, ``₹1,234 crore``, or the number as it is."""
    whole = F.format_number(value, 0)
    plain = lambda x: F.replace(x, F.lit(","), F.lit(""))
    return (
        F.when(unit.isin("%", "per cent", "per_cent"), F.concat(plain(F.format_number(value, 2)), F.lit("%")))
        .when(unit.isin("bps", "basis points"), F.concat(plain(whole), F.lit(" bps")))
        .when(unit.isin("crore", "cr", "lakh", "mn", "bn"), F.concat(F.lit("₹"), whole, F.lit(" "), unit))
        .otherwise(value.cast("string"))
    )


def short_label(text: Column, most_words: int = 5, most_chars: int = 40) -> Column:
    words = F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: ~F.lower(w).isin(list(FILLERS)))
    return F.initcap(F.substring(F.array_join(F.slice(words, 1, most_words), " "), 1, most_chars))


def excerpt(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def risk_flag(score: Column) -> Column:
    return F.when(score >= 8, "HIGH").when(score >= 5, "MEDIUM").otherwise("LOW")


def similarity_label(score: Column) -> Column:
    return F.when(score >= 0.8, "Very High").when(score >= 0.6, "High").when(score >= 0.4, "Moderate").otherwise("Low")


def strength_of(text: Column) -> Column:
    """A strength class from free wording; anything else is Weak."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("strong", "high", "robust"), "Strong").when(t.isin("medium", "moderate", "mixed"), "Medium").otherwise("Weak")


def repaired_json(text: Column) -> Column:
    """The outermost object of a text that should be JSON: fences off, literals and trailing commas mended."""
    t = F.regexp_replace(text, r"```(?:json)?", "")
    t = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    for pattern, by in ((r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\bNone\b", "null"), (r",\s*([}\]])", "$1")):
        t = F.regexp_replace(t, pattern, by)
    return t


def is_financial_table(headers: Column, rows: Column, keywords: tuple[str, ...] = ("total", "amount", "crore", "ratio", "revenue", "profit", "%")) -> Column:
    """At least two headers and rows, and a keyword in the headers or a number in the first three rows."""
    worded = F.exists(headers, lambda h: C.contains_any(F.lower(h), keywords))
    numbered = F.exists(F.slice(rows, 1, 3), lambda r: F.exists(r, lambda c: c.rlike(r"^\s*[0-9][0-9,.]*\s*$")))
    return (F.size(headers) >= 2) & (F.size(rows) >= 2) & (worded | numbered)
