"""Column expressions that operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon


def lookup(key: Column, values: dict, default) -> Column:
    """A small constant table as a map literal, with a default for other keys."""
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(pairs[F.lower(key)], F.lit(default))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays, summed in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def authority(source_type: Column, weights: dict | None = None, default: float = 0.20) -> Column:
    return lookup(source_type, weights or lexicon.AUTHORITY, default)


def authority_share(weight: Column, low: float = 0.15, high: float = 1.0) -> Column:
    """Authority spread over 0 to 1."""
    return F.round(clip((weight - low) / (high - low), 0.0, 1.0), 6)


def recency_cosine(day: Column, as_of: Column, full_days: int = 180, end_days: int = 730, floor: float = 0.05, unknown: float = 0.40) -> Column:
    """1 up to ``full_days``, then half a cosine down to the floor; dates in the future count 1."""
    age = F.datediff(as_of, day)
    wave = (1 + F.cos(math.pi * (age - full_days) / (end_days - full_days))) / 2
    return F.when(day.isNull(), F.lit(unknown)).when(age <= full_days, F.lit(1.0)).when(age >= end_days, F.lit(floor)).otherwise(F.round(floor + (1 - floor) * wave, 6))


def recency_linear(day: Column, as_of: Column, days: int = 365, unknown: float = 0.5) -> Column:
    age = F.greatest(F.datediff(as_of, day), F.lit(0))
    return F.when(day.isNull(), F.lit(unknown)).otherwise(F.greatest(F.lit(0.0), 1 - age / F.lit(days)))


def lenient_date(text: Column) -> Column:
    """A date from ISO, day-first, month-name, year-month or bare-year text; else null."""
    t = F.trim(text)
    tries = [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")]
    month = F.when(t.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(F.concat(t, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date"))
    year = F.when(t.rlike(r"^(19|20)\d{2}$"), F.try_to_timestamp(F.concat(t, F.lit("-01-01")), F.lit("yyyy-MM-dd")).cast("date"))
    inside = F.try_to_timestamp(F.nullif(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(*tries, month, year, inside)


def words(text: Column) -> Column:
    """Distinct lower-case words of two or more letters, digits or accented letters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2))


def recall(query: Column, found: Column) -> Column:
    """Share of the query's terms among those found; 0 for no terms."""
    n = F.size(query)
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(query, found)) / n, 6))


def jaccard(a: Column, b: Column, digits: int = 4) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0.0)).otherwise(F.round(both / either, digits))


def closed_terms(terms: Column, spellings: dict[str, str]) -> Column:
    """Terms with the other spelling of each: a long form for its acronym and the other way round."""
    both = spellings | {long: short for short, long in spellings.items()}
    known = F.create_map(*[F.lit(x) for pair in both.items() for x in pair])
    return F.array_distinct(F.concat(terms, F.filter(F.transform(terms, lambda t: known[t]), lambda t: t.isNotNull())))


def contains_any(text: Column, phrases) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def severity(pct: Column, minor: float = 5.0, moderate: float = 20.0) -> Column:
    return F.when(pct < minor, "Minor").when(pct < moderate, "Moderate").otherwise("Major")


def slug(text: Column, most: int = 60) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), F.lit("_")), 1, most)


def cache_key(namespace: str, text: Column, *extras: Column) -> Column:
    """Namespace and md5 of the text, lower-cased and with white space collapsed, and of further parts."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.concat(F.lit(f"{namespace}:"), F.md5(F.concat_ws("|", flat, *extras)))


def token_estimate(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")
