"""Checks of requests: theses before they run, batches, pairs to compare, urls and header lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: What speaks for a reason, a claim and a subject, as substrings.
REASONS = (
    "because", "since", "as ", "due to", "driven by", "given", "on account of", "owing to", "thanks to", "supported by", "underpinned by", "premised on", "assuming", "provided that",
    "if ", "when ", "unless", "subject to", "contingent on", "as a result", "therefore", "hence", "consequently", "this will", "which will", "leading to", "enabling", "allowing",
    "resulting in", "catalyst", "tailwind", "headwind", "rests on", "depends on", "hinges on",
)
CLAIMS = (
    "will ", "should ", "expect", "project", "forecast", "anticipate", "target", "estimate", "see ", "believe", "view", "think", "outperform", "underperform", "re-rate", "re-rating", "rerate",
    "expand", "compress", "grow", "decline", "rise", "fall", "improve", "deteriorate", "increase", "decrease", "accelerate", "decelerate", "beat", "miss", "upgrade", "downgrade",
    "buy", "sell", "hold", "strong buy", "accumulate", "reduce", "likely", "unlikely", "could ", "may ", "might ",
)
SUBJECTS = (
    "bank", "nbfc", "stock", "equity", "share", "bond", "fund", "index", "etf", "nifty", "sensex", "portfolio", "asset", "security", "debt", "credit", "yield", "spread", "rate",
    "commodity", "gold", "oil", "rupee", "dollar", "currency",
)


def thesis_preflight(theses: DataFrame, text: str = "text", companies: tuple[str, ...] = (), least_chars: int = 20, most_chars: int = 5000, least_words: int = 12) -> DataFrame:
    """``theses`` with n_words, has_subject, has_claim, has_reason, and refused: the first reason against a thesis, or null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    rows = (
        theses.withColumn("n_words", F.size(F.filter(F.split(low, r"\s+"), lambda w: w != "")))
        .withColumn("has_subject", C.contains_any(low, (*(c.lower() for c in companies), *SUBJECTS)))
        .withColumn("has_claim", C.contains_any(low, CLAIMS))
        .withColumn("has_reason", C.contains_any(low, REASONS))
    )
    refused = (
        F.when(t == "", "empty")
        .when(F.length(t) < least_chars, "too short")
        .when(F.length(t) > most_chars, "too long")
        .when(F.col("n_words") < least_words, "too brief")
        .when(~F.col("has_subject") & ~F.col("has_claim") & ~F.col("has_reason"), "no subject, claim or reason")
        .when(~F.col("has_subject"), "no subject")
        .when(~F.col("has_claim"), "no claim")
        .when(~F.col("has_reason"), "no reason")
    )
    return rows.withColumn("refused", refused)


def batch_checks(requests: DataFrame, batch: str, text: str = "text", most: int = 10) -> DataFrame:
    """batch, n, and refused: null for batches of one to ten queries, none of them blank."""
    blank = F.sum((F.trim(F.coalesce(text, F.lit(""))) == "").cast("int"))
    counts = requests.groupBy(batch).agg(F.count("*").alias("n"), blank.alias("n_blank"))
    return counts.select(batch, "n", F.when(F.col("n") > most, "too many queries").when(F.col("n_blank") > 0, "a blank query").alias("refused"))


def same_thesis(one: Column, two: Column) -> Column:
    """Whether two theses to be compared are the same text but for case and white space."""
    flat = lambda t: F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))
    return flat(one) == flat(two)


def url_refused(url: Column) -> Column:
    """Why a url is not fetched, or null: a scheme other than http and https, no host, or a host of a private network."""
    low = F.lower(F.trim(url))
    host = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0$|\[::1?\]$)")
    return F.when(~low.rlike(r"^https?://"), "scheme").when(host == "", "no host").when(private, "private host")


def is_iso_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def is_header_line(line: Column) -> Column:
    """3 to 80 characters, no long sentence, no number, and all in capitals or six tenths of its words capitalised."""
    t = F.trim(line)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^[A-Z]")))
    sentence = t.endswith(".") & (F.size(words) > 8)
    number = t.rlike(r"^[\d\s.,%₹$()-]+$")
    lettered = t.rlike(r"[A-Za-z]")
    return F.length(t).between(3, 80) & ~sentence & ~number & lettered & ((t == F.upper(t)) | (capital >= 0.6 * F.size(words)))
