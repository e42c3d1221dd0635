"""Cleaning, assembling, deduplicating and validating text, with built-in functions but for the many replacements of cleaning."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicon


def clean_steps(boilerplate=lexicon.BOILERPLATE) -> list[tuple[str, str]]:
    """Pattern and replacement of each step of ``cleaned``, in order; in RE2's syntax."""
    steps = [(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", " "), ("[–—•]", "-"), ("[‘’]", "'"), ("[“”]", '"'), ("\u00a0", " ")]
    steps += [(r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_]+)", r"\1\2")]
    steps += [(f"(?im){pattern}", " ") for pattern in boilerplate]
    steps += [(r"(?m)^\s*\d{1,4}\s*$", ""), (r"(?i)\bpage\s+\d+\s*(?:of\s+\d+)?\b", ""), ("[•◦▪▫►◄→←↑↓]", " ")]
    steps += [(f"[{mark}]{{{least},}}", " ") for mark, least in (("_", 3), ("-", 3), ("=", 3), ("*", 2))]
    steps += [(r"\b([A-Z])\s([A-Z])\s([A-Z])\s([A-Z])\b", r"\1\2\3\4"), (r"\b([A-Z])\s([A-Z])\s([A-Z])\b", r"\1\2\3")]
    steps += [(r"[ \t]{2,}|\t", " "), (r"\n{3,}", "\n\n"), (r" \n", "\n"), (r"\n ", "\n")]
    # lines of one or two characters that begin with no digit go, and spaces of lines that hold nothing else
    return [*steps, (r"(?m)^ *[^\d\n ][^\n ]? *(?:\n|\z)", ""), (r"(?m)^ +$", "")]


def cleaned(text: Column, boilerplate=lexicon.BOILERPLATE) -> Column:
    """Raw extracted text made readable: ordered replacements, then short orphan lines dropped.

    The thirty-odd replacements run on whole Arrow columns; as expressions of Spark each of them makes a Java string of the text and bytes of it again.
    One search for all patterns at once comes first: a text in which none is found stays as it is in every step, and only the others go through them.
    """
    steps = clean_steps(boilerplate)
    any_step = "|".join(f"(?:{pattern})" for pattern, _ in steps)

    def trimmed(out: pa.Array) -> pa.Array:
        return pc.ascii_trim(out, " \t\n\x0b\f\r")

    def replaced(out: pa.Array) -> pa.Array:
        for pattern, by in steps:
            out = pc.replace_substring_regex(out, pattern, by)
        return pc.replace_substring_regex(trimmed(out), r"\n{3,}", "\n\n")

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = pc.fill_null(texts, "")
        touched = pc.match_substring_regex(out, any_step)
        return pc.replace_with_mask(trimmed(out), touched, replaced(out.filter(touched)))

    return run(text)


def tags_stripped(html: Column) -> Column:
    """Tags to spaces, five common entities read, numeric ones dropped, white space collapsed; script bodies stay."""
    t = F.regexp_replace(html, r"<[^>]+>", " ")
    for entity, by in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        t = F.replace(t, F.lit(entity), F.lit(by))
    t = F.regexp_replace(t, r"&#\d+;", "")
    return F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "))


def repeated_lines(pages: DataFrame, least_pages: int = 5, least_chars: int = 5, fewest_pages: int = 3) -> DataFrame:
    """(document, line) of headers and footers: lines on so many distinct pages of a document. pages: document, page, text."""
    lines = pages.select("document", "page", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    counts = lines.filter(F.length("line") >= least_chars).distinct().groupBy("document", "line").agg(F.count("*").alias("n_pages"))
    enough = pages.groupBy("document").agg(F.count_distinct("page").alias("n")).filter(F.col("n") >= fewest_pages).select("document")
    return counts.filter(F.col("n_pages") >= least_pages).join(enough, "document", "left_semi")


def without_repeated_lines(pages: DataFrame, **limits) -> DataFrame:
    """The pages without such lines, lines in order."""
    lines = pages.select("document", "page", F.posexplode(F.split("text", "\n")).alias("n", "raw")).withColumn("line", F.trim("raw"))
    kept = lines.join(repeated_lines(pages, **limits).select("document", "line"), ["document", "line"], "left_anti")
    joined = kept.groupBy("document", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "raw"))), lambda s: s["raw"]), "\n").alias("text"))
    return pages.select("document", "page").join(joined, ["document", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def assembled(pages: DataFrame) -> DataFrame:
    """Non-empty pages of each document, trimmed, in order, parted by blank lines."""
    bare = pages.withColumn("text", F.trim("text")).filter("text <> ''")
    return bare.groupBy("document").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda s: s["text"]), "\n\n").alias("text"), F.count("*").alias("n_pages"))


def flagged_duplicates(docs: DataFrame, text: str = "text", tie: str = "doc_id") -> DataFrame:
    """content_hash, and whether an earlier row has the same: duplicates are flagged, not skipped.

    The first id of each hash comes from a grouped minimum, which is combined before the shuffle.
    """
    hashed = docs.withColumn("content_hash", F.md5(F.col(text).cast("binary")))
    first = hashed.groupBy("content_hash").agg(F.min(tie).alias("first_id"), F.count("*").alias("copies"))
    return hashed.join(first, "content_hash").withColumn("is_duplicate", F.col(tie) > F.col("first_id"))


def request_checks(requests: DataFrame, text: str = "text") -> DataFrame:
    """Why a query text is refused, or null: length 5 to 2000, two words, six tenths ASCII, no spam."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    ascii_share = F.length(F.regexp_replace(t, r"[^\x00-\x7F]", "")) / F.greatest(F.length(t), F.lit(1))
    reason = (
        F.when(F.length(t) < 5, "too short")
        .when(F.length(t) > 2000, "too long")
        .when(F.size(F.split(t, " ")) < 2, "one word")
        .when(ascii_share < 0.6, "not ascii")
        .when(t.rlike(r"(.)\1{9,}"), "repeated character")
        .when(~t.rlike(r"\p{L}|\d"), "only symbols")
        .when(t.rlike(r"^[\d\s]+$"), "only digits")
    )
    return requests.withColumn("ascii_share", F.round(ascii_share, 6)).withColumn("reason", reason)


def thesis_checks(requests: DataFrame, signals: tuple[str, ...], text: str = "text") -> DataFrame:
    """Why a thesis text is refused, or null: 20 to 5000 characters, twelve words, a directional word, no short question."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    n_words = F.size(F.split(t, " "))
    tokens = F.split(F.lower(t), r"[^\p{L}\p{N}]+")
    reason = (
        F.when(F.length(t) < 20, "too short")
        .when(F.length(t) > 5000, "too long")
        .when(n_words < 12, "too few words")
        .when((n_words < 15) & t.endswith("?"), "a question")
        .when(~F.arrays_overlap(tokens, F.array(*[F.lit(s) for s in signals])), "no direction")
    )
    return requests.withColumn("n_words", n_words).withColumn("reason", reason)


def term_overlaps(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """item_id, doc_id, recall and jaccard of every pair where at least that share of the item's terms is among the document's words.

    docs: doc_id, words; items: item_id, terms (both distinct). Shared terms are counted over the items' inverted lists: a document's words meet
    the lists of those that any item has, and its counts are summed where its words are before they move. No word array moves.
    """
    words = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.size("words").alias("n_words"), F.explode("words").alias("term"))
    lists = items.withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    lists = lists.groupBy("term").agg(F.collect_list(F.struct("item", "item_id", "n_terms")).alias("of"))
    met = words.join(lists, "term").select("row", "doc_id", "n_words", F.explode("of").alias("i"))
    both = F.count("*")
    counts = met.groupBy("row", "doc_id", "n_words", "i.item", "i.item_id", "i.n_terms").agg(both.alias("both")).filter(F.round(F.col("both") / F.col("n_terms"), 6) >= least)
    either = F.col("n_terms") + F.col("n_words") - F.col("both")
    return counts.select("item_id", "doc_id", F.round(F.col("both") / F.col("n_terms"), 6).alias("recall"), F.round(F.col("both") / either, 4).alias("jaccard"))


def first_words_of(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def renumbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """0, 1, 2, ... within each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
