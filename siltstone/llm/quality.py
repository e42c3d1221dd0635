"""Quality rules by distribution divergence.

A document's histogram over character classes and its histogram over common words (with one
place for all other words) are compared with those of each language by the Jensen-Shannon
distance (the root of the divergence in bits, 0 to 1). The language references are the summed
histograms of all documents with that language tag; every language with ``ENOUGH_CHARS``
characters in ``ENOUGH_DOCS`` documents makes one, and every one is a candidate for every document, whatever its
language's share of the table: a document counts by the nearest of them, so a wrong tag costs nothing. It is
rejected if it is far from all of these in either respect, where the respect has enough of the
text to judge: ``min_chars`` characters, ``min_words`` words. Documents whose language has no
reference pass this rule.

The counting is one pass of numpy over the bytes of each Arrow batch; sums, references and
verdicts are Spark SQL on the small table of counts. The references pass through the driver and meet the counts again as
literals. That is meant for languages: of more than ``MOST_CANDIDATES`` tags with enough text, the largest are candidates for
all documents, and the others are a table that is joined by language, each for its own.

Defined results: null text has no words, fails the base rule and is not kept; null languages
form a group of their own; repeated rows are judged alike; an empty table gives an empty
result; other columns pass through unless they bear the name of a statistic, which replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stage, tucked, untucked
from .textnum import U, WHITE, per_text, runs, slices, span_hashes, windows, words

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TOTALS = ("chars", "tokens")
SCRATCH = ("classes", "commons", "chars", "tokens", "base_failed", "class_distance", "common_distance", "kept", "own", "own_classes", "own_commons", "measured")
ENOUGH_CHARS, ENOUGH_DOCS = 10_000, 20
MOST_CANDIDATES = 200
MOST_BROADCAST = 2_000  # references of small languages, about 1.5 KB each
SYMBOLS = b"#*$%&|<>"
#: Frequent words of four languages, without those that only their accents tell apart.
REFERENCE_WORDS = (
    "the of and to in is that it for was on are as with his they at be this from have or by not but what all were when your can said there an which she do how their if will up about "
    "de la et le les des en un une du que qui dans est pour par sur au avec ne se pas plus "
    "der die und das von zu mit sich auf ein eine nicht dem den als auch es an werden aus er hat dass "
    "el los las del y al lo como su para con una sus no se por"
).split()
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "wide")


def _class_table() -> np.ndarray:
    """Character class by leading byte; 8 marks the bytes that continue a character."""
    table = np.full(256, 6, np.int64)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[WHITE] = 3
    table[list(b".,;:'\"-()?")] = 4
    table[list(SYMBOLS)] = 5
    table[0x80:0xC0] = 8
    table[0xC0:] = 7
    return table


CLASS_OF = _class_table()
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the reference words, and the place of each in the histogram."""
    distinct = list(dict.fromkeys(REFERENCE_WORDS))
    joined = np.frombuffer("".join(distinct).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in distinct])
    hashes = span_hashes(joined, np.concatenate(([0], ends[:-1])), ends, lower=True)
    order = np.argsort(hashes)
    return hashes[order], order


WORD_HASHES, WORD_PLACES = _word_table()


def repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, how many of its words lie in three-word windows that occur twice or more in it."""
    h, index = windows(hashes, first, 3)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(index))
    order = np.lexsort((h, text_of))
    same = (h[order][1:] == h[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes) + 2, bool)
    at = np.repeat(first[:-1] - index[:-1], np.diff(index)) + np.arange(len(h))
    for k in range(3):
        covered[at[twice] + k] = True
    return per_text(first, covered[: len(hashes)].astype(np.int64))


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, how many lines with a word equal an earlier line."""
    starts, ends, first = runs(data != 0x0A, offsets)
    solid = np.concatenate(([0], np.cumsum(~WHITE[data])))
    worded = solid[ends] > solid[starts]
    h = span_hashes(data, starts, ends)[worded]
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[worded]
    order = np.lexsort((h, text_of))
    same = (h[order][1:] == h[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    return np.bincount(text_of[order[1:][same]], minlength=len(offsets) - 1)


def _histogram(text_of: np.ndarray, place: np.ndarray, texts: int, places: int) -> np.ndarray:
    return np.bincount(text_of * places + place, minlength=texts * places).reshape(texts, places)


def counted(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with the base statistics, ``classes`` and ``commons`` (histograms) and their totals; its text goes unless it is kept."""
    kept = [c for c in docs.columns if c not in {*STATS, *TOTALS, "classes", "commons"} and (keep_text or c != text)]
    arrays = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("classes", "commons")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in (*STATS, *TOTALS)] + arrays)
    places = len(WORD_HASHES) + 1

    def nested(matrix: np.ndarray) -> pa.Array:
        n, width = matrix.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel(), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, text):
                n = len(offsets) - 1
                of_byte = np.repeat(np.arange(n), np.diff(offsets))
                classes = _histogram(of_byte, CLASS_OF[data], n, 9)[:, :8]
                starts, ends, first = words(data, offsets)
                hashes = span_hashes(data, starts, ends)
                letters, stops, index = runs(LETTER[data], offsets)
                lowered = span_hashes(data, letters, stops, lower=True)
                found = np.minimum(np.searchsorted(WORD_HASHES, lowered), places - 2)
                place = np.where(WORD_HASHES[found] == lowered, WORD_PLACES[found], places - 1)
                commons = _histogram(np.repeat(np.arange(n), np.diff(index)), place, n, places)
                stats = [np.diff(first), classes.sum(1) - classes[:, 3], classes[:, 5], duplicate_lines(data, offsets), repeated_words(hashes, first), classes.sum(1), commons.sum(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [pa.array(s, pa.int64()) for s in stats] + [nested(classes), nested(commons)], names=schema.names
                )

    return docs.select(*kept, *([] if keep_text else [text])).mapInArrow(run, schema)


Reference = tuple[str | None, list[float], list[float]]


class References(NamedTuple):
    """Those of the large languages, and a table (own, own_classes, own_commons) of all others with how many it has."""

    large: list[Reference]
    others: DataFrame
    n_others: int


def _key(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("lang "), lang), F.lit("none"))


def _name(lang: str | None) -> str:
    return "none" if lang is None else f"lang {lang}"


def references(counts: DataFrame) -> References:
    """The shares of the classes and of the words of each language with enough text.

    A language with enough text is a candidate for every document, whatever its share of the table. Should a table have more than MOST_CANDIDATES
    such tags, the largest reach the driver and are candidates for all; each of the others is one for its own documents.
    """
    summed = lambda c, n: F.array(*[F.coalesce(F.sum(F.col(c)[i]), F.lit(0)) for i in range(n)])
    tops = counts.groupBy("lang").agg(
        summed("classes", len(CLASSES)).alias("classes"), summed("commons", len(WORD_HASHES) + 1).alias("commons"), F.sum("chars").alias("chars"), F.count("*").alias("docs")
    )
    tops = stage(tops, "quality-languages")
    enough = tops.filter((F.col("chars") >= ENOUGH_CHARS) & (F.col("docs") >= ENOUGH_DOCS))
    rows = enough.orderBy(F.desc("chars"), "lang").limit(MOST_CANDIDATES).collect()
    is_large = _key(F.col("lang")).isin([_name(r.lang) for r in rows])
    share = lambda values: [v / max(sum(values), 1) for v in values]
    shares = lambda c: F.transform(c, lambda v: v / F.greatest(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1)))
    others = enough.filter(~is_large).select(_key(F.col("lang")).alias("own"), shares("classes").alias("own_classes"), shares("commons").alias("own_commons"))
    return References([(r.lang, share(r.classes), share(r.commons)) for r in rows], others, others.count())


def js_distance(counts: Column, total: Column, reference: Column) -> Column:
    """Root of the Jensen-Shannon divergence in bits between a histogram and a reference distribution."""

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    both = F.zip_with(counts, reference, lambda c, q: F.struct((c / F.greatest(total, F.lit(1))).alias("p"), q.alias("q")))
    divergence = F.aggregate(both, F.lit(0.0), lambda a, x: a + 0.5 * part(x["p"], (x["p"] + x["q"]) / 2) + 0.5 * part(x["q"], (x["p"] + x["q"]) / 2))
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def _with_distances(counts: DataFrame, refs: References) -> DataFrame:
    """Adds class_distance and common_distance to the nearest reference, null without any, and measured: whether the language has one.

    References of large languages stand in the plan as literals. Their documents need no join; if the
    others are too many to broadcast, they are spread by a key that meets nothing.
    """
    large = _key(F.col("lang")).isin([_name(lang) for lang, _, _ in refs.large])
    if refs.n_others:
        spread = F.concat(F.lit("large "), F.pmod(F.xxhash64("classes"), F.lit(4096)))
        others = F.broadcast(refs.others) if refs.n_others <= MOST_BROADCAST else refs.others
        counts = counts.withColumn("own", F.when(large, spread).otherwise(_key(F.col("lang")))).join(others, "own", "left").drop("own")
        measured = large | F.col("own_classes").isNotNull()
    else:
        measured = large

    def nearest(column: str, total: str, shares: list[list[float]]) -> Column:
        known = F.array_min(F.transform(F.array(*[F.lit(s) for s in shares]), lambda r: js_distance(F.col(column), F.col(total), r))) if shares else F.lit(None).cast("double")
        own = f"own_{column}"
        if refs.n_others:
            known = F.least(known, F.when(F.col(own).isNotNull(), js_distance(F.col(column), F.col(total), F.col(own))))
        return F.round(known, 6)

    found = counts.withColumn("class_distance", nearest("classes", "chars", [r[1] for r in refs.large])).withColumn("common_distance", nearest("commons", "tokens", [r[2] for r in refs.large]))
    return found.withColumn("measured", measured).drop("own_classes", "own_commons")


def _with_base(counts: DataFrame) -> DataFrame:
    return counts.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def learned_references(counts: DataFrame, trim: float = 0.2) -> References:
    """The references, made twice: first from all documents that pass the base rule, then from those
    of them whose character classes lie within ``trim`` of a first reference, so that junk does
    not pull the references towards itself.
    """
    sound = _with_base(counts).filter(~F.col("base_failed"))
    first = _with_distances(sound, references(sound))
    return references(first.filter(F.col("class_distance") <= trim))


def with_verdicts(counts: DataFrame, refs: References, max_class: float = 0.16, max_common: float = 0.45, min_chars: int = 200, min_words: int = 50) -> DataFrame:
    """``counts`` without the histograms, with base_failed, the two distances and kept."""
    kept = [c for c in counts.columns if c not in ("classes", "commons", *TOTALS)]
    far = ((F.col("chars") >= min_chars) & (F.col("class_distance") > max_class)) | ((F.col("tokens") >= min_words) & (F.col("common_distance") > max_common))
    return (
        _with_distances(_with_base(counts), refs)
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far & F.col("measured"), F.lit(False)))
        .select(*kept, "base_failed", "class_distance", "common_distance", "kept")
    )


def judged(docs: DataFrame) -> DataFrame:
    """Base statistics, base_failed, the two distances and kept, for every document, without the text."""
    counts = stage(counted(docs), "quality-counts")
    return with_verdicts(counts, learned_references(counts))


def passing(docs: DataFrame) -> DataFrame:
    """The documents that are kept, whole; the histograms are counted again with the texts, which needs no join."""
    refs = learned_references(stage(counted(docs.select("lang", "text")), "quality-counts"))
    used = ["lang", "text"]
    return with_verdicts(counted(tucked(docs, used), keep_text=True), refs).filter("kept").select(*untucked(docs.columns, used))
