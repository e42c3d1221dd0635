"""Classes, terms, figures, periods and acronyms of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicon


def query_class(text: Column) -> Column:
    """THESIS (a phrase and more than fifteen words), then REGULATORY, COMPARATIVE, else FACTUAL; by substring."""
    t = F.lower(text)
    long = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) > 15
    return (
        F.when(C.contains_any(t, lexicon.THESIS_PHRASES) & long, "THESIS")
        .when(C.contains_any(t, lexicon.REGULATORY_WORDS), "REGULATORY")
        .when(C.contains_any(t, lexicon.COMPARE_WORDS), "COMPARATIVE")
        .otherwise("FACTUAL")
    )


def token_class(text: Column, classes: dict[str, tuple[str, ...]], default: str = "FACTUAL") -> Column:
    """The first class, in the order given, of which a white-space token is in the text."""
    tokens = F.split(F.lower(text), r"\s+")
    out = F.lit(default)
    for name, members in reversed(classes.items()):
        out = F.when(F.arrays_overlap(tokens, F.array(*[F.lit(m) for m in members])), name).otherwise(out)
    return out


def acronyms(text: Column, common: tuple[str, ...] = ("THE", "AND", "FOR", "NOT", "ARE"), most: int = 8) -> Column:
    """Distinct upper-case tokens of two to six letters with up to four digits, in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,6}[0-9]{0,4}\b"), F.lit(0)))
    return F.slice(F.array_except(found, F.array(*[F.lit(c) for c in common])), 1, most)


def expanded_acronyms(rows: DataFrame, meanings: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """acronym and meaning of each acronym of a text that the dictionary knows: exact, else without trailing digits.

    meanings: acronym, meaning; a dictionary, whose size Spark checks before it broadcasts it.
    """
    seen = rows.select(key, F.posexplode(acronyms(F.col(text))).alias("n", "acronym")).withColumn("stem", F.regexp_replace("acronym", r"[0-9]+$", ""))
    exact, stem = meanings.toDF("acronym", "exact"), meanings.toDF("stem", "by_stem")
    joined = seen.join(exact, "acronym", "left").join(stem, "stem", "left")
    return joined.withColumn("meaning", F.coalesce("exact", "by_stem")).filter("meaning IS NOT NULL").select(key, "acronym", "meaning")


def with_acronyms(text: Column, acronym: Column, meaning: Column) -> Column:
    """The text with the first occurrence of the acronym followed by its meaning in parentheses."""
    at = F.locate_col(acronym, text) if hasattr(F, "locate_col") else F.position(acronym, text)
    end = at + F.length(acronym) - 1
    return F.when(at == 0, text).otherwise(F.concat(F.substr(text, F.lit(1), end), F.lit(" ("), meaning, F.lit(")"), F.substr(text, end + 1)))


def quarter(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(text, r"(?i)\b(q[1-4])\b", 1)), F.lit(""))


def fiscal_year(text: Column) -> Column:
    """FY26 of FY26, FY2026 or FY 2026; FY98 of FY1998."""
    digits = F.regexp_extract(text, r"(?i)\bfy\s?(?:19|20)?([0-9]{2})\b", 1)
    return F.when(digits != "", F.concat(F.lit("FY"), digits))


def terms(rows: DataFrame, dictionary: DataFrame, text: str = "text", key: str = "doc_id", most: int = 10) -> DataFrame:
    """The first terms, in dictionary order, whose word is in the text. dictionary: term, rank."""
    words = rows.select(key, F.explode(C.words(F.col(text))).alias("term"))
    found = words.join(dictionary, "term").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("hits"))
    return found.select(key, F.transform(F.slice("hits", 1, most), lambda h: h["term"]).alias("terms"))


def figures(text: Column, patterns: dict[str, tuple[str, float, float]]) -> Column:
    """Map of name to value: the first match of each pattern, commas dropped, kept if it is plausible."""
    entries = []
    for name, (pattern, low, high) in patterns.items():
        value = F.expr("try_cast(NULL AS DOUBLE)") if not pattern else F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
        entries.append(F.struct(F.lit(name).alias("k"), F.when(value.between(low, high), F.round(value, 4)).alias("v")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))


def sector(text: Column, keywords: dict[str, tuple[str, ...]], least: int = 2) -> Column:
    """The sector with the most keyword hits, at least two; ties go to the first."""
    hits = [F.struct(sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(keywords.items())]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] >= least, best["name"])


def subqueries(rows: DataFrame, entities: tuple[str, ...], metrics: tuple[str, ...], key: str = "query_id", text: str = "text", most: int = 6) -> DataFrame:
    """Metric by entity questions of a comparison, at most six a query, in order of appearance."""
    t = F.lower(F.col(text))

    def named(names: tuple[str, ...], top: int) -> Column:
        at = F.array_sort(F.filter(F.array(*[F.struct(F.position(F.lit(n), t).alias("at"), F.lit(n).alias("name")) for n in names]), lambda s: s["at"] > 0))
        return F.transform(F.slice(at, 1, top), lambda s: s["name"])

    both = rows.select(key, named(metrics, 2).alias("metrics"), named(entities, 3).alias("entities"))
    crossed = F.flatten(F.transform("metrics", lambda m: F.transform("entities", lambda e: F.concat(m, F.lit(" of "), e))))
    return both.select(key, F.posexplode(F.slice(crossed, 1, most)).alias("n", "subquery"))


def causal_assumptions(rows: DataFrame, key: str = "doc_id", text: str = "text", most: int = 8) -> DataFrame:
    """Sentences that state an assumption, the first eight of a text, each depending on the one before.

    key, n (from 0), sentence (300 characters), category, confidence, depends_on and critical (the first one). Sentences
    of under 15 characters are none; of sentences with the same first 40 characters the first counts.
    """
    whole = F.filter(F.transform(F.split(text, "[.!?;]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) >= 15)
    stated = "(?i)" + "|".join(p for p, _ in lexicon.ASSUMPTION_PATTERNS)
    found = rows.select(key, F.posexplode(F.filter(whole, lambda s: s.rlike(stated))).alias("at", "sentence"))
    alike = Window.partitionBy(key, F.lower(F.substring("sentence", 1, 40))).orderBy("at")
    firsts = found.withColumn("nth", F.row_number().over(alike)).filter("nth = 1")
    numbered = firsts.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).filter(F.col("n") < most)
    low = F.lower("sentence")
    category, confidence = F.lit("unknown"), F.lit(None).cast("double")
    for name, words in reversed(lexicon.ASSUMPTION_CATEGORIES.items()):
        category = F.when(C.contains_any(low, words), name).otherwise(category)
    for pattern, value in reversed(lexicon.ASSUMPTION_PATTERNS):
        confidence = F.when(F.col("sentence").rlike(f"(?i){pattern}"), value).otherwise(confidence)
    depends = F.when(F.col("n") > 0, F.array(F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    return numbered.select(key, "n", F.substring("sentence", 1, 300).alias("sentence"), category.alias("category"), confidence.alias("confidence"), depends.alias("depends_on"), (F.col("n") == 0).alias("critical"))
