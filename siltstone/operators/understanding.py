"""What a question asks for: its class, entities, metrics and periods, and its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Classes by phrases in a question, the first that matches.
CLASS_PHRASES = (
    ("REGULATORY", ("sebi", "rbi", "regulation", "circular", "guideline", "compliance", "norms", "lcr", "crr", "slr", "licence", "approved", "penalty")),
    ("THESIS", ("buy", "sell", "hold", "thesis", "target price", "recommendation", "valuation", "re-rate", "upside", "downside", "pe", "p/b")),
    ("COMPARATIVE", ("compare", "vs", "versus", "better", "worse", "difference", "between", "both", "which", "contrast", "outperform")),
)

#: Words that compare, names of entities, and metrics.
COMPARING = ("vs", "versus", "compare", "comparison", "better", "worse", "difference", "between", "against")
ALIASES = {
    "HDFC Bank": ("hdfc bank", "hdfc", "hdfcbank"),
    "ICICI Bank": ("icici bank", "icici", "icicibank"),
    "SBI": ("state bank of india", "state bank", "sbi"),
    "Axis Bank": ("axis bank", "axis"),
    "Kotak Mahindra": ("kotak mahindra", "kotak bank", "kotak"),
    "IndusInd Bank": ("indusind bank", "indusind"),
    "Bandhan Bank": ("bandhan bank", "bandhan"),
    "Yes Bank": ("yes bank", "yesbank"),
    "Federal Bank": ("federal bank", "federal"),
    "PNB": ("punjab national bank", "pnb"),
    "Bank of Baroda": ("bank of baroda", "bob"),
    "Canara Bank": ("canara bank", "canara"),
}
METRICS = (
    "net interest margin", "return on equity", "return on assets", "capital adequacy", "earnings per share", "price to earnings", "ebitda margin", "operating margin", "revenue growth",
    "working capital", "repo rate", "nim", "nii", "npa", "gnpa", "nnpa", "casa", "crar", "pcr", "lcr", "roe", "roa", "roce", "eps", "pat", "ebitda", "revenue", "capex", "aum", "gdp", "inflation", "cpi", "wpi",
)

MOST_PARTS = 6


def rag_class(text: Column) -> Column:
    """REGULATORY, THESIS, COMPARATIVE or FACTUAL, by substring."""
    t = F.lower(text)
    out = F.lit("FACTUAL")
    for name, phrases in reversed(CLASS_PHRASES):
        out = F.when(C.contains_any(t, phrases), name).otherwise(out)
    return out


def named(text: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """The names of which a spelling stands in the text as words of its own, in order of first appearance."""
    t = F.lower(text)
    where = [
        F.struct(F.regexp_instr(t, F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted((s.replace('/', '.') for s in spellings), key=len, reverse=True))})(?![\p{{L}}\p{{N}}])")).alias("at"), F.lit(i).alias("order"), F.lit(name).alias("name"))
        for i, (name, spellings) in enumerate(names.items())
    ]
    return F.transform(F.array_sort(F.filter(F.array(*where), lambda w: w["at"] > 0)), lambda w: w["name"])


def parsed(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with entities, metrics, years and quarters (arrays in order of appearance), compares, n_words and is_complex."""
    found = lambda pattern: F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.upper(F.regexp_replace(x, r"\s+", ""))))
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    out = (
        rows.withColumn("entities", named(F.col(text), ALIASES))
        .withColumn("metrics", named(F.col(text), {m: (m,) for m in METRICS}))
        .withColumn("years", found(r"(?i)\b(fy\s?(?:20)?[0-9]{2})\b"))
        .withColumn("quarters", found(r"(?i)\b(q[1-4])\b"))
        .withColumn("compares", F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in COMPARING])))
        .withColumn("n_words", F.size(tokens))
    )
    many = (F.size("entities") >= 2) | (F.size("years") >= 2) | (F.size("quarters") >= 2) | (F.size("metrics") >= 3)
    return out.withColumn("is_complex", F.col("compares") | (F.col("n_words") > 18) | many)


def decomposed(rows: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """key, strategy, priority (from 1) and subquery: at most MOST_PARTS parts of each question.

    COMPARISON (a comparing word and two entities): up to two metrics by three entities; MULTI_ENTITY (three entities): an
    entity each; MULTI_METRIC (three metrics and an entity): a metric each; TEMPORAL (two periods, and an entity or
    metric): a period each; else SIMPLE: the question as it is.
    """
    q = parsed(rows, text)
    periods = F.when(F.size("years") >= 1, F.col("years")).otherwise(F.col("quarters"))
    when = F.concat_ws(" ", F.get("quarters", F.lit(0)), F.get("years", F.lit(0)))
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    said = lambda *parts: F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"\s+", " "))
    metrics = F.when(F.size("metrics") > 0, F.slice("metrics", 1, 2)).otherwise(F.array(F.lit("")))
    strategy = (
        F.when(F.col("compares") & (F.size("entities") >= 2), "COMPARISON")
        .when(F.size("entities") >= 3, "MULTI_ENTITY")
        .when((F.size("metrics") >= 3) & (F.size("entities") >= 1), "MULTI_METRIC")
        .when((F.size(periods) >= 2) & ((F.size("entities") >= 1) | (F.size("metrics") >= 1)), "TEMPORAL")
        .otherwise("SIMPLE")
    )
    q = q.withColumn("strategy", strategy).withColumn("when", when).withColumn("periods", periods).withColumn("entity", first("entities")).withColumn("metric", first("metrics")).withColumn("few_metrics", metrics)
    parts = (
        F.when(F.col("strategy") == "COMPARISON", F.flatten(F.transform("few_metrics", lambda m: F.transform(F.slice("entities", 1, 3), lambda e: said(e, m, F.col("when"))))))
        .when(F.col("strategy") == "MULTI_ENTITY", F.transform("entities", lambda e: said(e, F.col("metric"), F.col("when"))))
        .when(F.col("strategy") == "MULTI_METRIC", F.transform("metrics", lambda m: said(F.col("entity"), m, F.col("when"))))
        .when(F.col("strategy") == "TEMPORAL", F.transform("periods", lambda p: said(F.col("entity"), F.col("metric"), p)))
        .otherwise(F.array(F.col(text)))
    )
    return q.select(key, "strategy", F.posexplode(F.slice(parts, 1, MOST_PARTS)).alias("n", "subquery")).select(key, "strategy", (F.col("n") + 1).alias("priority"), "subquery")


def key_terms(text: Column) -> Column:
    """Acronyms, up to three numbers and up to six words of five letters or more, distinct, in this order."""
    from ..functions import lexicon

    words = F.filter(F.regexp_extract_all(text, F.lit(r"\b[a-zA-Z]{5,}\b"), F.lit(0)), lambda w: ~F.lower(w).isin(list(lexicon.PLAIN_WORDS)))
    numbers = F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?%?"), F.lit(0))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,6}\b"), F.lit(0)), F.slice(numbers, 1, 3), F.slice(words, 1, 6)))
