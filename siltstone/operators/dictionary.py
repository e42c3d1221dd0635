"""A dictionary of acronyms as a table, and texts read with it.

A dictionary has a row an acronym: acronym, meaning, category, context. It meets texts by
equi-joins on the acronyms that occur in them; its size is no matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Acronyms of bank reports.
TERMS = (
    ("NIM", "Net Interest Margin", "banking"),
    ("NII", "Net Interest Income", "banking"),
    ("CASA", "Current Account Savings Account", "banking"),
    ("GNPA", "Gross Non-Performing Assets", "banking"),
    ("NNPA", "Net Non-Performing Assets", "banking"),
    ("NPA", "Non-Performing Asset", "banking"),
    ("PCR", "Provision Coverage Ratio", "banking"),
    ("CRAR", "Capital to Risk-weighted Assets Ratio", "banking"),
    ("CAR", "Capital Adequacy Ratio", "banking"),
    ("CET1", "Common Equity Tier 1", "banking"),
    ("AT1", "Additional Tier 1", "banking"),
    ("LCR", "Liquidity Coverage Ratio", "banking"),
    ("NSFR", "Net Stable Funding Ratio", "banking"),
    ("SLR", "Statutory Liquidity Ratio", "banking"),
    ("CRR", "Cash Reserve Ratio", "banking"),
    ("MCLR", "Marginal Cost of Funds-based Lending Rate", "banking"),
    ("NBFC", "Non-Banking Financial Company", "banking"),
    ("HFC", "Housing Finance Company", "banking"),
    ("IBC", "Insolvency and Bankruptcy Code", "banking"),
)

#: Acronyms with several meanings, the usual one first.
ALTERNATIVES = {
    "TCS": ("Tax Collected at Source", "Tata Consultancy Services"),
    "EV": ("Enterprise Value", "Electric Vehicle", "Embedded Value"),
    "ECB": ("External Commercial Borrowing", "European Central Bank"),
    "PE": ("Price to Earnings", "Private Equity"),
    "BC": ("Business Correspondent", "Before Christ"),
    "MCA": ("Ministry of Corporate Affairs", "Master of Computer Applications"),
    "AA": ("Account Aggregator", "Alcoholics Anonymous"),
    "ARR": ("Annual Recurring Revenue", "Annualised Rate of Return"),
}

CANDIDATE = r"\b[A-Z]{2,6}[0-9]{0,4}\b"
WIDE_CANDIDATE = r"\b[A-Z][A-Z0-9/_&]{1,9}\b"


def default(spark: SparkSession) -> DataFrame:
    """The fixed terms, and the usual meaning of each ambiguous one."""
    rows = [(a, m, c, "") for a, m, c in TERMS] + [(a, m[0], "ambiguous", "; ".join(m[1:])) for a, m in ALTERNATIVES.items()]
    return spark.createDataFrame(rows, "acronym string, meaning string, category string, context string")


def inserted(dictionary: DataFrame, custom: DataFrame) -> DataFrame:
    """The dictionary with a caller's acronyms, upper-cased, which go before those that it has. custom: acronym, meaning."""
    new = custom.select(F.upper(F.trim("acronym")).alias("acronym"), "meaning", F.lit("custom").alias("category"), F.lit("").alias("context"))
    both = dictionary.withColumn("order", F.lit(1)).unionByName(new.withColumn("order", F.lit(0)))
    first = Window.partitionBy("acronym").orderBy("order", "meaning")
    return both.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth", "order")


def looked_up(asked: DataFrame, dictionary: DataFrame, column: str = "acronym") -> DataFrame:
    """``asked`` with the meaning of a column's acronyms: as written, else in any case, else without trailing digits; null if unknown."""
    exact = dictionary.select(F.col("acronym").alias(column), F.col("meaning").alias("exact"))
    any_case = dictionary.groupBy(F.lower("acronym").alias("lower_key")).agg(F.min_by("meaning", "acronym").alias("in_any_case"))
    stem = dictionary.select(F.col("acronym").alias("stem_key"), F.col("meaning").alias("by_stem"))
    keyed = asked.withColumn("lower_key", F.lower(column)).withColumn("stem_key", F.regexp_replace(column, r"[0-9]+$", ""))
    found = keyed.join(exact, column, "left").join(any_case, "lower_key", "left").join(stem, "stem_key", "left")
    return found.withColumn("meaning", F.coalesce("exact", "in_any_case", "by_stem")).drop("exact", "in_any_case", "by_stem", "lower_key", "stem_key")


def first_expanded(text: Column, pairs: Column) -> Column:
    """The text in which the first occurrence of each acronym, in any case and perhaps possessive, becomes ``meaning (acronym)``.

    pairs: an array of (acronym, meaning), applied in order.
    """

    def put(done: Column, p: Column) -> Column:
        pattern = F.concat(F.lit(r"(?is)^(.*?)\b("), p["acronym"], F.lit(r")('s|s\b)?\b"))
        meaning = F.replace(F.replace(p["meaning"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.regexp_replace(done, pattern, F.concat(F.lit("$1"), meaning, F.lit(" ($2)$3")))

    return F.aggregate(pairs, text, put)


def _with_meanings(rows: DataFrame, dictionary: DataFrame, pattern: str, key: str, text: str, skip: tuple[str, ...], most: int | None) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    done = F.regexp_extract_all(text, F.lit(r"\(([A-Z]{2,6}[0-9]{0,4})\)"), F.lit(1))  # meaning (ACRONYM) stands there already
    wanted = F.array_except(F.array_except(found, F.array(*[F.lit(s) for s in skip])), done)
    seen = rows.select(key, F.posexplode(F.slice(wanted, 1, most) if most else wanted).alias("n", "acronym"))
    return looked_up(seen, dictionary).filter("meaning IS NOT NULL")


def expanded(rows: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", skip: tuple[str, ...] = ("THE", "AND", "FOR", "NOT", "ARE"), most: int = 8) -> DataFrame:
    """``rows`` with expanded: the text with up to ``most`` acronyms expanded where they first occur, longer ones first."""
    known = _with_meanings(rows, dictionary, CANDIDATE, key, text, skip, most)
    order = F.struct((-F.length("acronym")).alias("order"), "n", "acronym", "meaning")
    pairs = known.groupBy(key).agg(F.sort_array(F.collect_list(order)).alias("pairs"))  # at most ``most`` a row
    return rows.join(pairs, key, "left").withColumn("expanded", F.when(F.col("pairs").isNull(), F.col(text)).otherwise(first_expanded(F.col(text), F.col("pairs")))).drop("pairs")


def occurring(rows: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each known acronym of a text: n (order of appearance), acronym, meaning, category."""
    found = rows.select(key, F.posexplode(F.array_distinct(F.regexp_extract_all(text, F.lit(WIDE_CANDIDATE), F.lit(0)))).alias("n", "acronym"))
    return found.join(dictionary.select("acronym", "meaning", "category"), "acronym")


def with_glossary(rows: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``rows`` with a glossary of the acronyms that occur after the text, in order of appearance."""
    lines = occurring(rows, dictionary, key, text).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", F.concat(F.lit("  "), "acronym", F.lit(": "), "meaning").alias("line")))).alias("lines"))
    glossary = F.concat(F.lit("\n\nGLOSSARY:\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return rows.join(lines, key, "left").withColumn("with_glossary", F.concat(F.col(text), F.coalesce(glossary, F.lit("")))).drop("lines")


def searched(dictionary: DataFrame, phrase: str) -> DataFrame:
    """Terms with the phrase in acronym, meaning or context."""
    hit = lambda c: F.contains(F.lower(c), F.lit(phrase.lower()))
    return dictionary.filter(hit("acronym") | hit("meaning") | hit("context"))


def of_category(dictionary: DataFrame, category: str) -> DataFrame:
    return dictionary.filter(F.lower("category") == category.lower())
