"""Tags of chunks: source type, date, figures, and which of several sources of a tag wins."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicon
from ..functions.patterns import Pattern
from . import tagging

#: Source types by file names, the first that matches.
FILE_TYPES = (
    (r"sebi", "sebi"),
    (r"rbi|reserve[\s_]?bank", "rbi"),
    (r"mca|ministry[\s_]?of[\s_]?corporate", "mca"),
    (r"income[\s_]?tax|incometax|cbdt|section\s*1", "income_tax"),
    (r"irdai|insurance[\s_]?regulatory", "irdai"),
    (r"budget|union[\s_]?budget", "tax_law"),
    (r"monetary[\s_]?policy|mpc[\s_]?statement", "rbi"),
    (r"annual[\s_]?report|ar\b|\bdrhp", "annual_report"),
    (r"earnings?|concall|transcript|q[1-4][\s_]?fy", "earnings_transcript"),
    (r"investor[\s_]?presentation", "annual_report"),
    (r"broker|research[\s_]?note|initiating|coverage", "broker_research"),
    (r"press[\s_]?release", "news"),
    (r"hindu|businessline|economictimes|mint|livemint|timesofindia|ndtv", "news"),
    (r"news|article|headline", "news"),
    (r"blog|opinion|editorial", "blog"),
)

#: Source types by the first 600 characters, where the file name says nothing.
CONTENT_TYPES = (
    (r"reserve[\s_]?bank[\s_]?of[\s_]?india|rbi[\s_]?circular|rbi[\s_]?notification", "rbi"),
    (r"sebi[\s_]?circular|sebi[\s_]?notification|securities[\s_]+and[\s_]+exchange[\s_]+board|sebi\.gov\.in|sebi\.sebi", "sebi"),
    (r"ministry[\s_]+of[\s_]+corporate[\s_]+affairs|companies[\s_]+act", "mca"),
    (r"income\.tax[\s_]+act|section[\s_]+195|cbdt|income\.tax[\s_]+department", "income_tax"),
    (r"irdai|insurance[\s_]+regulatory[\s_]+and[\s_]+development", "irdai"),
    (r"monetary[\s_]+policy[\s_]+(?:committee|statement|report)", "rbi"),
    (r"we[\s_]+hereby[\s_]+inform|pursuant[\s_]+to[\s_]+regulation", "sebi"),
    (r"management[\s_]+discussion|md&a|annual[\s_]+report", "annual_report"),
    (r"earnings[\s_]+call|concall|q&a[\s_]+session", "earnings_transcript"),
    (r"we[\s_]+recommend|target[\s_]+price|rating:[\s_]*(?:buy|sell|hold)", "broker_research"),
    (r"reports?\.?\s+(?:that|said|stated)", "news"),
)

#: Dates in texts, the first pattern that matches.
DATES = (
    r"\b(20[12]\d[-/]\d{1,2}[-/]\d{1,2})\b",
    r"\b(\d{1,2}[-/]\d{1,2}[-/]20[12]\d)\b",
    r"\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s,]+20[12]\d)\b",
    r"\b((?:january|february|march|april|may|june|july|august|september|october|november|december)[\s,]+20[12]\d)\b",
    r"\b(q[1-4]\s*fy\s*20[12]\d)\b",
    r"\b(q[1-4]\s*fy\s*\d{2})\b",
    r"\bfy\s*(20[12]\d)\b",
    r"\bfy\s*(\d{2})\b",
    r"\b(20[12]\d[-–](?:20)?[12]\d)\b",
)

#: Figures by name, the pattern of each (whose number is its one group that is not empty), and plausible bounds.
FIGURES = (
    ("nim_pct", r"\bnim\b[\s\S]{0,30}?(\d{1,2}(?:\.\d{1,2})?)\s*%|net\s+interest\s+margin[\s\S]{0,30}?(\d{1,2}(?:\.\d{1,2})?)\s*%", 0.5, 15.0),
    ("gnpa_pct", r"\bgnpa\b[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%|gross\s+npa[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%", 0.0, 50.0),
    ("nnpa_pct", r"\bnnpa\b[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%|net\s+npa[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%", 0.0, 30.0),
    ("casa_ratio_pct", r"\bcasa\s+ratio\b[\s\S]{0,20}?(\d{2}(?:\.\d{1,2})?)\s*%|\bcasa\b[\s\S]{0,20}?(\d{2}(?:\.\d{1,2})?)\s*%", 5.0, 80.0),
    ("crar_pct", r"\bcrar\b[\s\S]{0,20}?(\d{2}(?:\.\d{1,2})?)\s*%|capital\s+adequacy[\s\S]{0,20}?(\d{2}(?:\.\d{1,2})?)\s*%", 8.0, 50.0),
    ("tier1_capital_pct", r"tier[\s\-]?i\s+(?:capital\s+)?ratio[\s\S]{0,20}?(\d{2}(?:\.\d{1,2})?)\s*%", 6.0, 40.0),
    ("pcr_pct", r"\bpcr\b[\s\S]{0,20}?(\d{2}(?:\.\d{1,2})?)\s*%|provision\s+coverage[\s\S]{0,20}?(\d{2}(?:\.\d{1,2})?)\s*%", 10.0, 100.0),
    ("roe_pct", r"\broe\b[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%|return\s+on\s+equity[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%", -20.0, 60.0),
    ("roa_pct", r"\broa\b[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%|return\s+on\s+assets?[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%", -5.0, 10.0),
    ("pe_ratio", r"\bp(?:/|-)e\s+(?:ratio|multiple)[\s\S]{0,20}?(\d{1,3}(?:\.\d{1,2})?)\s*x?|\d{1,3}(?:\.\d{1,2})?\s*x\s+(?:fy\d{2,4}|trailing|forward)", 0.0, 500.0),
    ("eps", r"\beps\b[\s\S]{0,20}?(?:rs\.?|₹|inr)?\s*(\d{1,5}(?:\.\d{1,2})?)|earnings?\s+per\s+share[\s\S]{0,20}?(?:rs\.?|₹)?\s*(\d{1,5}(?:\.\d{1,2})?)", -500.0, 10_000.0),
    ("revenue_crore", r"revenue[\s\S]{0,30}?(?:rs\.?|₹|inr)?\s*(\d{1,6}(?:,\d{3})*(?:\.\d{1,2})?)\s*cr(?:ore)?", 1.0, 1_000_000.0),
    ("revenue_growth_pct", r"revenue[\s\S]{0,30}?(?:grew?|growth|increased?|up)\s+(?:by\s+)?(\d{1,3}(?:\.\d{1,2})?)\s*%", -50.0, 200.0),
    ("pat_crore", r"\bpat\b[\s\S]{0,30}?(?:rs\.?|₹)?\s*(\d{1,6}(?:,\d{3})*(?:\.\d{1,2})?)\s*cr(?:ore)?|profit\s+after\s+tax[\s\S]{0,30}?(?:rs\.?|₹)?\s*(\d{1,6}(?:,\d{3})*(?:\.\d{1,2})?)\s*cr(?:ore)?", -100_000.0, 1_000_000.0),
    ("ebitda_margin_pct", r"\bebitda\s+margin\b[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%", -10.0, 80.0),
    ("aum_crore", r"\baum\b[\s\S]{0,30}?(?:rs\.?|₹)?\s*(\d{1,6}(?:,\d{3})*(?:\.\d{1,2})?)\s*cr(?:ore)?|assets?\s+under\s+management[\s\S]{0,30}?(?:rs\.?|₹)?\s*(\d{1,6}(?:,\d{3})*(?:\.\d{1,2})?)\s*cr(?:ore)?", 1.0, 10_000_000.0),
    ("cagr_pct", r"\bcagr\b[\s\S]{0,30}?(\d{1,2}(?:\.\d{1,2})?)\s*%|compound\s+annual\s+growth[\s\S]{0,30}?(\d{1,2}(?:\.\d{1,2})?)\s*%", -20.0, 100.0),
    ("dividend_yield_pct", r"dividend\s+yield[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%", 0.0, 20.0),
    ("loan_growth_pct", r"\bloan\s+(?:book\s+)?growth[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%|advances?\s+grew?[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%", -50.0, 200.0),
    ("deposit_growth_pct", r"deposit\s+growth[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%", -50.0, 200.0),
    ("repo_rate_pct", r"repo\s+rate[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%", 0.5, 20.0),
    ("cpi_inflation_pct", r"\bcpi\b[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%|(?:retail\s+)?inflation[\s\S]{0,20}?(\d{1,2}(?:\.\d{1,2})?)\s*%", -5.0, 50.0),
    ("attrition_pct", r"\battrition\s+(?:rate\s+)?(?:stood\s+at\s+|was\s+|of\s+)?(\d{1,2}(?:\.\d{1,2})?)\s*%", 0.0, 100.0),
    ("deal_tcv_bn_usd", r"\btcv\b[\s\S]{0,30}?\$?\s*(\d{1,4}(?:\.\d{1,2})?)\s*(?:billion|bn)\b|total\s+contract\s+value[\s\S]{0,30}?\$?\s*(\d{1,4}(?:\.\d{1,2})?)\s*(?:bn|billion)", 0.01, 1000.0),
)


def _first(text: Column, rules: tuple, default: Column) -> Column:
    out = default
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def source_type(name: Column, text: Column) -> Column:
    """By the file name, else by the first 600 characters of the text, else unknown."""
    by_text = _first(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 600)), CONTENT_TYPES, F.lit("unknown"))
    return _first(F.lower(F.coalesce(name, F.lit(""))), FILE_TYPES, by_text)


def date_text(text: Column) -> Column:
    """The first date that a text names, as it is written; patterns go before places. Null without."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")) for p in DATES])


#: Words of which one stands in every text that the figure's pattern matches; found plainly before the pattern is tried.
FIGURE_WORDS = {
    "nim_pct": ("nim", "margin"), "gnpa_pct": ("npa",), "nnpa_pct": ("npa",), "casa_ratio_pct": ("casa",), "crar_pct": ("crar", "adequacy"), "tier1_capital_pct": ("tier",), "pcr_pct": ("pcr", "provision"), "roe_pct": ("roe", "equity"),
    "roa_pct": ("roa", "return"), "pe_ratio": ("p/e", "p-e", "fy", "trailing", "forward"), "eps": ("eps", "earning"), "revenue_crore": ("revenue",), "revenue_growth_pct": ("revenue",), "pat_crore": ("pat", "profit"), "ebitda_margin_pct": ("ebitda",),
    "aum_crore": ("aum", "management"), "cagr_pct": ("cagr", "compound"), "dividend_yield_pct": ("dividend",), "loan_growth_pct": ("loan", "advance"), "deposit_growth_pct": ("deposit",), "repo_rate_pct": ("repo",), "cpi_inflation_pct": ("cpi", "inflation"),
    "attrition_pct": ("attrition",), "deal_tcv_bn_usd": ("tcv", "contract"),
}

_RULES = [(name, FIGURE_WORDS[name], Pattern(pattern, words=FIGURE_WORDS[name]), low, high) for name, pattern, low, high in FIGURES]
_FOLDED = str.maketrans("İıſ", "iis")  # letters that a pattern takes for these whatever the case, but lower() does not


def stated_figures(text: str | None) -> dict[str, float]:
    """What the first match of each pattern states, in any case of letters, commas dropped, if it is plausible."""
    found: dict[str, float] = {}
    plain = (text or "").translate(_FOLDED).lower() if text and not text.isascii() else (text or "").lower()
    for name, words, pattern, low, high in _RULES:
        if not any(w in plain for w in words):
            continue
        match = pattern.search(plain)
        said = next((g for g in match.groups() if g is not None), None) if match else None
        if said is not None and low <= (number := float(said.replace(",", ""))) <= high:
            found[name] = round(number, 4)
    return found


def figures(text: Column) -> Column:
    """Map of name to number. As one expression of built-ins the 24 patterns are searched anew for each use of their results, so a text is read in Arrow batches instead, and one that a batch repeats once."""

    @F.arrow_udf("map<string,double>")
    def read(texts: pa.Array) -> pa.Array:
        each = pc.fill_null(texts, "").dictionary_encode()
        found = [list(stated_figures(t).items()) for t in each.dictionary.to_pylist()]
        return pa.array(found, pa.map_(pa.string(), pa.float64())).take(each.indices)

    return read(text)


def tagged(chunks: DataFrame, text: str = "text") -> DataFrame:
    """``chunks`` with tags. A chunk's own columns (base_...) go before its file's (file_...), both before what the text shows.

    Adds source_type, authority, date, date_year, quarter, fiscal_year, figures, has_tables, chars and words.
    """
    has = lambda c: F.nullif(F.col(c), F.lit("")) if c in chunks.columns else F.lit(None).cast("string")
    name = has("file_name")
    out = chunks.withColumn("source_type", F.coalesce(has("base_source_type"), has("file_source_type"), source_type(name, F.col(text))))
    out = out.withColumn("authority", C.authority(F.col("source_type"))).withColumn("date", F.coalesce(has("base_date"), has("file_date"), date_text(F.col(text)), F.lit("unknown")))
    both = F.concat_ws(" ", text, name)
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (
        out.withColumn("date_year", F.regexp_extract("date", r"((?:19|20)\d{2})", 1).try_cast("int"))
        .withColumn("quarter", tagging.quarter(both))
        .withColumn("fiscal_year", tagging.fiscal_year(both))
        .withColumn("figures", figures(F.col(text)))
        .withColumn("has_tables", bars > 3)
        .withColumn("chars", F.length(text))
        .withColumn("words", F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")))
    )


#: What a thesis may speak of, for its retrieval queries.
METRIC_SIGNALS = ("nim", "net interest margin", "gnpa", "npa", "credit growth", "pat", "revenue", "ebitda", "margin", "casa", "book value", "roe", "roa", "capital adequacy", "crar", "lcr", "earnings", "capex", "attrition", "wage")
REGULATORY_SIGNALS = ("rbi", "reserve bank", "sebi", "repo rate", "inflation", "monetary policy", "mpc", "lcr", "crr", "slr", "regulatory", "mclr", "interest rate")
VALUATION_SIGNALS = ("book value", "p/b", "pe ratio", "p/e", "price target", "valuation", "multiple", "re-rate", "fair value", "historical")


def thesis_queries(theses: DataFrame, companies: tuple[str, ...], key: str = "thesis", text: str = "text", most: int = 4) -> DataFrame:
    """key, n and query: the thesis itself, then up to three queries from the companies, metrics, regulation and valuation that it names."""
    low = F.lower(text)
    named = lambda words: F.filter(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in words]), lambda w: w.isNotNull())
    joined = lambda a, n: F.array_join(F.slice(a, 1, n), " ")
    t = theses.withColumn("c", named(companies)).withColumn("m", F.slice(named(METRIC_SIGNALS), 1, 3)).withColumn("r", named(REGULATORY_SIGNALS)).withColumn("v", named(VALUATION_SIGNALS))
    has = lambda c: F.size(c) > 0
    about = (
        F.when(has("c") & has("m"), F.concat_ws(" ", joined("c", 2), joined("m", 2)))
        .when(has("c"), F.concat(joined("c", 2), F.lit(" financial results")))
        .when(has("m"), F.concat(F.lit("Indian banking "), joined("m", 2)))
    )
    rules = F.when(has("r"), F.concat(joined("r", 2), F.lit(" India FY26"))).otherwise(F.lit("India macroeconomic outlook FY26 interest rate inflation"))
    past = F.when(has("c") & has("v"), F.concat(joined("c", 1), F.lit(" "), joined("v", 1), F.lit(" historical"))).when(has("c"), F.concat(joined("c", 1), F.lit(" historical performance analyst")))
    every = F.array_distinct(F.filter(F.array(F.trim(text), about, rules, past), lambda q: q.isNotNull() & (q != "")))
    return t.select(key, F.posexplode(F.slice(every, 1, most)).alias("n", "query"))


def zipped(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of two tables with the same key joined by their place in it; a place that only one has stays, with nulls."""
    place = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return place(left).join(place(right).drop(order), [key, "place"], "full")


def cached_vectors(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts whose vector the cache (text_hash, embedding) has, with it; and each text once that has to be encoded."""
    hashed = texts.withColumn("text_hash", F.md5(F.trim(F.coalesce("text", F.lit(""))).cast("binary")))
    known = cache.select("text_hash", "embedding").dropDuplicates(["text_hash"])
    return hashed.join(known, "text_hash"), hashed.join(known, "text_hash", "left_anti").groupBy("text_hash").agg(F.min("text").alias("text"))


def explained(rank: Column, score: Column, source_type: Column, recency: Column, overlap: Column) -> Column:
    """One line on why a chunk has its rank."""
    weight = lexicon.AUTHORITY_FACTOR
    return F.format_string("#%d: similarity %.2f, %s (authority %.1f), recency %.2f, term overlap %.2f", rank, score, source_type, C.authority(source_type, weight, 0.7), recency, overlap)
