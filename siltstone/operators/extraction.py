"""Numbers that texts state of metrics: as claims, and gathered into records.

A text is read once, in Arrow batches: one search for the fixed parts of all names says which of them are tried at all, and a window around each
place of a metric's name is searched for a number, its unit, an entity and a period. All else is joins and groups. As built-in functions
the patterns of a window were searched anew for each use of their results.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.patterns import Part, Pattern, alternatives, each, first

#: Names of metrics in claims, and whether they are ratios.
CLAIM_METRICS = (
    ("NIM", r"net interest margin|\bnim\b", True),
    ("GNPA", r"gross npa|\bgnpa\b|gross non.?performing", True),
    ("NNPA", r"net npa|\bnnpa\b|net non.?performing", True),
    ("NPA", r"\bnpa ratio\b|\bnpa\b", True),
    ("CASA", r"casa ratio|\bcasa\b", True),
    ("CRAR", r"capital adequacy|\bcrar\b|\bcar\b", True),
    ("PCR", r"provision coverage|\bpcr\b", True),
    ("ROE", r"return on equity|\broe\b", True),
    ("ROA", r"return on assets?|\broa\b", True),
    ("ROCE", r"return on capital employed|\broce\b", True),
    ("EBITDA Margin", r"ebitda margin", True),
    ("PAT Margin", r"pat margin|profit after tax margin", True),
    ("Operating Margin", r"operating margin", True),
    ("Gross Margin", r"gross margin", True),
    ("PE Ratio", r"\bp/?e ratio\b|price.to.earnings", True),
    ("PB Ratio", r"\bp/?b ratio\b|price.to.book", True),
    ("Revenue", r"\brev(?:enue)?\b|total income", False),
    ("PAT", r"\bpat\b|profit after tax", False),
    ("NII", r"\bnii\b|net interest income", False),
    ("AUM", r"\baum\b|assets under management", False),
    ("Advances", r"\badvances\b|loan book", False),
    ("Deposits", r"\bdeposits\b", False),
    ("Market Cap", r"market cap(?:italisation)?", False),
    ("Repo Rate", r"repo rate", True),
    ("GDP Growth", r"gdp growth", True),
    ("CPI", r"\bcpi\b|consumer price index", True),
    ("WPI", r"\bwpi\b|wholesale price index", True),
)

#: Names of metrics in records.
RECORD_METRICS = (
    ("NIM", r"\bnim\b|net\s*interest\s*margin"),
    ("NII", r"\bnii\b|net\s*interest\s*income"),
    ("GNPA", r"\bgnpa\b|gross\s*npa|gross\s*non.?performing"),
    ("NNPA", r"\bnnpa\b|net\s*npa|net\s*non.?performing"),
    ("NPA", r"\bnpa\s*ratio\b"),
    ("CASA", r"\bcasa\b|casa\s*ratio"),
    ("CRAR", r"\bcrar\b|capital\s*adequacy|\bcar\b"),
    ("PCR", r"\bpcr\b|provision\s*coverage"),
    ("ROE", r"\broe\b|return\s*on\s*equity"),
    ("ROA", r"\broa\b|return\s*on\s*assets?"),
    ("ROCE", r"\broce\b|return\s*on\s*capital\s*employed"),
    ("PAT", r"\bpat\b|profit\s*after\s*tax"),
    ("Revenue", r"\brevenue\b|total\s*income|net\s*revenue"),
    ("Equity", r"\bequity\b|shareholders?\s*equity|net\s*worth"),
    ("Assets", r"\btotal\s*assets?\b"),
    ("PE", r"\bp/?e\s*ratio\b|price.to.earnings"),
    ("EPS", r"\beps\b|earnings\s*per\s*share"),
    ("Advances", r"\badvances\b|loan\s*book|gross\s*advances"),
    ("Deposits", r"\bdeposits\b"),
    ("AUM", r"\baum\b|assets\s*under\s*management"),
    ("EBITDA", r"\bebitda\b"),
    ("Dividend", r"\bdividend\b"),
)

#: Entities, the first in this order that a window names.
ENTITIES = (
    ("HDFC Bank", r"\bHDFC\s*Bank\b|\bHDFCBANK\b"),
    ("ICICI Bank", r"\bICICI\s*Bank\b|\bICICIBANK\b"),
    ("SBI", r"\bSBI\b|\bState\s*Bank\s*of\s*India\b"),
    ("Axis Bank", r"\bAxis\s*Bank\b|\bAXISBANK\b"),
    ("Kotak", r"\bKotak\s*(?:Mahindra)?\s*Bank\b"),
    ("IndusInd", r"\bIndusInd\s*Bank\b"),
    ("Yes Bank", r"\bYes\s*Bank\b|\bYESBANK\b"),
    ("Bajaj Finance", r"\bBajaj\s*Finance\b"),
    ("TCS", r"\bTCS\b|\bTata\s*Consultancy\b"),
    ("Infosys", r"\bInfosys\b|\bINFY\b"),
    ("Reliance", r"\bReliance\s*(?:Industries)?\b|\bRIL\b"),
    ("RBI", r"\bRBI\b|\bReserve\s*Bank\b"),
    ("SEBI", r"\bSEBI\b"),
)

#: A number with its unit, and a period.
NUMBER = r"(?i)(?:₹|Rs\.?\s*)?(-?\d{1,3}(?:,\d{3})*(?:\.\d+)?)(\s*(?:crore|cr\.?|lakh|lacs?|mn|bn|billion|million)?\s*(?:%|per\s*cent|bps|basis\s*points?)?)"
PERIOD = r"(?i)\b(Q[1-4]\s*FY\s*\d{2,4}|FY\s*\d{2,4}|H[12]\s*FY\s*\d{2,4}|(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s*'?\d{2,4})\b"
#: Every match of PERIOD holds one of these, in lower case.
PERIOD_NEEDLES = ("fy", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

#: Units by what stands after a number, the first that matches.
UNITS = (("bps", r"\bbps\b|basis\s*point"), ("%", r"%|per\s*cent"), ("crore", r"\bcrore\b|\bcr\b"), ("lakh", r"\blakh\b|\blac"), ("bn", r"\bbillion\b|\bbn\b"), ("mn", r"\bmillion\b|\bmn\b"))


def unit_of(said: Column) -> Column:
    """The unit that a text after a number names, or empty."""
    out = F.lit("")
    for unit, pattern in reversed(UNITS):
        out = F.when(said.rlike(f"(?i){pattern}"), unit).otherwise(out)
    return out


def entity_of(text: Column, low: Column | None = None) -> Column:
    """The first entity that a text names; ``low`` is the text in lower case, where it is at hand.

    A plain search for the fixed part of a name goes before its pattern.
    """
    low = F.lower(text) if low is None else low
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ENTITIES):
        out = F.when(C.contains_any(low, needles(pattern)) & text.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def period_of(text: Column, low: Column | None = None) -> Column:
    """The first period of a text in one spelling: upper case, single spaces, years of two digits; null without. ``low`` as in ``entity_of``."""
    low = F.lower(text) if low is None else low
    found = F.regexp_replace(F.regexp_extract(text, PERIOD, 1), r"(?i)FY\s*20(\d{2})", "FY$1")
    return F.when(C.contains_any(low, PERIOD_NEEDLES), F.nullif(F.upper(F.regexp_replace(found, r"\s+", " ")), F.lit("")))


#: Stands around a match while a text is split at it; a text's own gives way to its neighbour, of the same length.
MARK, OTHER_MARK = "\ue000", "\ue001"


def places(text: Column, pattern: str) -> Column:
    """Array of (start, end), counted from 0, of the matches of a pattern in a text: its matches are marked in one pass, and every second part is one."""
    parts = F.split(F.regexp_replace(F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER_MARK)).otherwise(text), pattern, f"{MARK}$0{MARK}"), MARK, -1)
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none.alias("found"))

    def step(a: Column, part: Column) -> Column:
        end = a["at"] + F.length(part)
        return F.struct(end.alias("at"), (~a["hit"]).alias("hit"), F.when(a["hit"], F.concat(a["found"], F.array(F.struct(a["at"].alias("start"), end.alias("end"))))).otherwise(a["found"]).alias("found"))

    return F.aggregate(parts, start, step, lambda a: a["found"])


def needles(pattern: str) -> list[str]:
    """For each alternative of a pattern, the longest text that every match of it holds, in lower case."""
    loose = re.compile(r"\(\?:[^)]*\)\??|\\[bsdw][*+?]?|.\?|\.")
    return [max(loose.sub("\0", part).split("\0"), key=len).lower() for part in pattern.split("|")]


def _letter(match: re.Match) -> str:
    base, out = match.string[match.start() - 1 : match.start()].isalnum(), []
    for c in match.group():
        base = c.isalpha() or c.isdecimal() or (base and unicodedata.category(c) == "Mn")
        out.append("_" if base else c)
    return "".join(out)


def _plain(text: str) -> str:
    """A text in lower case, letter for letter; letters and digits beyond ASCII, and marks on them, are underscores: part of a word, but of no pattern."""
    return (text if text.isascii() else re.sub(r"[^\x00-\x7f]+", _letter, text)).lower()


#: In the patterns below ``.`` is any character but those that end a line in Spark's patterns.
_ANY = "[^\n\r\x85\u2028\u2029]"
_parts = lambda p: Pattern(p.lower().replace("non.?", f"non{_ANY}?").replace(".to.", f"{_ANY}to{_ANY}"), re.ASCII).parts
_PARTS = alternatives(PERIOD[len(r"(?i)\b(") : -len(r")\b")])
_MONTHS, _YEAR = re.fullmatch(r"\(\?:(.*)\)(.*)", _PARTS[-1]).groups()
#: Each kind of period, and what all of its matches hold.
_PERIODS = [("fy" if k < len(_PARTS) - 1 else p[:3].lower(), rf"\b{p}\b") for k, p in enumerate([*_PARTS[:-1], *(m + _YEAR for m in alternatives(_MONTHS))])]
_DIGIT = re.compile("[0-9]")
_AMOUNT = re.compile(NUMBER[NUMBER.index("(-?") :], re.ASCII)  # from a digit or its sign on; what may stand before changes neither group
_UNITS = [(unit, re.compile(p, re.ASCII)) for unit, p in UNITS]
_unit = lru_cache(4096)(lambda said: next((unit for unit, p in _UNITS if p.search(said)), ""))
_spelled = lru_cache(4096)(lambda said: re.sub(r"\s+", " ", re.sub(r"fy\s*20(\d{2})", r"fy\1", said, flags=re.ASCII), flags=re.ASCII).upper())
_FOUND = "array<struct<metric:string,start:int,value:double,unit:string,entity:string,text_entity:string,period:string>>"
_KINDS = {"metric": pa.string(), "start": pa.int32(), "value": pa.float64(), "unit": pa.string(), "entity": pa.string(), "text_entity": pa.string(), "period": pa.string()}


class _Reader:
    """Mentions of metrics with a number. ``before`` and ``after``: the characters of the window around a name. ``behind``: whether a number after the name goes before all others."""

    def __init__(self, metrics: tuple, before: int, after: int, behind: bool):
        import ahocorasick

        self.before, self.after, self.behind = before, after, behind
        self.rules: list[tuple[int, str, Part]] = []  # 0 for a metric's name, 1 for an entity's, 2 for a period
        of: dict[str, list[int]] = {}
        named = [(kind, name, needle, part) for kind, names in ((0, metrics), (1, ENTITIES)) for name, p, *_ in names for needle, part in zip(needles(p), _parts(p), strict=True)]
        for kind, name, needle, part in [*named, *((2, "", needle, *_parts(p)) for needle, p in _PERIODS)]:
            of.setdefault(needle, []).append(len(self.rules))
            self.rules.append((kind, name, part))
        self.finder = ahocorasick.Automaton()
        for needle, which in of.items():
            self.finder.add_word(needle, tuple(which))
        self.finder.make_automaton()
        self.tried = lru_cache(65_536)(self._tried)

    def _tried(self, held: frozenset) -> tuple[dict[str, list[Part]], dict[str, list[Part]], list[Part]]:
        """Of metrics, entities and periods, the parts that may match where these rules' needles stand."""
        out: tuple[dict[str, list[Part]], ...] = ({}, {}, {})
        for i in sorted(set().union(*held)):
            kind, name, part = self.rules[i]
            out[kind].setdefault(name, []).append(part)
        return out[0], out[1], out[2].get("", [])

    @staticmethod
    def _entity(text: str, named: dict[str, list[Part]]) -> str | None:
        for name, parts in named.items():
            if first(parts, text):
                return name
        return None

    @staticmethod
    def _period(text: str, dated: list[Part]) -> str | None:
        found = first(dated, text)
        return _spelled(found.group()) if found else None

    def mentions(self, text: str) -> list[tuple]:
        """A tuple for each mention, as _KINDS has its parts, metrics in their order; ``text_entity``, that of the whole text, where the window names none."""
        low, ascii_only = _plain(text), text.isascii()
        metrics, named, dated = self.tried(frozenset([which for _, which in self.finder.iter(low)]))
        out, whole = [], None
        for metric, parts in metrics.items():
            for name in each(parts, low):
                start, end = name.span()
                begin = max(0, start - self.before)
                window = low[begin : end + self.after] if ascii_only else _plain(text[begin : end + self.after])
                behind = self.behind and _DIGIT.search(window, end - begin)
                digit = behind or _DIGIT.search(window)
                if not digit:
                    continue
                at, least = digit.start(), end - begin if behind else 0
                value, unit = _AMOUNT.match(window, at - (at > least and window[at - 1] == "-")).groups()
                entity, period = self._entity(window, named), self._period(window, dated)
                if (entity is None or period is None) and whole is None:
                    whole = self._entity(low, named), self._period(low, dated) or ""
                out.append((metric, start, float(value.replace(",", "")), _unit(unit), entity, None if entity else whole[0], period or whole[1]))
        return out


@lru_cache(8)
def _reader(metrics: tuple, before: int, after: int, behind: bool) -> _Reader:
    return _Reader(metrics, before, after, behind)


def _mentions(text: Column, metrics: tuple, after: int, before: int = 150, behind: bool = False) -> Column:
    """For each text an array of its mentions of metrics that have a number."""

    @F.arrow_udf(_FOUND)
    def read(texts: pa.Array) -> pa.Array:
        reader, found, ends = _reader(metrics, before, after, behind), [], [0]
        for said in texts.to_pylist():
            if said:
                found += reader.mentions(said)
            ends.append(len(found))
        columns = zip(*found, strict=True) if found else [()] * len(_KINDS)
        parts = [pa.array(c, kind) for c, kind in zip(columns, _KINDS.values(), strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=list(_KINDS)))

    return read(text)


def claims(rows: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", company: str | None = None) -> DataFrame:
    """A row for each (metric, entity, period) that a text gives a number: metric, value, unit, entity, period, is_ratio, and the text's columns.

    The number is the first in 150 characters around the metric's name; entity and period are those of this
    window, else of the company column or the whole text. Of equal claims of a text the first stays.
    """
    ratios = F.create_map(*[F.lit(x) for name, _, ratio in CLAIM_METRICS for x in (name, ratio)])
    carried = [c for c in rows.columns if c != text]
    found = rows.select(*carried, F.explode(_mentions(F.col(text), CLAIM_METRICS, after=150)).alias("m"))
    named = [F.col("m.entity"), *([F.col(company)] if company else []), F.col("m.text_entity"), F.lit("Unknown")]
    found = found.select(*carried, F.coalesce(*named).alias("entity"), *[F.col(f"m.{c}") for c in ("metric", "start", "value", "unit", "period")])
    first = Window.partitionBy(key, source, "metric", "entity", "period").orderBy("start")
    kept = found.withColumn("before", F.lag("start").over(first)).filter("before IS NULL").withColumn("is_ratio", ratios[F.col("metric")])  # few claims repeat: as a limit of ranks Spark would sort them all before the exchange too
    return kept.select(*carried, "metric", "value", "unit", "entity", "period", "is_ratio", "start")


def records(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A record for each (text, entity, period): metrics and units as maps, the first value of each metric.

    The number after a metric's name, within 180 characters, goes before one up to 150 characters before it.
    """
    found = rows.select(key, F.explode(_mentions(F.col(text), RECORD_METRICS, after=180, behind=True)).alias("m"))
    found = found.select(key, F.coalesce("m.entity", "m.text_entity", F.lit("Unknown")).alias("entity"), *[F.col(f"m.{c}") for c in ("metric", "start", "value", "unit", "period")])
    said = F.sort_array(F.collect_list(F.struct("metric", "start", "value", "unit")))  # one exchange; the first of each metric is that after another metric
    found = found.groupBy(key, "entity", "period").agg(said.alias("said"))
    found = found.select(key, "entity", "period", F.filter("said", lambda x, i: (i == 0) | (x["metric"] != F.get("said", i - 1)["metric"])).alias("said"))
    entries = lambda c: F.map_from_arrays(F.col("said.metric"), F.col(f"said.{c}"))
    return found.select(key, "entity", "period", entries("value").alias("metrics"), entries("unit").alias("units"))


def wide_records(found: DataFrame, metrics: tuple[str, ...] = ("nim", "nii", "gnpa", "nnpa", "casa", "crar", "pcr", "roe", "roa", "pat", "equity", "assets", "pe")) -> DataFrame:
    """Records with a column a metric, as the ratio rules read them."""
    names = {m[0].lower(): m[0] for m in RECORD_METRICS}
    return found.select(*[c for c in found.columns if c not in ("metrics", "units")], *[F.col("metrics")[names[m]].alias(m) for m in metrics])
