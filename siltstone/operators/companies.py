"""Companies and sectors that texts name, by one automaton over all phrases.

The phrases of all companies and the keywords of all sectors go into one automaton each, built once in every task; a text is then read once,
however many phrases there are. A phrase stands between word boundaries, unless it has a ``*`` at that end, and its spaces match any white space.
A text's company is the first in the table that it names; its sector is that company's, or else the sector of which it has the most
keywords, two at least, the first of equals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Companies in the order in which they count, their sectors and their phrases.
COMPANIES = (
    ("HDFC Bank", "banking", "hdfc bank"),
    ("HDFC Ltd", "banking", "hdfc ltd|hdfc limited"),
    ("ICICI Bank", "banking", "icici bank"),
    ("ICICI Prudential", "insurance", "icici prudential"),
    ("SBI", "banking", "state bank of india|sbi"),
    ("Axis Bank", "banking", "axis bank"),
    ("Kotak Mahindra Bank", "banking", "kotak mahindra bank|kotak bank|kotak"),
    ("IndusInd Bank", "banking", "indusind bank"),
    ("Bandhan Bank", "banking", "bandhan bank"),
    ("IDFC First Bank", "banking", "idfc first bank|idfc bank"),
    ("Yes Bank", "banking", "yes bank"),
    ("Federal Bank", "banking", "federal bank"),
    ("PNB", "banking", "punjab national bank|pnb"),
    ("Bank of Baroda", "banking", "bank of baroda|bob"),
    ("Canara Bank", "banking", "canara bank"),
    ("Union Bank", "banking", "union bank"),
    ("AU Small Finance Bank", "banking", "au small finance"),
    ("Equitas Small Finance", "banking", "equitas"),
    ("Utkarsh Small Finance", "banking", "utkarsh"),
    ("Bajaj Finance", "nbfc", "bajaj finance"),
    ("Bajaj Finserv", "nbfc", "bajaj finserv"),
    ("Muthoot Finance", "nbfc", "muthoot finance"),
    ("Manappuram Finance", "nbfc", "manappuram finance"),
    ("Cholamandalam Finance", "nbfc", "chola|cholamandalam"),
    ("Piramal Finance", "nbfc", "piramal enterprises|piramal finance"),
    ("M&M Financial", "nbfc", "m&m financial|mahindra finance"),
    ("Shriram Finance", "nbfc", "shriram transport|shriram finance"),
    ("LIC Housing Finance", "nbfc", "lic housing"),
    ("LIC", "insurance", "lic|*life insurance corporation*"),
    ("SBI Life", "insurance", "sbi life"),
    ("HDFC Life", "insurance", "hdfc life"),
    ("Max Life", "insurance", "max life"),
    ("Star Health", "insurance", "star health"),
    ("TCS", "technology", "tata consultancy|tcs"),
    ("Infosys", "technology", "infosys"),
    ("Wipro", "technology", "wipro"),
    ("HCL Technologies", "technology", "hcl tech|hcl technologies"),
    ("Tech Mahindra", "technology", "tech mahindra"),
    ("Mphasis", "technology", "mphasis"),
    ("LTIMindtree", "technology", "ltimindtree|l&t infotech"),
    ("Persistent Systems", "technology", "persistent systems"),
    ("Coforge", "technology", "coforge"),
    ("Zomato", "technology", "zomato"),
    ("Swiggy", "technology", "swiggy"),
    ("Paytm", "fintech", "paytm|one97"),
    ("Info Edge", "technology", "naukri|infoedge|info edge"),
    ("IndiaMART", "technology", "indiamart"),
    ("Reliance Industries", "energy", "reliance industries|ril"),
    ("Reliance Jio", "telecom", "reliance jio|jio"),
    ("ONGC", "energy", "ongc|oil and natural gas"),
    ("Coal India", "energy", "coal india"),
    ("NTPC", "energy", "ntpc"),
    ("Power Grid", "energy", "power grid"),
    ("Adani Energy", "energy", "adani green|adani power|adani energy"),
    ("Adani Enterprises", "conglomerate", "adani enterprises|adani ports|adani total"),
    ("BPCL", "energy", "bpcl|*bharat petroleum"),
    ("Indian Oil", "energy", "iocl|*indian oil"),
    ("Tata Motors", "automobile", "tata motors"),
    ("Mahindra & Mahindra", "automobile", "mahindra & mahindra|mahindra and mahindra|m&m"),
    ("Maruti Suzuki", "automobile", "maruti suzuki|maruti"),
    ("Hero MotoCorp", "automobile", "hero motocorp|hero honda"),
    ("Bajaj Auto", "automobile", "bajaj auto"),
    ("TVS Motor", "automobile", "tvs motor"),
    ("Eicher Motors", "automobile", "eicher motors"),
    ("Sun Pharma", "pharma", "sun pharma|sun pharmaceutical"),
    ("Dr. Reddy's", "pharma", "dr.reddy|dr. reddy|dr reddy"),
    ("Cipla", "pharma", "cipla|ciplo"),
    ("Divi's Labs", "pharma", "divi lab|divis lab"),
    ("Biocon", "pharma", "biocon"),
    ("Aurobindo Pharma", "pharma", "aurobindo"),
    ("HUL", "fmcg", "hul|*hindustan unilever"),
    ("ITC", "fmcg", "itc limited|itc"),
    ("Nestlé India", "fmcg", "nestle india|nestlé india"),
    ("Britannia", "fmcg", "britannia"),
    ("Dabur", "fmcg", "dabur"),
    ("Godrej Consumer", "fmcg", "godrej consumer|godrej"),
    ("Marico", "fmcg", "marico"),
    ("Colgate", "fmcg", "colgate"),
    ("Tata Steel", "metals", "tata steel"),
    ("JSW Steel", "metals", "jsw steel"),
    ("Hindalco", "metals", "hindal|hindalco"),
    ("Vedanta", "metals", "vedanta"),
    ("L&T", "infrastructure", "larsen & toubro|larsen and toubro|l&t"),
    ("ABB India", "capital_goods", "abb india|abbb india"),
    ("Siemens India", "capital_goods", "siemens india"),
    ("Asian Paints", "chemicals", "asian paints"),
    ("Pidilite", "chemicals", "pidilite"),
    ("SRF", "chemicals", "srf limited|srf"),
    ("NSE", "exchange", "nse|*national stock exchange*"),
    ("BSE", "exchange", "bse|*bombay stock exchange*"),
    ("NSDL", "exchange", "nsdl"),
    ("CDSL", "exchange", "cdsl"),
    ("CAMS", "fintech", "cams"),
    ("KFin Technologies", "fintech", "kfintech"),
)

#: Keywords of sectors, found anywhere in a text, in the order in which equals count.
SECTORS = {
    "banking": "nim|casa|gnpa|nnpa|crar|npa|deposit|credit growth|lending|net interest|provisioning|slippage|recovery|restructured|pcr|llr|current account|savings account|loan book",
    "technology": "attrition|headcount|utilization|deal wins|total contract value|tcv|revenue per employee|digital transformation|cloud|ai|saas|paas|offshore|onsite|billing rate|pipeline",
    "pharma": "anda|nda|usfda|api|formulation|r&d|generic|biosimilar|clinical trial|patent cliff|abbreviated new drug application|dossier",
    "nbfc": "aum|disbursement|yield on assets|cost of borrowing|net interest spread|stage 2|stage 3|ecl|microfinance|gold loan|vehicle finance",
    "energy": "crude|refinery|upstream|downstream|brent|wti|pipeline|lng|natural gas|capacity addition|renewable|solar|wind|gw",
    "fmcg": "volume growth|price realization|distribution|rural|urban|market share|brand|skus|gross margin|ad spends",
    "automobile": "ev|electric vehicle|wholesale|retail|dispatch|penetration|suv|two wheeler|three wheeler|passenger vehicle|commercial vehicle|order book|chip shortage|blended asp",
    "infrastructure": "order book|l1|ebitda margin|capex|execution|toll|concession|bid pipeline|hydro|metro",
    "insurance": "premium|gdp|vnb|apefye|renewal premium|surrender|persistency|combined ratio|loss ratio|embedded value|new business margin",
    "metals": "steel|aluminium|copper|zinc|ebitda per tonne|coking coal|iron ore|realisation|volume",
    "regulatory": "circular|notification|regulation|compliance|penalty|enforcement|directive|guideline",
}

SPACES = re.compile(r"\s+")
LEAST_KEYWORDS = 2


class Phrases:
    """An automaton over phrases with numbers; ``of`` gives the numbers of those in a text."""

    def __init__(self, phrases: list[tuple[str, int]]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        by_words: dict[str, list[tuple[bool, bool, int]]] = {}
        for phrase, number in phrases:
            words = phrase.strip("*")
            by_words.setdefault(words, []).append((not phrase.startswith("*"), not phrase.endswith("*"), number))
        for words, ends in by_words.items():
            self.machine.add_word(words, (len(words), ends))
        self.machine.make_automaton()

    @staticmethod
    def _inside(text: str, at: int) -> bool:
        """Whether a word goes on across this place, which is then no boundary."""
        is_word = lambda c: c == "_" or c.isalnum()
        return 0 < at < len(text) and is_word(text[at - 1]) and is_word(text[at])

    def of(self, text: str) -> set[int]:
        found: set[int] = set()
        for last, (length, ends) in self.machine.iter(text):
            start, end = last + 1 - length, last + 1
            found.update(n for left, right, n in ends if n not in found and not (left and self._inside(text, start)) and not (right and self._inside(text, end)))
        return found


def company_and_sector(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, company, sector (the company's, else that of the keywords) and n_companies; nulls where nothing is named. Null texts name nothing."""
    schema = T.StructType([rows.schema[key], T.StructField("found", T.ArrayType(T.IntegerType())), T.StructField("keywords", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Phrases([(p, i) for i, (_, _, phrases) in enumerate(COMPANIES) for p in phrases.split("|")])
        numbered = [(w, i) for i, words in enumerate(SECTORS.values()) for w in words.split("|")]
        words = Phrases([(f"*{w}*", k) for k, (w, _) in enumerate(numbered)])
        for batch in batches:
            found, counts = [], []
            for whole in batch.column(1).to_pylist():
                low = (whole or "").lower()
                found.append(sorted(names.of(SPACES.sub(" ", low))))
                hits = [0] * len(SECTORS)
                for k in words.of(low):
                    hits[numbered[k][1]] += 1
                counts.append(hits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=schema.names)

    hits = rows.select(key, text).mapInArrow(run, schema)
    first = F.try_element_at("found", F.lit(1))
    of = lambda k: F.get(F.array(*[F.lit(c[k]) for c in COMPANIES]), first)
    most = F.array_max("keywords")
    sector = F.when(most >= LEAST_KEYWORDS, F.get(F.array(*map(F.lit, SECTORS)), (F.array_position("keywords", most) - 1).cast("int")))
    return hits.select(key, of(0).alias("company"), F.coalesce(of(1), sector).alias("sector"), F.size("found").alias("n_companies"))


MOST_PHRASES = 100_000


def phrase_hits(rows: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """key and hits: the numbers of the phrases that a text names, smallest first; texts that name none are left out. ``with_text`` adds the text.

    ``phrases`` has phrase (lower case, single spaces, ``*`` at an open end) and number. It goes to every task as a whole and may have MOST_PHRASES rows.
    """
    listed = phrases.select("phrase", F.col("number").cast("int").alias("number")).filter("phrase <> ''").limit(MOST_PHRASES + 1).collect()
    if len(listed) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases; join the words of the texts with them instead")
    pairs = [(r.phrase, r.number) for r in listed]
    schema = T.StructType([rows.schema[key], T.StructField("hits", T.ArrayType(T.IntegerType())), *[rows.schema[text]] * with_text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Phrases(pairs) if pairs else None
        for batch in batches if machine else ():
            hits = [sorted(machine.of(SPACES.sub(" ", (t or "").lower()))) or None for t in batch.column(1).to_pylist()]
            found = pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int32())), *[batch.column(1)] * with_text], names=schema.names)
            yield found.filter(found.column(1).is_valid())

    return rows.select(key, text).mapInArrow(run, schema)
