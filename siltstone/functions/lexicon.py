"""Weights, thresholds, patterns and word lists, each a default that callers can replace."""

#: Authority of a source type, 0 to 1.
AUTHORITY = {
    "rbi": 1.00, "sebi": 1.00, "mca": 0.95, "tax_law": 0.90, "annual_report": 0.75,
    "earnings_transcript": 0.65, "broker_research": 0.40, "news": 0.25, "unknown": 0.20, "blog": 0.15,
}

#: Authority of a source type as a multiplier.
AUTHORITY_FACTOR = {
    "rbi": 1.5, "sebi": 1.5, "mca": 1.4, "annual_report": 1.3, "tax_law": 1.3,
    "earnings_transcript": 1.2, "broker_research": 1.1, "news": 1.0, "blog": 0.8, "unknown": 0.7,
}

NAMESPACES = {
    "rbi": "regulatory", "sebi": "regulatory", "mca": "regulatory", "tax_law": "regulatory", "income_tax": "regulatory", "irdai": "regulatory",
    "annual_report": "corporate", "earnings_transcript": "corporate", "broker_research": "research",
    "news": "news", "blog": "research", "unknown": "default",
}

CHUNK_SIZES = {
    "annual_report": (1200, 200), "earnings_transcript": (1000, 150), "rbi": (800, 120), "sebi": (800, 120), "mca": (800, 120),
    "tax_law": (900, 150), "broker_research": (700, 100), "news": (600, 80), "blog": (500, 60), "unknown": (1000, 150),
}

#: Weights of similarity, authority, recency and overlap in the additive score.
HYBRID_WEIGHTS = (0.55, 0.25, 0.12, 0.08)

THESIS_PHRASES = ("will outperform", "will underperform", "thesis", "investment case", "because", "driven by", "my view", "i believe", "overweight", "underweight", "buy case", "bear case", "bull case")
REGULATORY_WORDS = ("rbi", "sebi", "circular", "regulation", "compliance", "irdai", "pfrda", "income tax", "gst", "fema", "mca", "penalty", "violation", "nri tax", "ltcg", "stcg")
COMPARE_WORDS = ("vs", "versus", "compare", "comparison", "difference between", "better than", "worse than", "top 5")

#: Risk dimensions and their weights.
RISK_WEIGHTS = {"demand": 1.3, "margin": 1.2, "valuation": 1.1, "regulatory": 1.0, "macro": 1.1, "competitive": 1.0}

#: What marks an assumption in a sentence, the first that matches gives its confidence.
ASSUMPTION_PATTERNS = (
    (r"(?:will|shall|expected\s+to|likely\s+to|projected\s+to|forecast\s+to)\s+\w+", 0.55),
    (r"(?:if|assuming|provided\s+that|given\s+that)\s+[\w\s,]+", 0.45),
    (r"(?:growth|expansion|improvement|compression|slowdown)\s+(?:of|in|to)\s+\d", 0.60),
    (r"(?:rate\s*cut|rate\s*hike|rbi|sebi|regulatory)", 0.50),
)

#: Categories of assumptions by words in them, the first wins.
ASSUMPTION_CATEGORIES = {
    "demand": ("revenue", "demand", "volume", "growth", "market share"),
    "margin": ("margin", "ebitda", "nim", "npa", "profitability", "cost"),
    "valuation": ("pe", "p/e", "valuation", "multiple", "re-rate", "price"),
    "regulatory": ("rbi", "sebi", "regulatory", "policy", "regulation", "law"),
    "macro": ("rate", "inflation", "gdp", "macro", "fx", "dollar", "rate cut"),
    "competitive": ("competitor", "competition", "market share", "moat"),
}

#: Words that are no key terms.
PLAIN_WORDS = (
    "which", "where", "their", "there", "these", "those", "would", "could", "should", "about", "above", "below",
    "because", "therefore", "however", "although", "while",
)

ABBREVIATIONS = (
    "rs", "ltd", "inc", "corp", "dr", "mr", "mrs", "ms", "prof", "vs", "etc", "approx", "est", "viz", "no", "vol", "fig", "dept", "govt", "mgmt",
    "q1", "q2", "q3", "q4", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
)

BOILERPLATE = (
    r"this\s+document\s+is\s+for\s+(?:information|informational)\s+purposes?\s+only",
    r"past\s+performance\s+(?:is\s+not|does\s+not\s+guarantee)\s+(?:a\s+)?(?:guarantee|indicator)\s+of\s+future",
    r"this\s+(?:report|document|material)\s+(?:has\s+been\s+)?prepared\s+by",
    r"(?:please\s+)?(?:read|refer\s+to)\s+the\s+(?:important\s+)?(?:disclosures?|disclaimers?)",
    r"(?:sebi\s+)?registration\s+(?:number|no\.?)\s*[:\-]?\s*[A-Z0-9]+",
    r"analyst\s+certification",
    r"conflicts?\s+of\s+interest",
    r"all\s+rights?\s+reserved",
    r"confidential(?:ity)?\s+notice",
    r"not\s+for\s+(?:public\s+)?distribution",
    r"for\s+(?:private\s+)?(?:circulation|use)\s+only",
    r"investment\s+in\s+(?:securities|mutual\s+funds?)\s+(?:is\s+)?subject\s+to\s+market\s+risk",
    r"mutual\s+fund\s+investments?\s+are\s+subject\s+to\s+market\s+risks?",
    r"page\s+\d+\s+of\s+\d+",
    r"^\s*\d+\s*$",
    r"(?:cin|llpin)\s*:\s*[A-Z0-9]+",
)
