"""Registered queries: dictionary, extraction of claims and records, questions, requests, responses.

Texts for extraction are made from orders, with numbers that the SQL takes from the orders themselves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as M
from ..operators import dictionary as D
from ..operators import extraction as E
from ..operators import requests as R
from ..operators import responses as A
from ..operators import understanding as U
from ..operators import vector as V
from ..session import spread, spread_far, spread_few
from ..sources.tables import table
from . import evidence as G
from . import fixtures as X

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# Dictionary

QUESTION = "What is RBI's view on NIM and {0} after FY26 for TCS, and will NIM rise?"
ASKED = ("GNPA", "CRAR", "CET1", "XYZ")
QUESTIONS_SQL = f"""q AS (SELECT o_orderkey AS doc_id, {list(ASKED)}[CAST(o_orderkey % 4 + 1 AS INT)] AS a FROM orders)"""
MEANING_SQL = "CASE a WHEN 'GNPA' THEN 'Gross Non-Performing Assets' WHEN 'CRAR' THEN 'Capital to Risk-weighted Assets Ratio' WHEN 'CET1' THEN 'Common Equity Tier 1' END"


def questions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    asked = F.element_at(F.array(*[F.lit(a) for a in ASKED]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    before, after = QUESTION.split("{0}")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit(before), asked, F.lit(after)).alias("text"))


def terms(spark):
    custom = spark.createDataFrame([("rbi", "Reserve Bank of India"), ("fy", "Financial Year"), ("NIM", "Net Interest Margin")], "acronym string, meaning string")
    return D.inserted(D.default(spark), custom)


@query(f"""WITH {QUESTIONS_SQL}, m AS (SELECT doc_id, a, {MEANING_SQL} AS meaning FROM q)
SELECT doc_id, 'What is Reserve Bank of India (RBI)''s view on Net Interest Margin (NIM) and ' || CASE WHEN meaning IS NULL THEN a ELSE meaning || ' (' || a || ')' END || ' after Financial Year (FY26) for Tax Collected at Source (TCS), and will NIM rise?' AS expanded FROM m""")
def acronym_apply(spark, sf_dir):
    return D.expanded(questions(spark, sf_dir), terms(spark)).select("doc_id", "expanded")


@query("""SELECT o_orderkey, ['NIM', 'nim', 'FY26', 'At1', 'ZZZ9', 'TCS'][CAST(o_orderkey % 6 + 1 AS INT)] AS acronym, ['Net Interest Margin', 'Net Interest Margin', 'Financial Year', 'Additional Tier 1', NULL, 'Tax Collected at Source'][CAST(o_orderkey % 6 + 1 AS INT)] AS meaning FROM orders""")
def acronym_lookup(spark, sf_dir):
    asked = F.element_at(F.array(*[F.lit(a) for a in ("NIM", "nim", "FY26", "At1", "ZZZ9", "TCS")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return D.looked_up(table(spark, sf_dir, "orders").select("o_orderkey", asked.alias("acronym")), terms(spark)).select("o_orderkey", "acronym", "meaning")


def parts(spark, sf_dir):
    """Parts as a caller's terms: the number is the acronym, the name its meaning."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit(" p"), F.col("p_partkey").cast("string")).alias("acronym"), F.col("p_name").alias("meaning"))


@query("SELECT 'P' || p_partkey AS acronym, p_name AS meaning, 'custom' AS category FROM part")
def dictionary_insert(spark, sf_dir):
    return D.of_category(D.inserted(D.default(spark), parts(spark, sf_dir)), "custom").select("acronym", "meaning", "category")


@query("""SELECT * FROM (VALUES ('CRAR', 'Capital to Risk-weighted Assets Ratio'), ('SLR', 'Statutory Liquidity Ratio'), ('CRR', 'Cash Reserve Ratio'), ('LCR', 'Liquidity Coverage Ratio'), ('NSFR', 'Net Stable Funding Ratio'), ('PCR', 'Provision Coverage Ratio'), ('CAR', 'Capital Adequacy Ratio')) t(acronym, meaning)
UNION ALL SELECT 'P' || p_partkey, p_name || ' ratio' FROM part""")
def dictionary_search(spark, sf_dir):
    custom = parts(spark, sf_dir).withColumn("meaning", F.concat("meaning", F.lit(" ratio")))
    return D.searched(D.inserted(D.default(spark), custom), "RATIO").select("acronym", "meaning")


@query(f"""WITH {QUESTIONS_SQL}, m AS (SELECT doc_id, a, {MEANING_SQL} AS meaning FROM q)
SELECT doc_id, 'RBI: Reserve Bank of India;NIM: Net Interest Margin;' || CASE WHEN meaning IS NULL THEN '' ELSE a || ': ' || meaning || ';' END || 'TCS: Tax Collected at Source' AS glossary FROM m""")
def acronym_glossary(spark, sf_dir):
    found = D.with_glossary(questions(spark, sf_dir), terms(spark))
    lines = F.split(F.substring_index("with_glossary", "\n\nGLOSSARY:\n", -1), "\n")
    return found.select("doc_id", F.array_join(F.transform(lines, lambda x: F.trim(x)), ";").alias("glossary"))


# Claims and records

FILLER = " and so on" * 40
NUMBERS = {"nim": "o_orderkey % 80 + 11", "gnpa": "o_orderkey % 37 + 2", "revenue": "o_orderkey % 9000 + 1000"}
STATEMENT_SQL = """s AS (SELECT o_orderkey AS doc_id, o_custkey % 5 AS who, (o_orderkey % 80 + 11) / 10.0::DOUBLE AS nim, (o_orderkey % 37 + 2)::DOUBLE AS gnpa, (o_orderkey % 9000 + 1000)::DOUBLE AS revenue, 1 + o_orderkey % 4 AS q, 20 + o_orderkey % 7 AS fy,
  'source ' || (o_custkey % 11) AS source, CAST(o_orderdate AS DATE) AS day FROM orders)"""
WHO_SQL = "['HDFC Bank', 'ICICI Bank', 'SBI', 'Axis Bank', 'Unknown'][CAST(who + 1 AS INT)]"


def statements(spark, sf_dir):
    """What three metrics of a bank are said to be, far enough apart to be read by themselves."""
    o = spread_far(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    who = F.element_at(F.array(*[F.lit(w) for w in ("HDFC Bank", "ICICIBANK", "State Bank of India", "Axis  Bank", "The bank")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    nim = (F.expr(NUMBERS["nim"]) / 10).cast("decimal(4,1)").cast("string")
    period = F.concat(F.lit("Q"), (1 + F.col("o_orderkey") % 4).cast("string"), F.lit(" FY"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("20")).otherwise(F.lit("")), (20 + F.col("o_orderkey") % 7).cast("string"))
    text = F.concat(
        who, F.lit(" said that its net interest margin stood at "), nim, F.lit("% in "), period, F.lit(FILLER), F.lit(". For "), who, F.lit(" gross NPA rose by "), F.expr(NUMBERS["gnpa"]).cast("string"), F.lit(" bps in FY 2024"),
        F.lit(FILLER), F.lit(". Revenue of "), who, F.lit(" was Rs. "), F.format_number(F.expr(NUMBERS["revenue"]), 0), F.lit(" crore"),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("source "), (F.col("o_custkey") % 11).cast("string")).alias("source"), F.to_date("o_orderdate").alias("day"), text.alias("text"))


CLAIMED_SQL = f"""{STATEMENT_SQL}, c AS (SELECT doc_id, source, day, 'NIM' AS metric, nim AS value, '%' AS unit, {WHO_SQL} AS entity, 'Q' || q || ' FY' || fy AS period, true AS is_ratio FROM s
UNION ALL SELECT doc_id, source, day, unnest(['GNPA', 'NPA']), gnpa, 'bps', {WHO_SQL}, 'FY24', true FROM s UNION ALL SELECT doc_id, source, day, 'Revenue', revenue, 'crore', {WHO_SQL}, 'Q' || q || ' FY' || fy, false FROM s)"""


@query(f"WITH {CLAIMED_SQL} SELECT doc_id, source, metric, value, unit, entity, period, is_ratio FROM c")
def claim_extraction(spark, sf_dir):
    return E.claims(statements(spark, sf_dir)).select("doc_id", "source", "metric", "value", "unit", "entity", "period", "is_ratio")


@query(f"""WITH {CLAIMED_SQL}, k AS (SELECT *, lower(entity) AS e, lower(period) AS p, doc_id * 4 + CASE metric WHEN 'NIM' THEN 0 WHEN 'GNPA' THEN 1 WHEN 'NPA' THEN 2 ELSE 3 END AS claim_id FROM c),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric, e, p, source ORDER BY day DESC, claim_id) AS nth FROM k) WHERE nth = 1),
x AS (SELECT upper(a.metric) AS metric, a.e AS entity, a.p AS period, a.claim_id AS claim_id_a, b.claim_id AS claim_id_b, abs(a.value - b.value) AS diff, abs((a.value + b.value) / 2) AS base, a.is_ratio FROM l a JOIN l b ON a.metric = b.metric AND a.e = b.e AND a.p = b.p AND a.claim_id < b.claim_id AND a.source <> b.source)
SELECT metric, entity, period, claim_id_a, claim_id_b, round(diff / base * 100, 2) AS pct_diff FROM x WHERE diff / base * 100 > 5 OR (is_ratio AND diff > 0.5)""")
def extracted_conflicts(spark, sf_dir):
    """Claims read from texts, then compared between sources."""
    order = F.when(F.col("metric") == "NIM", 0).when(F.col("metric") == "GNPA", 1).when(F.col("metric") == "NPA", 2).otherwise(3)
    found = E.claims(statements(spark, sf_dir)).withColumn("claim_id", F.col("doc_id") * 4 + order).withColumn("source_type", F.lit("unknown"))
    return M.conflicts(found, top=None).select("metric", "entity", "period", "claim_id_a", "claim_id_b", "pct_diff")


@query(f"""WITH {STATEMENT_SQL}, p AS (SELECT doc_id, lower({WHO_SQL}) AS entity, who, 'Q' || q || ' FY' || fy AS period, nim, gnpa, revenue FROM s)
SELECT doc_id, period, nim, NULL::DOUBLE AS gnpa, revenue FROM p UNION ALL SELECT doc_id, 'FY24', NULL, gnpa, NULL FROM p""")
def record_extraction(spark, sf_dir):
    found = E.records(statements(spark, sf_dir))
    return found.select("doc_id", "period", *[F.col("metrics")[m].alias(m.lower()) for m in ("NIM", "GNPA", "Revenue")])


# Questions

ASKING = (
    "What is HDFC Bank NIM?",
    "Compare HDFC Bank and ICICI for NIM and GNPA in Q3 FY26",
    "SBI, Axis Bank and Kotak revenue FY25",
    "HDFC nim casa roe in FY24",
    "PNB ROE in FY23 and FY24",
    "RBI circular on repo rate",
)
ASKED_PARTS = (
    (0, "SIMPLE", 1, ASKING[0]), (1, "COMPARISON", 1, "HDFC Bank nim Q3 FY26"), (1, "COMPARISON", 2, "ICICI Bank nim Q3 FY26"), (1, "COMPARISON", 3, "HDFC Bank gnpa Q3 FY26"), (1, "COMPARISON", 4, "ICICI Bank gnpa Q3 FY26"),
    (2, "MULTI_ENTITY", 1, "SBI revenue FY25"), (2, "MULTI_ENTITY", 2, "Axis Bank revenue FY25"), (2, "MULTI_ENTITY", 3, "Kotak Mahindra revenue FY25"),
    (3, "MULTI_METRIC", 1, "HDFC Bank nim FY24"), (3, "MULTI_METRIC", 2, "HDFC Bank casa FY24"), (3, "MULTI_METRIC", 3, "HDFC Bank roe FY24"), (4, "TEMPORAL", 1, "PNB roe FY23"), (4, "TEMPORAL", 2, "PNB roe FY24"), (5, "SIMPLE", 1, ASKING[5]),
)


def asking(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(a) for a in ASKING]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), text.alias("text"))


PARTS_SQL = "(VALUES " + ", ".join("({}, '{}', {}, '{}')".format(*p) for p in ASKED_PARTS) + ") p(k, strategy, priority, subquery)"


@query(f"SELECT o_orderkey AS query_id, strategy, priority::INT AS priority, subquery FROM orders JOIN {PARTS_SQL} ON k = o_orderkey % 6")
def query_parts(spark, sf_dir):
    return U.decomposed(asking(spark, sf_dir))


@query("""SELECT o_orderkey AS query_id, ['HDFC Bank', 'HDFC Bank,ICICI Bank', 'SBI,Axis Bank,Kotak Mahindra', 'HDFC Bank', 'PNB', ''][CAST(o_orderkey % 6 + 1 AS INT)] AS entities, ['nim', 'nim,gnpa', 'revenue', 'nim,casa,roe', 'roe', 'repo rate'][CAST(o_orderkey % 6 + 1 AS INT)] AS metrics,
[false, true, true, true, true, false][CAST(o_orderkey % 6 + 1 AS INT)] AS is_complex, ['FACTUAL', 'COMPARATIVE', 'FACTUAL', 'FACTUAL', 'FACTUAL', 'REGULATORY'][CAST(o_orderkey % 6 + 1 AS INT)] AS query_class FROM orders""")
def query_reading(spark, sf_dir):
    q = U.parsed(asking(spark, sf_dir))
    return q.select("query_id", F.array_join("entities", ",").alias("entities"), F.array_join("metrics", ",").alias("metrics"), "is_complex", U.rag_class(F.col("text")).alias("query_class"))


@query("""WITH t AS (SELECT o_orderkey, (o_orderkey % 90) / 10.0::DOUBLE AS x FROM orders) SELECT o_orderkey, 'NIM,SBI,' || CAST(CAST(x AS DECIMAL(4,1)) AS VARCHAR) || '%,2026,7,widen,margins,funding,lines' AS terms FROM t""")
def key_terms(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("NIM of SBI should widen, because margins of "), ((F.col("o_orderkey") % 90) / 10).cast("decimal(4,1)").cast("string"), F.lit("% in 2026 rest on 7 or 9 funding lines"))
    return o.select("o_orderkey", F.array_join(U.key_terms(text), ",").alias("terms"))


# Requests

PARTS = {"subject": ("The bank ", "It "), "claim": ("will outperform its peers ", "does what it does "), "reason": ("because money stays cheap", "and that is all of it")}


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS s, o_orderkey // 2 % 2 = 0 AS c, o_orderkey // 4 % 2 = 0 AS r, o_orderkey % 50 = 49 AS brief FROM orders)
SELECT o_orderkey, CASE WHEN brief THEN 'too brief' WHEN NOT s AND NOT c AND NOT r THEN 'no subject, claim or reason' WHEN NOT s THEN 'no subject' WHEN NOT c THEN 'no claim' WHEN NOT r THEN 'no reason' END AS refused FROM t""")
def thesis_preflight(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pick = lambda name, on: F.when(on, F.lit(PARTS[name][0])).otherwise(F.lit(PARTS[name][1]))
    k = F.col("o_orderkey")
    text = F.concat(pick("subject", k % 2 == 0), pick("claim", F.floor(k / 2) % 2 == 0), pick("reason", F.floor(k / 4) % 2 == 0), F.when(k % 50 != 49, F.lit(" for a long, long time to come")).otherwise(F.lit("")))
    brief = F.when(k % 50 == 49, F.lit("The bank will grow because of it")).otherwise(text)
    return R.thesis_preflight(o.select("o_orderkey", brief.alias("text"))).select("o_orderkey", "refused")


@query("SELECT o_custkey, count(*) AS n, CASE WHEN count(*) > 10 THEN 'too many queries' WHEN bool_or(o_orderkey % 17 = 0) THEN 'a blank query' END AS refused FROM orders GROUP BY o_custkey")
def batch_checks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 17 == 0, F.lit("  ")).otherwise(F.lit("a query")).alias("text"))
    return R.batch_checks(o, "o_custkey")


URLS = (("https://example.org/a", None), ("ftp://example.org/a", "scheme"), ("http://localhost:80/", "private host"), ("http://10.1.2.3/x", "private host"), ("http://172.20.0.1/", "private host"), ("https://172.40.0.1/", None), ("http:///x", "no host"), ("http://me@192.168.0.9/", "private host"))
URLS_SQL = "[" + ", ".join("NULL" if r is None else f"'{r}'" for _, r in URLS) + "]"


@query(f"SELECT o_orderkey, {URLS_SQL}[CAST(o_orderkey % 8 + 1 AS INT)] AS refused, o_orderkey % 3 = 0 AS is_date FROM orders")
def url_checks(spark, sf_dir):
    url = F.element_at(F.array(*[F.lit(u) for u, _ in URLS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    day = F.element_at(F.array(F.lit("2026-02-28"), F.lit("2026-02-30"), F.lit("28-02-2026")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.url_refused(url).alias("refused"), R.is_iso_date(day).alias("is_date"))


LINES = (("MANAGEMENT DISCUSSION", True), ("Risk Factors and Outlook", True), ("12.5", False), ("ok", False), ("this line goes on in lower case", False), ("The Bank Of The North Said That It Would Not Go On.", False), ("1. Financial Highlights", True))


@query(f"SELECT o_orderkey, {[h for _, h in LINES]}[CAST(o_orderkey % 7 + 1 AS INT)] AS is_header FROM orders".replace("True", "true").replace("False", "false"))
def header_lines(spark, sf_dir):
    line = F.element_at(F.array(*[F.lit(x) for x, _ in LINES]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.is_header_line(line).alias("is_header"))


# Responses

BREAKS_SQL = "breaks AS (SELECT o_custkey AS thesis, o_orderkey % 5 = 0 AS triggered, CASE WHEN o_orderkey % 3 = 0 THEN 'High' ELSE 'Low' END AS probability FROM orders)"


@query(f"""WITH {G.RISKS_SQL}, {G.ASSUMPTIONS_SQL}, {BREAKS_SQL}, a AS (SELECT thesis, count(*) FILTER (critical) AS n_critical, count(*) FILTER (NOT supported) AS n_unsupported, round(avg(supported::INT) * 100, 1) AS support_rate FROM assumptions GROUP BY thesis),
r AS (SELECT thesis, round(avg(score), 2) AS avg_risk FROM risks GROUP BY thesis), h AS (SELECT thesis, dimension AS highest_risk FROM (SELECT *, row_number() OVER (PARTITION BY thesis ORDER BY score DESC, dimension) AS nth FROM risks) WHERE nth = 1),
b AS (SELECT thesis, count(*) FILTER (triggered) AS n_triggered, count(*) FILTER (probability = 'High') AS n_likely FROM breaks GROUP BY thesis) SELECT * FROM a JOIN r USING (thesis) JOIN h USING (thesis) JOIN b USING (thesis)""")
def thesis_counters(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    breaks = o.select(F.col("o_custkey").alias("thesis"), (F.col("o_orderkey") % 5 == 0).alias("triggered"), F.when(F.col("o_orderkey") % 3 == 0, "High").otherwise("Low").alias("probability"))
    return A.thesis_counters(G.assumptions(spark, sf_dir), G.risks(spark, sf_dir), breaks, "thesis")


ANSWERS_SQL = "answers AS (SELECT c_custkey AS query_id, c_custkey % 40 AS batch, c_custkey * 37 % 6000 AS latency_ms, ['Low', 'Medium', 'High'][CAST(c_custkey % 3 + 1 AS INT)] AS confidence, c_custkey % 4 = 0 AS cache_hit FROM customer)"


def answers(spark, sf_dir):
    k = F.col("c_custkey")
    confidence = F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("query_id"), (k % 40).alias("batch"), (k * 37 % 6000).alias("latency_ms"), confidence.alias("confidence"), (k % 4 == 0).alias("cache_hit"))


@query(f"""WITH {ANSWERS_SQL}, c AS (SELECT o_custkey AS query_id, count(*) AS n_citations, count(*) FILTER (o_orderkey % 10 IN (0, 1, 2)) AS n_regulatory FROM orders GROUP BY 1), k AS (SELECT o_custkey AS query_id, count(*) FILTER (o_orderstatus = 'F') AS n_conflicts FROM orders GROUP BY 1)
SELECT query_id, latency_ms, coalesce(n_citations, 0) AS n_citations, coalesce(n_regulatory, 0) AS n_regulatory, coalesce(n_conflicts, 0) AS n_conflicts, coalesce(n_conflicts, 0) > 0 AS has_conflicts, latency_ms <= 3000 AS in_time FROM answers LEFT JOIN c USING (query_id) LEFT JOIN k USING (query_id)""")
def answer_counts(spark, sf_dir):
    cited = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderstatus", X.source_type_of(F.col("o_orderkey")).alias("source_type"))
    return A.answer_counts(cited, cited.filter("o_orderstatus = 'F'"), answers(spark, sf_dir).select("query_id", "latency_ms"), "query_id")


@query(f"WITH {ANSWERS_SQL} SELECT batch, count(*) AS n, count(*) FILTER (confidence <> 'Low' OR cache_hit) AS n_successful, count(*) FILTER (confidence = 'Low' AND NOT cache_hit) AS n_failed, round(avg(latency_ms), 1) AS avg_latency_ms FROM answers GROUP BY batch")
def batch_summary(spark, sf_dir):
    return A.batch_summary(answers(spark, sf_dir), "batch")


@query("SELECT event_type, count(*) AS n, round(avg((value > 50)::INT) * 100, 2) AS hit_pct, round(avg((event_type = 'error')::INT) * 100, 2) AS error_pct, round(avg(value), 2) AS avg_latency_ms FROM events GROUP BY event_type")
def metrics_view(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") > 50).alias("cache_hit"), (F.col("event_type") == "error").alias("error"), F.col("value").alias("latency_ms"))
    return A.metrics_view(e, "event_type")


@query(r"SELECT source, CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))) AS BIGINT) AS n_tokens FROM documents GROUP BY source")
def token_sum(spark, sf_dir):
    return A.token_sum(table(spark, sf_dir, "documents"), "source")


@query(f"""WITH {G.ASSUMPTIONS_SQL}, c AS (SELECT thesis, node, confidence, row_number() OVER (PARTITION BY thesis ORDER BY node) AS place FROM assumptions WHERE critical)
SELECT thesis, place::INT AS place, 'Assumption fails: node ' || node AS condition, 'Monitor: demand indicators' AS trigger_metric, CASE WHEN confidence < 0.5 THEN 'High' ELSE 'Medium' END AS probability FROM c WHERE place <= 6""")
def heuristic_breaks(spark, sf_dir):
    rows = G.assumptions(spark, sf_dir).withColumn("sentence", F.concat(F.lit("node "), F.col("node").cast("string"))).withColumn("category", F.lit("demand")).withColumn("n", F.col("node"))
    return A.heuristic_breaks(rows).select("thesis", "place", "condition", "trigger_metric", "probability")


CONDITIONS = ((1, "Growth falls below 5 while the shnt ngou lines erod"), (2, "No threshold here"), (3, "Margin drops below 3 when zzzzz qqqqq appear"), (4, "Loans rise above 9.5 with this entr heit ment"))


@query(f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in CONDITIONS)}) c(condition_id, condition)),
w AS (SELECT condition_id, list_distinct(list_filter(regexp_extract_all(lower(condition), '[a-z]{{4,}}'), lambda w: w NOT IN ('will', 'when', 'that', 'this', 'from', 'with', 'have', 'been', 'than', 'below', 'above', 'falls'))[1:5]) AS ts FROM c WHERE regexp_matches(lower(condition), '(?:below|above)\\s+[\\d.]+')),
d AS (SELECT lower(text) AS t FROM documents WHERE (doc_id * 37 % 100) / 100.0 >= 0.7), h AS (SELECT condition_id, count(*) AS n FROM w, d WHERE len(list_filter(ts, lambda x: contains(t, x))) >= 2 GROUP BY 1)
SELECT condition_id, coalesce(n, 0) >= 2 AS triggered FROM c LEFT JOIN h USING (condition_id)""")
def breaks_triggered(spark, sf_dir):
    conditions = spark.createDataFrame(list(CONDITIONS), "condition_id int, condition string")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", ((F.col("doc_id") * 37 % 100) / F.lit(100.0)).alias("score"))
    return A.triggered(conditions, chunks)


@query("""WITH s AS (SELECT l_orderkey AS request, l_linenumber AS n, 'step' || l_linenumber AS step, CAST(l_quantity AS INT) AS ms FROM lineitem), m AS (SELECT request, step AS slowest FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY ms DESC, n) AS nth FROM s) WHERE nth = 1)
SELECT request, string_agg(step || ' ' || ms || ' ms', ' > ' ORDER BY n, step, ms) AS trace, CAST(sum(ms) AS BIGINT) AS total_ms, max(slowest) AS slowest FROM s JOIN m USING (request) GROUP BY request""")
def request_trace(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return A.trace(li.select(F.col("l_orderkey").alias("request"), n.alias("n"), F.concat(F.lit("step"), n.cast("string")).alias("step"), F.col("l_quantity").cast("int").alias("ms")), "request")


@query(f"""WITH {X.VECTORS_SQL}, scored AS ({X.SIMILARITY_SQL}), h AS (SELECT query_id, vec_id, round(0.55 * greatest(0, least(1, score)) + 0.25 * round(greatest(0, least(1, ({X.case_sql('source_type', X.AUTHORITY, 0.2)} - 0.15) / 0.85::DOUBLE)), 6)
+ 0.12 * CASE WHEN age <= 180 THEN 1.0::DOUBLE WHEN age >= 730 THEN 0.05::DOUBLE ELSE round(0.05 + 0.95 * (1 + cos(pi() * (age - 180) / 550.0::DOUBLE)) / 2, 6) END + 0.08 * round(len(list_intersect(query_terms, terms)) / len(query_terms)::DOUBLE, 6), 6) AS final_score
FROM (SELECT *, date_diff('day', doc_date, DATE '{X.AS_OF}') AS age FROM scored)) SELECT query_id, vec_id, final_score FROM h WHERE final_score >= 0.5""")
def composite_floor(spark, sf_dir):
    scored = V.hybrid_score(V.similarity(X.vectors(spark, sf_dir), X.queries(spark, sf_dir), as_of=X.AS_OF, least=0.5), X.AS_OF)
    return V.composite_floor(scored, 0.5).select("query_id", "vec_id", "final_score")


# Tags

FILE_NAMES = (("SEBI_note.pdf", "sebi"), ("Annual_Report_2023.pdf", "annual_report"), ("x.txt", None), ("q3fy26_concall.pdf", "earnings_transcript"), ("cbdt.txt", "income_tax"))
BODIES = (("On 2024-05-06 the companies act said NIM of 4.25% with CASA at 41.5%", "mca", "2024-05-06"), ("Reports said that results of March 2023 are out; gross NPA 61%", "news", "March 2023"), ("plain words for FY25 and ROE of 15.2 %", "unknown", "25"))


@query(f"""SELECT o_orderkey, coalesce({'[' + ', '.join('NULL' if t is None else f"'{t}'" for _, t in FILE_NAMES) + ']'}[CAST(o_orderkey % 5 + 1 AS INT)], {[b[1] for b in BODIES]}[CAST(o_orderkey % 3 + 1 AS INT)]) AS source_type,
CASE WHEN o_orderkey % 7 = 0 THEN '2020-01-02' ELSE {[b[2] for b in BODIES]}[CAST(o_orderkey % 3 + 1 AS INT)] END AS date, CASE WHEN o_orderkey % 7 = 0 THEN 2020 ELSE [2024, 2023, NULL][CAST(o_orderkey % 3 + 1 AS INT)] END::INT AS date_year,
['casa_ratio_pct=41.5,nim_pct=4.25', '', 'roe_pct=15.2'][CAST(o_orderkey % 3 + 1 AS INT)] AS figures FROM orders""")
def chunk_tags(spark, sf_dir):
    o, k = spread_few(table(spark, sf_dir, "orders").select("o_orderkey")), F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    chunks = o.select("o_orderkey", pick([f for f, _ in FILE_NAMES], 5).alias("file_name"), pick([b[0] for b in BODIES], 3).alias("text"), F.when(k % 7 == 0, F.lit("2020-01-02")).otherwise(F.lit("")).alias("base_date"))
    from ..operators import tags

    shown = F.transform(F.array_sort(F.map_entries("figures")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return tags.tagged(chunks).select("o_orderkey", "source_type", "date", "date_year", F.array_join(shown, ",").alias("figures"))


@query("""SELECT o_orderkey AS thesis, u.n::INT AS n, u.query FROM orders, (VALUES (0, 0, 'HDFC Bank NIM should rise as RBI eases; its book value is low'), (0, 1, 'HDFC Bank nim book value'), (0, 2, 'rbi India FY26'), (0, 3, 'HDFC Bank book value historical'),
(1, 0, 'Rates will fall and revenue grows'), (1, 1, 'Indian banking revenue'), (1, 2, 'India macroeconomic outlook FY26 interest rate inflation')) u(k, n, query) WHERE u.k = o_orderkey % 2""")
def thesis_queries(spark, sf_dir):
    from ..operators import tags

    text = F.when(F.col("o_orderkey") % 2 == 0, F.lit("HDFC Bank NIM should rise as RBI eases; its book value is low")).otherwise(F.lit("Rates will fall and revenue grows"))
    return tags.thesis_queries(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("thesis"), text.alias("text")), ("HDFC Bank", "Infosys"))


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders), b AS (SELECT user_id AS k, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events)
SELECT k, place::INT AS place, x, y FROM a FULL JOIN b USING (k, place)""")
def zip_by_position(spark, sf_dir):
    from ..operators import tags

    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("n"), F.col("o_orderkey").alias("x"))
    right = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("n"), F.col("value").alias("y"))
    return tags.zipped(left, right, "k", "n").select("k", "place", "x", "y")


@query("SELECT count(*) AS n_encoded FROM (SELECT DISTINCT md5(trim(text, ' ')) AS h FROM documents) WHERE h NOT IN (SELECT md5(trim(text, ' ')) FROM documents JOIN embeddings ON doc_id = vec_id)")
def embedding_cache(spark, sf_dir):
    from ..operators import tags

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = d.join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id")).select(F.md5(F.trim("text").cast("binary")).alias("text_hash"), "embedding")
    return tags.cached_vectors(d, cache)[1].agg(F.count("*").alias("n_encoded"))
