"""Registered queries: claims, checks, scoring, graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicon
from ..operators import checks as K
from ..operators import claims as M
from ..operators import cycles as Y
from ..operators import graph as G
from ..operators import scoring as S
from ..sources.tables import table
from . import fixtures as X

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def claims(spark, sf_dir):
    """Line items as claims: the unit price of a part in a quarter, as a supplier states it."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"),
        F.lit("unit_price").alias("metric"),
        F.col("l_partkey").cast("string").alias("entity"),
        F.concat(F.lit("Q"), F.quarter("l_shipdate").cast("string"), F.lit(" FY"), F.year("l_shipdate").cast("string")).alias("period"),
        F.col("l_suppkey").cast("string").alias("source"),
        X.source_type_of(F.col("l_suppkey")).alias("source_type"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"),
        F.to_date("l_shipdate").alias("day"),
        F.lit(False).alias("is_ratio"),
    )


CLAIMS_SQL = f"""claims AS (
  SELECT l_orderkey * 10 + l_linenumber AS claim_id, 'UNIT_PRICE' AS metric, CAST(l_partkey AS VARCHAR) AS entity,
    'q' || quarter(l_shipdate) || ' fy' || right(CAST(year(l_shipdate) AS VARCHAR), 2) AS period, CAST(l_suppkey AS VARCHAR) AS source,
    {X.TYPES_SQL}[CAST(l_suppkey % 10 + 1 AS INT)] AS source_type, l_extendedprice / l_quantity AS value, CAST(l_shipdate AS DATE) AS day FROM lineitem
), latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric, entity, period, source ORDER BY day DESC, claim_id) AS nth FROM claims) WHERE nth = 1
), pairs AS (
  SELECT a.metric, a.entity, a.period, a.claim_id AS claim_id_a, b.claim_id AS claim_id_b, a.value AS value_a, b.value AS value_b, a.day AS day_a, b.day AS day_b,
    a.source_type AS source_type_a, b.source_type AS source_type_b, abs(a.value - b.value) AS diff, abs((a.value + b.value) / 2) AS base
  FROM latest a JOIN latest b ON a.metric = b.metric AND a.entity = b.entity AND a.period = b.period AND a.claim_id < b.claim_id AND a.source <> b.source
), compared AS (
  SELECT *, CASE WHEN base = 0 THEN 0.0 ELSE diff / base * 100 END AS pct FROM pairs
), conflicts AS (
  SELECT *, CASE WHEN pct < 5 THEN 'Minor' WHEN pct < 20 THEN 'Moderate' ELSE 'Major' END AS severity, round(diff, 8) AS abs_diff, round(pct, 2) AS pct_diff FROM compared
)"""


@query(f"WITH {CLAIMS_SQL} SELECT metric, entity, period, source, claim_id, day FROM latest")
def latest_per_source(spark, sf_dir):
    return M.latest_per_source(M.keyed(claims(spark, sf_dir))).select("metric", "entity", "period", "source", "claim_id", "day")


@query(f"WITH {CLAIMS_SQL} SELECT metric, entity, period, count(DISTINCT source) AS n_sources, count(*) AS n_claims FROM claims GROUP BY ALL HAVING count(DISTINCT source) >= 3")
def distinct_source_gate(spark, sf_dir):
    return M.groups_with_sources(M.keyed(claims(spark, sf_dir)), 3)


@query(f"WITH {CLAIMS_SQL} SELECT metric, entity, period, claim_id_a, claim_id_b, abs_diff, pct_diff, severity FROM conflicts")
def claim_pairs(spark, sf_dir):
    paired = M.compared(M.pairs(M.latest_per_source(M.keyed(claims(spark, sf_dir)))), digits=8)
    return paired.select("metric", "entity", "period", "claim_id_a", "claim_id_b", "abs_diff", "pct_diff", "severity")


@query(f"WITH {CLAIMS_SQL} SELECT severity, count(*) AS n, round(avg(pct), 4) AS avg_pct FROM conflicts WHERE pct > 5 GROUP BY severity")
def conflict_severity(spark, sf_dir):
    found = M.compared(M.pairs(M.latest_per_source(M.keyed(claims(spark, sf_dir))))).filter("is_conflict")
    exact = F.abs(F.col("value_a") - F.col("value_b")) / F.abs((F.col("value_a") + F.col("value_b")) / 2) * 100
    return found.groupBy("severity").agg(F.count("*").alias("n"), F.round(F.avg(exact), 4).alias("avg_pct"))


FACTOR_SQL = {s: X.case_sql(f"source_type_{s}", X.AUTHORITY_FACTOR, 0.7) for s in "ab"}


@query(f"""WITH {CLAIMS_SQL}, judged AS (
  SELECT *, CASE WHEN day_a > day_b THEN 'A' WHEN day_b > day_a THEN 'B' END AS d, CASE WHEN {FACTOR_SQL['a']} > {FACTOR_SQL['b']} THEN 'A' WHEN {FACTOR_SQL['b']} > {FACTOR_SQL['a']} THEN 'B' END AS w
  FROM conflicts WHERE pct > 5)
SELECT claim_id_a, claim_id_b, coalesce(d, w, 'UNRESOLVED') AS winner, concat_ws('; ', CASE WHEN d IS NOT NULL THEN 'newer: ' || d END, CASE WHEN w IS NOT NULL THEN 'authority: ' || w END,
  CASE WHEN d <> w THEN 'date goes before authority' END, CASE WHEN d IS NULL AND w IS NULL THEN 'equal; verify by hand' END) AS reason FROM judged""")
def conflict_resolution(spark, sf_dir):
    found = M.compared(M.pairs(M.latest_per_source(M.keyed(claims(spark, sf_dir))))).filter("is_conflict")
    return M.resolved(found).select("claim_id_a", "claim_id_b", "winner", "reason")


@query(f"""WITH {CLAIMS_SQL} SELECT entity, period, claim_id_a, claim_id_b, severity, pct_diff FROM conflicts WHERE pct > 5 AND (SELECT count(DISTINCT source) FROM claims) >= 3
ORDER BY CASE severity WHEN 'Major' THEN 0 WHEN 'Moderate' THEN 1 ELSE 2 END, pct_diff DESC, metric, entity, period, claim_id_a, claim_id_b LIMIT 8""")
def conflict_report(spark, sf_dir):
    return M.conflicts(claims(spark, sf_dir)).select("entity", "period", "claim_id_a", "claim_id_b", "severity", "pct_diff")


@query("""WITH med AS (SELECT event_type, median(value) AS med, count(value) AS n FROM events GROUP BY event_type),
away AS (SELECT e.*, med, abs(value - med) AS dev FROM events e JOIN med USING (event_type) WHERE n >= 4),
spread AS (SELECT event_type, median(dev) AS mad, avg(dev) AS mean_dev FROM away GROUP BY event_type)
SELECT * FROM (SELECT event_id, event_type, round(CASE WHEN mad > 0 THEN 0.6745 * dev / mad WHEN mean_dev > 0 THEN dev * 0.7979 / mean_dev END, 4) AS z FROM away JOIN spread USING (event_type)) WHERE z > 3.5""")
def mad_outliers(spark, sf_dir):
    return K.outliers(table(spark, sf_dir, "events"), "event_type", "value").select("event_id", "event_type", "z")


def records(spark, sf_dir):
    """Orders as financial records: ratios in percent from their line items."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(
        F.sum("l_extendedprice").cast("decimal(18,2)").cast("double").alias("assets"), F.sum("l_quantity").alias("equity"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t")
    )
    return li.select(
        "record_id", "assets", "equity", (F.col("d") * 200).alias("nim"), (F.col("d") * 100).alias("gnpa"), (F.col("t") * 100).alias("nnpa"), (F.col("equity") * 3).alias("pat"), (F.col("d") * 2500).alias("roe"),
        (F.col("record_id") % 130 - 10).cast("double").alias("pcr"), (F.col("record_id") % 125 - 5).cast("double").alias("casa"), (F.col("record_id") % 80 - 10).cast("double").alias("crar"), (F.col("record_id") % 1300 - 100).cast("double").alias("pe"),
    )


RECORDS_SQL = """records AS (SELECT record_id, assets, equity, d * 200 AS nim, d * 100 AS gnpa, t * 100 AS nnpa, equity * 3 AS pat, d * 2500 AS roe, (record_id % 130 - 10)::DOUBLE AS pcr, (record_id % 125 - 5)::DOUBLE AS casa, (record_id % 80 - 10)::DOUBLE AS crar, (record_id % 1300 - 100)::DOUBLE AS pe FROM (
  SELECT l_orderkey AS record_id, CAST(CAST(sum(l_extendedprice) AS DECIMAL(18,2)) AS DOUBLE) AS assets, sum(l_quantity) AS equity, max(l_discount) AS d, max(l_tax) AS t FROM lineitem GROUP BY 1))"""


@query(f"""WITH {RECORDS_SQL}
SELECT record_id, 'IMPOSSIBLE_VALUE' AS code, 'critical' AS level, 'nim' AS metric, 'nim outside 0 to 15' AS message FROM records WHERE nim < 0
UNION ALL SELECT record_id, 'OUT_OF_RANGE', 'warning', 'nim', 'nim outside 0 to 15' FROM records WHERE nim > 15
UNION ALL SELECT record_id, 'OUT_OF_RANGE', 'warning', 'roe', 'roe outside -100 to 100' FROM records WHERE roe < -100 OR roe > 100
UNION ALL SELECT record_id, 'OUT_OF_RANGE', 'warning', 'gnpa', 'gnpa outside 0 to 50' FROM records WHERE gnpa > 50
UNION ALL SELECT record_id, 'OUT_OF_RANGE', 'critical', 'pcr', 'pcr outside 0 to 100' FROM records WHERE pcr < 0 OR pcr > 100
UNION ALL SELECT record_id, 'OUT_OF_RANGE', 'critical', 'casa', 'casa outside 0 to 100' FROM records WHERE casa < 0 OR casa > 100
UNION ALL SELECT record_id, 'IMPOSSIBLE_VALUE', 'critical', 'crar', 'crar outside 0 to 60' FROM records WHERE crar < 0
UNION ALL SELECT record_id, 'OUT_OF_RANGE', 'warning', 'crar', 'crar outside 0 to 60' FROM records WHERE crar > 60
UNION ALL SELECT record_id, 'IMPOSSIBLE_VALUE', 'warning', 'pe', 'pe outside 0 to 1000' FROM records WHERE pe < 0
UNION ALL SELECT record_id, 'OUT_OF_RANGE', 'info', 'pe', 'pe outside 0 to 1000' FROM records WHERE pe > 1000
UNION ALL SELECT record_id, 'GNPA_BELOW_NNPA', 'critical', 'gnpa', 'net exceeds gross' FROM records WHERE nnpa > gnpa
UNION ALL SELECT record_id, 'RATIO_INCONSISTENCY', 'warning', 'roe', 'roe is not pat over equity' FROM records WHERE abs(roe - pat * 100 / equity) / abs(pat * 100 / equity) > 0.15""")
def ratio_rules(spark, sf_dir):
    return K.ratio_rules(records(spark, sf_dir))


def unit_claims(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        F.lit("price").alias("metric"), F.col("p_brand").alias("entity"), F.col("p_size").cast("string").alias("period"),
        F.element_at(F.array(F.lit("crore"), F.lit("lakh"), F.lit("bn"), F.lit("%")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("unit"), F.col("p_retailprice").alias("value"),
    )


UNITS_SQL = "units AS (SELECT 'price' AS metric, p_brand AS entity, CAST(p_size AS VARCHAR) AS period, ['crore', 'lakh', 'bn', '%'][CAST(p_partkey % 4 + 1 AS INT)] AS unit, p_retailprice AS value FROM part)"


@query(f"""WITH {UNITS_SQL}, scaled AS (SELECT *, CASE unit WHEN 'crore' THEN 1.0::DOUBLE WHEN 'lakh' THEN 0.01::DOUBLE WHEN 'bn' THEN 100.0::DOUBLE END AS scale FROM units WHERE unit <> '%' AND value <> 0)
SELECT metric, entity, period, unit_a, unit_b, value_a, value_b, ratio, count(*) AS n_pairs FROM (SELECT a.metric, a.entity, a.period, a.unit AS unit_a, b.unit AS unit_b, a.value AS value_a, b.value AS value_b, round(a.value * a.scale / (b.value * b.scale), 6) AS ratio
FROM scaled a JOIN scaled b ON a.metric = b.metric AND a.entity = b.entity AND a.period = b.period AND a.unit < b.unit) WHERE ratio >= 100 OR ratio <= 0.01 GROUP BY ALL""")
def unit_mismatch(spark, sf_dir):
    return K.unit_mismatch(unit_claims(spark, sf_dir)).select("metric", "entity", "period", "unit_a", "unit_b", "value_a", "value_b", "ratio", "n_pairs")


RISKS_SQL = """risks AS (SELECT o_custkey AS thesis, ['demand','margin','valuation','regulatory','macro','competitive'][CAST(o_orderkey % 6 + 1 AS INT)] AS dimension, CAST(1 + o_orderkey % 10 AS INT) AS score FROM orders)"""


def risks(spark, sf_dir):
    dims = F.array(*[F.lit(d) for d in lexicon.RISK_WEIGHTS])
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("thesis"), F.element_at(dims, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("dimension"), (1 + F.col("o_orderkey") % 10).cast("int").alias("score")
    )


ASSUMPTIONS_SQL = """assumptions AS (SELECT o_custkey AS thesis, o_orderkey AS node, (o_orderkey % 7) / 7.0::DOUBLE AS confidence, o_orderkey % 3 <> 0 AS supported, o_orderpriority = '1-URGENT' AS critical FROM orders)"""


def assumptions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("thesis"), F.col("o_orderkey").alias("node"), (F.col("o_orderkey") % 7 / F.lit(7.0)).alias("confidence"), (F.col("o_orderkey") % 3 != 0).alias("supported"), (F.col("o_orderpriority") == "1-URGENT").alias("critical"),
    )


@query(f"""WITH {RISKS_SQL}, means AS (SELECT thesis, round(sum(score * w) / sum(w), 4) AS weighted, round(avg(score), 4) AS plain FROM (SELECT *, {X.case_sql('dimension', X.RISK_WEIGHTS, 1.0)} AS w FROM risks) GROUP BY thesis)
SELECT *, CASE WHEN weighted < 4 THEN 'Strong' WHEN weighted <= 7 THEN 'Medium' ELSE 'Weak' END AS weighted_strength, CASE WHEN plain < 4 THEN 'Strong' WHEN plain < 7 THEN 'Medium' ELSE 'Weak' END AS strength FROM means""")
def weighted_strength(spark, sf_dir):
    return S.strength(risks(spark, sf_dir), "thesis")


@query(f"""WITH {RISKS_SQL}, {ASSUMPTIONS_SQL}, s AS (SELECT thesis, avg(supported::INT) AS rate, sum((critical AND NOT supported)::INT)::BIGINT AS critical_unsupported FROM assumptions GROUP BY thesis), r AS (SELECT thesis, avg(score) AS avg_risk FROM risks GROUP BY thesis)
SELECT thesis, critical_unsupported, CASE WHEN rate < 0.3 OR avg_risk > 7 OR critical_unsupported >= 2 THEN 'Low' WHEN rate >= 0.7 AND avg_risk < 5 AND critical_unsupported = 0 THEN 'High' ELSE 'Medium' END AS confidence FROM s JOIN r USING (thesis)""")
def thesis_confidence(spark, sf_dir):
    return S.thesis_confidence(assumptions(spark, sf_dir), risks(spark, sf_dir), "thesis").select("thesis", "critical_unsupported", "confidence")


@query(f"""WITH {ASSUMPTIONS_SQL}, s AS (SELECT thesis, round(avg(confidence), 4) AS avg_confidence, sum((critical AND NOT supported)::INT)::BIGINT AS critical_unsupported, bool_or(node % 97 = 0) AS cyclic FROM assumptions GROUP BY thesis)
SELECT *, CASE WHEN cyclic OR critical_unsupported >= 2 OR avg_confidence < 0.4 THEN 'Low' WHEN avg_confidence >= 0.65 AND critical_unsupported = 0 THEN 'High' ELSE 'Medium' END AS robustness FROM s""")
def robustness(spark, sf_dir):
    return S.robustness(assumptions(spark, sf_dir), "thesis", F.col("node") % 97 == 0)


@query(f"""WITH {ASSUMPTIONS_SQL} SELECT node, CAST(greatest(1, least(10, round_even((1 - confidence) * 9, 0) + 1 + CASE WHEN supported THEN 0 ELSE 2 END)) AS INT) AS risk FROM assumptions""")
def node_risk(spark, sf_dir):
    return assumptions(spark, sf_dir).select("node", G.node_risk(F.col("confidence"), F.col("supported")).alias("risk"))


def chunks(spark, sf_dir):
    """Documents as retrieved chunks of 50 queries, with a score."""
    d = X.documents(spark, sf_dir)
    return d.select((F.col("doc_id") % 50).alias("query_id"), "doc_id", "source", "source_type", ((F.col("doc_id") * 37 % 100) / F.lit(100.0)).alias("final_score"), "text")


CHUNKS_SQL = f"{X.DOCUMENTS_SQL}, chunks AS (SELECT doc_id % 50 AS query_id, doc_id, source, source_type, (doc_id * 37 % 100) / 100.0::DOUBLE AS final_score, text FROM docs)"


@query(f"""WITH {CHUNKS_SQL}, s AS (SELECT query_id, count(*) AS n, round(avg(final_score), 6) AS avg_score, sum(({X.case_sql('source_type', X.AUTHORITY, 0.2)} >= 0.65)::INT)::BIGINT AS n_authority FROM chunks GROUP BY query_id)
SELECT *, CASE WHEN n < 2 OR avg_score < 0.35 THEN 'Low' WHEN n >= 4 AND avg_score >= 0.6 AND n_authority >= 2 THEN 'High' ELSE 'Medium' END AS confidence FROM s""")
def answer_confidence(spark, sf_dir):
    return S.answer_confidence(chunks(spark, sf_dir), "query_id").withColumn("avg_score", F.round("avg_score", 6))


@query(f"WITH {CHUNKS_SQL} SELECT query_id, source_type, source, doc_id, final_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_type, source ORDER BY final_score DESC, doc_id) AS nth FROM chunks) WHERE nth = 1")
def citation_max_per_source(spark, sf_dir):
    return S.max_per_source(chunks(spark, sf_dir), ["query_id", "source_type", "source"], "final_score", "doc_id").select("query_id", "source_type", "source", "doc_id", "final_score")


@query(f"""WITH {CHUNKS_SQL}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, doc_id) AS INT) AS rank FROM chunks),
sums AS (SELECT query_id, doc_id, rank, CAST(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars_so_far FROM ranked) SELECT * FROM sums WHERE chars_so_far <= 6000""")
def context_budget(spark, sf_dir):
    w = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "doc_id")
    ranked = chunks(spark, sf_dir).withColumn("rank", F.row_number().over(w))
    return S.context_budget(ranked, 6000, "query_id").select("query_id", "doc_id", "rank", "chars_so_far")


def _terms(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("assumption_id"), F.slice(C.words(F.col("text")), 1, 4).alias("terms"))


WORDS_SQL = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 2))"
FIRST_SQL = r"(SELECT list(w ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS p) WHERE length(w) >= 2 GROUP BY w ORDER BY p LIMIT 4))"


@query(f"""WITH {CHUNKS_SQL}, a AS (SELECT item_id, ws FROM (SELECT item_id, regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+') AS ws FROM benchmark)),
flat AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM a), firsts AS (SELECT item_id, w, min(p) AS p FROM flat WHERE length(w) >= 2 GROUP BY ALL),
terms AS (SELECT item_id, list(w) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p) AS nth FROM firsts) WHERE nth <= 4 GROUP BY item_id),
c AS (SELECT {WORDS_SQL.format(c='text')} AS words, {X.case_sql('source_type', X.AUTHORITY, 0.2)} AS weight FROM chunks WHERE final_score >= 0.35),
hits AS (SELECT item_id, sum(len(list_intersect(terms, words)) * weight) AS hit FROM terms, c GROUP BY item_id)
SELECT item_id AS assumption_id, round(hit / ((SELECT sum(weight) FROM c) * len(terms)), 6) AS support, hit / ((SELECT sum(weight) FROM c) * len(terms)) >= 0.25 AS supported FROM terms JOIN hits USING (item_id)""")
def support_score(spark, sf_dir):
    found = chunks(spark, sf_dir).select(C.words(F.col("text")).alias("words"), "source_type", F.col("final_score").alias("score"))
    return S.support(_terms(spark, sf_dir), found)


ARCS_SQL = """nodes AS (SELECT n_nationkey AS node, [CAST(n_nationkey // 2 AS INT), CAST(n_nationkey // 3 AS INT), 99] AS deps FROM nation),
arcs AS (SELECT DISTINCT d AS src, node AS dst FROM (SELECT node, unnest(deps) AS d FROM nodes) WHERE d <> node AND d IN (SELECT node FROM nodes))"""


def graph_nodes(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("node"), F.array(F.floor(n / 2).cast("int"), F.floor(n / 3).cast("int"), F.lit(99)).alias("depends_on"))


@query(f"WITH {ARCS_SQL} SELECT src, dst FROM arcs")
def graph_edges(spark, sf_dir):
    return G.edges(graph_nodes(spark, sf_dir))


@query(f"WITH RECURSIVE {ARCS_SQL}, walk AS (SELECT node, 0 AS n FROM nodes WHERE node NOT IN (SELECT dst FROM arcs) UNION ALL SELECT a.dst, w.n + 1 FROM walk w JOIN arcs a ON w.node = a.src) SELECT node, max(n)::INT AS level FROM walk GROUP BY node")
def topo_level(spark, sf_dir):
    nodes = graph_nodes(spark, sf_dir)
    return G.levels(nodes, G.edges(nodes))


@query(f"""WITH RECURSIVE {ARCS_SQL}, walk AS (SELECT node, CAST(node AS VARCHAR) AS path, 1 AS n FROM nodes WHERE node NOT IN (SELECT dst FROM arcs) AND node IN (SELECT src FROM arcs)
UNION ALL SELECT a.dst, w.path || '>' || a.dst, w.n + 1 FROM walk w JOIN arcs a ON w.node = a.src) SELECT node, n::INT AS n_nodes, path FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, path) AS nth FROM walk) WHERE nth = 1""")
def critical_path(spark, sf_dir):
    nodes = graph_nodes(spark, sf_dir)
    return G.critical_path(nodes, G.edges(nodes))


@query("""WITH RECURSIVE arcs AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation WHERE (n_nationkey * 7 + 3) % 25 <> n_nationkey),
walk AS (SELECT src AS start, dst AS here, 1 AS steps FROM arcs UNION ALL SELECT w.start, a.dst, w.steps + 1 FROM walk w JOIN arcs a ON w.here = a.src WHERE w.steps <= 25 AND w.start <> w.here)
SELECT start AS node, min(steps)::INT AS cycle_length FROM walk WHERE start = here GROUP BY start""")
def cycle_nodes(spark, sf_dir):
    n = F.col("n_nationkey")
    nodes = table(spark, sf_dir, "nation").select(((n * 7 + 3) % 25).cast("int").alias("node"), F.array(n).alias("depends_on"))
    return G.cycles(G.edges(nodes))


#: A map of the customers onto each other: every component has one ring, with trees that lead into it.
RING_SQL = """arcs AS (SELECT c_custkey AS src, (c_custkey * c_custkey + 7 * c_nationkey + 3) % (SELECT count(*) FROM customer) AS dst FROM customer), proper AS (SELECT * FROM arcs WHERE src <> dst)"""


@query(f"""WITH RECURSIVE {RING_SQL},
reach AS (SELECT src AS start, dst AS here FROM proper UNION SELECT r.start, a.dst FROM reach r JOIN proper a ON r.here = a.src),
rings AS (SELECT start AS node, min(here) AS component, count(*) AS n FROM reach WHERE start IN (SELECT start FROM reach WHERE start = here) GROUP BY start),
walk AS (SELECT component, component AS node, CAST(0 AS BIGINT) AS position, n FROM rings WHERE node = component
  UNION ALL SELECT w.component, a.dst, w.position + 1, w.n FROM walk w JOIN proper a ON w.node = a.src WHERE w.position + 1 < w.n)
SELECT component, position, node, CAST(n AS INTEGER) AS cycle_length FROM walk""")
def cycle_paths(spark, sf_dir):
    """Each ring of the customers' map, from its smallest member on."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = customers.count()
    arcs = customers.select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * F.col("c_custkey") + 7 * F.col("c_nationkey") + 3) % n).alias("dst"))
    arcs = arcs.join(customers.select(F.col("c_custkey").alias("dst")), "dst", "left_semi")
    paths = Y.shortest(arcs, Y.components(arcs))
    return paths.join(paths.groupBy("component").agg(F.count("*").cast("int").alias("cycle_length")), "component").select("component", "position", "node", "cycle_length")


LINES_SQL = """stated AS (SELECT l_orderkey AS graph, CAST(l_linenumber AS BIGINT) AS node, unnest([1 + l_partkey % 9, 1 + l_suppkey % 9, 1 + (l_partkey + l_suppkey) % 2]) AS d FROM lineitem),
lines AS (SELECT DISTINCT graph, node FROM stated),
arcs AS (SELECT DISTINCT a.graph, a.d AS src, a.node AS dst FROM stated a JOIN lines b ON a.graph = b.graph AND a.d = b.node WHERE a.d <> a.node)"""


@query(f"""WITH RECURSIVE {LINES_SQL},
walk AS (SELECT graph, node, 0 AS level FROM lines WHERE (graph, node) NOT IN (SELECT graph, dst FROM arcs)
  UNION SELECT w.graph, a.dst, w.level + 1 FROM walk w JOIN arcs a ON w.graph = a.graph AND w.node = a.src WHERE w.level < 8),
behind AS (SELECT graph, src AS start, dst AS here FROM arcs UNION SELECT w.graph, w.start, a.dst FROM behind w JOIN arcs a ON w.graph = a.graph AND w.here = a.src),
bad AS (SELECT graph, start AS node FROM behind WHERE start = here UNION SELECT w.graph, w.here FROM behind w JOIN behind c ON c.graph = w.graph AND c.start = c.here AND c.start = w.start),
levels AS (SELECT graph, node, max(level) AS level FROM walk WHERE (graph, node) NOT IN (SELECT graph, node FROM bad) GROUP BY ALL),
chain AS (SELECT graph, node, level, CAST(node AS VARCHAR) AS k FROM levels WHERE level = 0
  UNION ALL SELECT l.graph, l.node, l.level, c.k || l.node FROM chain c JOIN arcs a ON a.graph = c.graph AND a.src = c.node JOIN levels l ON l.graph = a.graph AND l.node = a.dst AND l.level = c.level + 1),
keyed AS (SELECT graph, node, level, max(k) AS k FROM chain GROUP BY ALL)
SELECT graph, node, row_number() OVER (PARTITION BY graph ORDER BY level NULLS LAST, k, node) - 1 AS place, level IS NOT NULL AS ordered
FROM lines LEFT JOIN keyed USING (graph, node)""")
def kahn_order(spark, sf_dir):
    """The lines of each order as a graph: which line leaves the queue when."""
    li = table(spark, sf_dir, "lineitem")
    deps = F.array(1 + F.col("l_partkey") % 9, 1 + F.col("l_suppkey") % 9, 1 + (F.col("l_partkey") + F.col("l_suppkey")) % 2)
    lines = li.select(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").cast("long").alias("node"), deps.alias("deps"))
    arcs = lines.select("graph", F.explode("deps").alias("src"), F.col("node").alias("dst"))
    return G.kahn(lines, arcs)
