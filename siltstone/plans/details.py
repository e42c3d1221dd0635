"""Registered queries: labels, detection rules, thesis angles, comparisons, totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import labels as B
from ..operators import checks, graph, scoring
from ..operators import vector as V
from ..sources.tables import table
from . import evidence as E
from . import fixtures as X

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


RULES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{n}'" for p, n in B.FILE_RULES) + " ELSE 'unknown' END"
NAMES_SQL = "names AS (SELECT doc_id, ['rbi', 'Annual-Report', 'concall', 'blog', 'press', 'other'][CAST(doc_id % 6 + 1 AS INT)] || '_' || CAST(2000 + doc_id % 30 AS VARCHAR) || '.pdf' AS name FROM documents)"


def names(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("rbi", "Annual-Report", "concall", "blog", "press", "other")])
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")), F.lit("_"), (2000 + F.col("doc_id") % 30).cast("string"), F.lit(".pdf")).alias("name"))


@query(f"WITH {NAMES_SQL} SELECT doc_id, {RULES_SQL} AS source_type FROM names")
def tag_source_type(spark, sf_dir):
    return names(spark, sf_dir).select("doc_id", B.first_rule(F.col("name")).alias("source_type"))


@query(f"WITH {NAMES_SQL} SELECT doc_id, {RULES_SQL} AS source_type, 2000 + CAST(doc_id % 30 AS INT) AS year, {X.case_sql(RULES_SQL, X.AUTHORITY, 0.2)} AS weight FROM names")
def filename_metadata(spark, sf_dir):
    kind = B.first_rule(F.col("name"))
    return names(spark, sf_dir).select("doc_id", kind.alias("source_type"), B.file_year(F.col("name")).alias("year"), C.authority(kind).alias("weight"))


@query("SELECT l_orderkey, l_linenumber, printf('%.2f%%', l_discount * 100) AS shown FROM lineitem")
def display_value(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", B.display(F.col("l_discount") * 100, F.lit("%")).alias("shown"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN format('{:.2f}%', l_quantity) WHEN 'N' THEN format('{:.0f} bps', l_quantity * 40) ELSE format('₹{:,.0f} crore', l_extendedprice) END AS shown FROM lineitem""")
def display_units(spark, sf_dir):
    flag = F.col("l_returnflag")
    unit = F.when(flag == "A", "per cent").when(flag == "N", "basis points").otherwise("crore")
    value = F.when(flag == "A", F.col("l_quantity")).when(flag == "N", F.col("l_quantity") * 40).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", B.display(value, unit).alias("shown"))


@query("SELECT user_id, substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS hashed FROM (SELECT DISTINCT user_id FROM events)")
def ip_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16).alias("hashed"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS excerpt FROM documents")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", B.excerpt(F.col("text")).alias("excerpt"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 + 1 >= 8 THEN 'HIGH' WHEN o_orderkey % 10 + 1 >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
CASE WHEN o_orderkey % 10 >= 8 THEN 'Very High' WHEN o_orderkey % 10 >= 6 THEN 'High' WHEN o_orderkey % 10 >= 4 THEN 'Moderate' ELSE 'Low' END AS similarity,
CASE o_orderstatus WHEN 'F' THEN 'Strong' WHEN 'O' THEN 'Medium' ELSE 'Weak' END AS strength FROM orders""")
def computed_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    wording = F.when(F.col("o_orderstatus") == "F", " Robust").when(F.col("o_orderstatus") == "O", "MIXED").otherwise("so so")
    n = F.col("o_orderkey") % 10
    return o.select("o_orderkey", B.risk_flag(n + 1).alias("risk"), B.similarity_label(n / F.lit(10.0)).alias("similarity"), B.strength_of(wording).alias("strength"))


@query()
def short_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", B.short_label(F.col("text")).alias("label"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS ok FROM events")
def json_repair(spark, sf_dir):
    broken = F.concat(F.lit("Sure:\n```json\n"), F.regexp_replace("props", r"\}\s*$", ", \"ok\": True,}"), F.lit("\n```"))
    fixed = F.from_json(B.repaired_json(broken), "k long, ok boolean")
    return table(spark, sf_dir, "events").select("event_id", fixed.alias("j")).select("event_id", "j.k", "j.ok")


@query(f"""WITH {X.VECTORS_SQL}, scored AS ({X.SIMILARITY_SQL}), angles AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE query_id // 20 % 4 <> 3 OR namespace = 'regulatory'),
merged AS (SELECT query_id // 80 AS thesis, vec_id, max(score) AS score FROM angles WHERE r <= 3 GROUP BY ALL) SELECT thesis, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY thesis ORDER BY score DESC, vec_id) AS r FROM merged) WHERE r <= 12""")
def thesis_angles(spark, sf_dir):
    """Four queries in a row are the angles of a thesis, the last of them over the regulatory namespace alone."""
    vectors, asked, last = X.vectors(spark, sf_dir), X.queries(spark, sf_dir), "query_id div 20 % 4 = 3"
    scored = V.similarity(vectors, asked.filter(f"NOT {last}"), k=3).unionByName(V.similarity(vectors.filter("namespace = 'regulatory'"), asked.filter(last), k=3))
    near = V.best(scored, 3).withColumn("thesis", F.expr("query_id div 80"))
    return V.merge_queries(near, 12, by="score", within=("thesis",)).select("thesis", "vec_id", "score")


@query(f"""WITH {E.RISKS_SQL}, m AS (SELECT thesis, round(avg(score), 4) AS plain, CASE WHEN round(avg(score), 4) < 4 THEN 0 WHEN round(avg(score), 4) < 7 THEN 1 ELSE 2 END AS class_order FROM risks GROUP BY thesis)
SELECT thesis, class_order, plain, CAST(row_number() OVER (PARTITION BY thesis % 10 ORDER BY class_order, plain, thesis) AS INT) AS place FROM m""")
def compare_theses(spark, sf_dir):
    ranked = scoring.compare(scoring.strength(E.risks(spark, sf_dir), "thesis"))
    w = Window.partitionBy(F.col("thesis") % 10).orderBy("class_order", "plain", "thesis")
    return ranked.select("thesis", "class_order", "plain", F.row_number().over(w).alias("place"))


@query(f"""WITH {E.ASSUMPTIONS_SQL}, s AS (SELECT thesis, avg(confidence) AS c, sum((critical AND NOT supported)::INT) AS u FROM assumptions GROUP BY thesis)
SELECT thesis, CAST(greatest(1, least(10, round_even(round((1 - c) * 9, 6), 0) + 1 + least(2 * u, 3))) AS INT) AS risk FROM s""")
def heuristic_risk(spark, sf_dir):
    s = E.assumptions(spark, sf_dir).groupBy("thesis").agg(F.avg("confidence").alias("c"), F.sum((F.col("critical") & ~F.col("supported")).cast("int")).alias("u"))
    return s.select("thesis", scoring.heuristic_risk(F.col("c"), F.col("u")).alias("risk"))


@query(f"""WITH {E.UNITS_SQL}, named AS (SELECT CASE WHEN entity IN ('Brand#11', 'Brand#12') THEN 'nim' ELSE 'gnpa' END AS metric, entity, period, unit, value FROM units)
SELECT metric, entity, period, unit, value, 'PERCENT_AS_ABSOLUTE' AS code FROM named WHERE unit <> '%' AND value > 10 * CASE metric WHEN 'nim' THEN 15.0 ELSE 50.0 END""")
def percent_as_absolute(spark, sf_dir):
    named = E.unit_claims(spark, sf_dir).withColumn("metric", F.when(F.col("entity").isin("Brand#11", "Brand#12"), "nim").otherwise("gnpa"))
    return checks.percent_as_absolute(named)


@query(f"""WITH {E.RECORDS_SQL}, found AS (SELECT 'IMPOSSIBLE_VALUE' AS code FROM records WHERE nim < 0 UNION ALL SELECT 'IMPOSSIBLE_VALUE' FROM records WHERE crar < 0 UNION ALL SELECT 'IMPOSSIBLE_VALUE' FROM records WHERE pe < 0
UNION ALL SELECT 'OUT_OF_RANGE' FROM records WHERE nim > 15 UNION ALL SELECT 'OUT_OF_RANGE' FROM records WHERE roe > 100 UNION ALL SELECT 'OUT_OF_RANGE' FROM records WHERE gnpa > 50 UNION ALL SELECT 'OUT_OF_RANGE' FROM records WHERE pcr NOT BETWEEN 0 AND 100
UNION ALL SELECT 'OUT_OF_RANGE' FROM records WHERE casa NOT BETWEEN 0 AND 100 UNION ALL SELECT 'OUT_OF_RANGE' FROM records WHERE crar > 60 UNION ALL SELECT 'OUT_OF_RANGE' FROM records WHERE pe > 1000 UNION ALL SELECT 'GNPA_BELOW_NNPA' FROM records WHERE nnpa > gnpa
UNION ALL SELECT 'RATIO_INCONSISTENCY' FROM records WHERE abs(roe - pat * 100 / equity) / abs(pat * 100 / equity) > 0.15
UNION ALL SELECT 'OUTLIER' FROM (WITH med AS (SELECT median(assets) AS med FROM records), dev AS (SELECT abs(assets - med) AS dev FROM records, med), mad AS (SELECT median(dev) AS mad FROM dev) SELECT 1 FROM dev, mad WHERE round(0.6745 * dev / mad, 4) > 3.5))
SELECT code, count(*) AS n FROM found GROUP BY code""")
def validation_report(spark, sf_dir):
    """Rules and outliers together, by code."""
    records = E.records(spark, sf_dir)
    odd = checks.outliers(records.withColumn("g", F.lit(1)), "g", "assets").select(F.lit("OUTLIER").alias("code"))
    return checks.ratio_rules(records).select("code").unionByName(odd).groupBy("code").agg(F.count("*").alias("n"))


@query(r"""WITH sub AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 2)) AS tokens FROM conversations WHERE role = 'user'),
chunk AS (SELECT conv_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 2)) AS words FROM conversations WHERE role = 'assistant')
SELECT s.conv_id AS query_id, s.turn AS subquery_id, bool_or(coalesce(len(list_intersect(tokens, words)) >= greatest(1, len(tokens) // 2), false)) AS covered FROM sub s LEFT JOIN chunk c USING (conv_id) GROUP BY ALL""")
def coverage_gaps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    subs = c.filter("role = 'user'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("subquery_id"), C.words(F.col("text")).alias("tokens"))
    chunks = c.filter("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.lit(1.0).alias("score"), C.words(F.col("text")).alias("words"))
    return scoring.coverage(subs, chunks)


@query("""WITH n AS (SELECT n_regionkey AS graph, n_nationkey AS node, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS INT) AS number FROM nation),
a AS (SELECT x.graph, x.node AS src, y.node AS dst FROM n x JOIN n y ON x.graph = y.graph AND x.node < y.node) SELECT a.graph, s.number AS src_number, d.number AS dst_number FROM a JOIN n s ON a.src = s.node JOIN n d ON a.dst = d.node""")
def graph_renumber(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph"), F.col("n_nationkey").alias("node"), "n_name")
    arcs = n.select("graph", F.col("node").alias("src")).join(n.select("graph", F.col("node").alias("dst")), "graph").filter("src < dst")
    return graph.renumber(n, arcs, ["n_name"])[1]


SEEDS = (("a", ("the", "and", "with"), 0.8), ("b", ("der", "und", "nicht"), 0.75), ("c", ("le", "les", "pour"), 0.73))


@query(r"""WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS ws FROM documents), s AS (SELECT unnest(['a', 'b', 'c']) AS seed, unnest([['the', 'and', 'with'], ['der', 'und', 'nicht'], ['le', 'les', 'pour']]) AS ks, unnest([0.8::DOUBLE, 0.75, 0.73]) AS base)
SELECT doc_id, seed, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seed) AS nth FROM (SELECT doc_id, seed, round(base * (0.4 + 0.6 * len(list_intersect(ks, ws)) / 3.0::DOUBLE), 6) AS score FROM w, s WHERE len(list_intersect(ks, ws)) > 0)) WHERE nth <= 2 AND score >= 0.3""")
def analog_match(spark, sf_dir):
    """Seed analogs by the share of their keywords in a text; the seeds are a stated few, kept as literals."""
    words = C.words(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("ws"))
    share = lambda ks: F.size(F.array_intersect(F.array(*[F.lit(k) for k in ks]), F.col("ws"))) / F.lit(float(len(ks)))
    each = F.array(*[F.struct(F.lit(n).alias("seed"), share(ks).alias("share"), F.round(base * (0.4 + 0.6 * share(ks)), 6).alias("score")) for n, ks, base in SEEDS])
    rows = d.select("doc_id", F.explode(each).alias("m")).select("doc_id", "m.*").filter("share > 0 AND score >= 0.3")
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "seed")
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth <= 2").select("doc_id", "seed", "score")


@query("SELECT lang, count(*) AS n_documents, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 4) AS avg_chars, CAST(max(length(text)) AS INT) AS longest FROM documents GROUP BY lang")
def ingestion_totals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("n", F.length("text"))
    return d.groupBy("lang").agg(F.count("*").alias("n_documents"), F.sum("n").alias("chars"), F.round(F.avg("n"), 4).alias("avg_chars"), F.max("n").alias("longest"))


@query("SELECT event_type, approx_count_distinct(user_id) > 0 AS seen, count(DISTINCT user_id) AS exact FROM events GROUP BY event_type")
def distinct_users(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg((F.approx_count_distinct("user_id") > 0).alias("seen"), F.count_distinct("user_id").alias("exact"))
