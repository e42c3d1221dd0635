"""Registered queries: cleaning, deduplication, validation, chunking, tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicon
from ..operators import chunking, tagging
from ..operators import text as T
from ..session import spread_few
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


def _clean_sql(column: str) -> str:
    """The same replacements for DuckDB, whose patterns need no look-around here."""
    quote = lambda s: s.replace("'", "''")
    t = rf"regexp_replace({column}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', ' ', 'g')"
    t = f"translate({t}, '–—‘’“”• ', '--''''\"\"- ')"
    t = rf"regexp_replace({t}, '([\p{{L}}\p{{N}}_]+)-\n([\p{{L}}\p{{N}}_]+)', '\1\2', 'g')"
    for p in lexicon.BOILERPLATE:
        t = f"regexp_replace({t}, '(?im){quote(p)}', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?m)^\s*\d{{1,4}}\s*$', '', 'g')"
    t = rf"regexp_replace({t}, '(?i)\bpage\s+\d+\s*(?:of\s+\d+)?\b', '', 'g')"
    t = f"regexp_replace({t}, '[•◦▪▫►◄→←↑↓]', ' ', 'g')"
    for mark, least in (("_", 3), ("-", 3), ("=", 3), ("*", 2)):
        t = f"regexp_replace({t}, '[{mark}]{{{least},}}', ' ', 'g')"
    t = rf"regexp_replace({t}, '\b([A-Z])\s([A-Z])\s([A-Z])\s([A-Z])\b', '\1\2\3\4', 'g')"
    t = rf"regexp_replace({t}, '\b([A-Z])\s([A-Z])\s([A-Z])\b', '\1\2\3', 'g')"
    for p, by in ((r"[ \t]+", " "), (r"\n{3,}", r"\n\n"), (r" \n", r"\n"), (r"\n ", r"\n")):
        by = "' '" if by == " " else "chr(10) || chr(10)" if by == r"\n\n" else "chr(10)"
        t = f"regexp_replace({t}, '{p}', {by}, 'g')"
    lines = f"list_filter(string_split({t}, chr(10)), lambda l: trim(l) = '' OR length(trim(l)) >= 3 OR regexp_matches(trim(l), '^\\d'))"
    joined = f"array_to_string(list_transform({lines}, lambda l: CASE WHEN trim(l) = '' THEN '' ELSE l END), chr(10))"
    return rf"regexp_replace(regexp_replace({joined}, '^\s+|\s+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, md5(t) AS clean_hash, length(t)::INT AS n_chars FROM (SELECT doc_id, {_clean_sql('text')} AS t FROM documents)")
def clean_text(spark, sf_dir):
    documents = spread_few(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = documents.select("doc_id", T.cleaned(F.col("text")).alias("t"))
    return rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("clean_hash"), F.length("t").alias("n_chars"))


@query(r"""SELECT page_id, md5(t) AS text_hash, length(t)::INT AS n_chars FROM (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(
regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&#\d+;', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM pages)""")
def html_strip(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", T.tags_stripped(F.col("html")).alias("t"))
    return rows.select("page_id", F.md5(F.col("t").cast("binary")).alias("text_hash"), F.length("t").alias("n_chars"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.token_estimate(F.col("text")).alias("tokens"))


@query(r"SELECT conv_id, turn, 'query:' || md5(concat_ws('|', trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')), role)) AS key FROM conversations")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.cache_key("query", F.col("text"), F.col("role")).alias("key"))


@query("SELECT page_id, substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), 1, 60) AS slug, 'doc_' || substr(md5(url), 1, 16) AS doc_key FROM pages")
def slug_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.slug(F.col("url")).alias("slug"), F.concat(F.lit("doc_"), F.substring(F.md5("url"), 1, 16)).alias("doc_key"))


def pages_of(spark, sf_dir):
    """Every line of a document as one of its pages."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\n")).alias("page", "text"))


PAGES_SQL = "pages_ AS (SELECT doc_id AS document, generate_subscripts(ls, 1)::INT - 1 AS page, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
LINES_SQL = f"""{PAGES_SQL}, lines AS (SELECT DISTINCT document, page, trim(unnest(string_split(text, chr(10)))) AS line FROM pages_),
repeated AS (SELECT document, line, count(*) AS n_pages FROM lines WHERE length(line) >= 5 GROUP BY ALL HAVING count(*) >= 5)"""


@query(f"WITH {LINES_SQL} SELECT document, line, n_pages FROM repeated WHERE document IN (SELECT document FROM pages_ GROUP BY document HAVING count(DISTINCT page) >= 3)")
def repeated_lines(spark, sf_dir):
    return T.repeated_lines(pages_of(spark, sf_dir))


@query(f"""WITH {LINES_SQL}, split AS (SELECT document, page, unnest(ls) AS raw, generate_subscripts(ls, 1) AS n FROM (SELECT document, page, string_split(text, chr(10)) AS ls FROM pages_)),
kept AS (SELECT s.* FROM split s WHERE NOT EXISTS (SELECT 1 FROM repeated r WHERE r.document = s.document AND r.line = trim(s.raw)))
SELECT p.document, p.page, md5(coalesce(string_agg(raw, chr(10) ORDER BY n), '')) AS text_hash FROM pages_ p LEFT JOIN kept USING (document, page) GROUP BY p.document, p.page""")
def repeated_line_removal(spark, sf_dir):
    rows = T.without_repeated_lines(pages_of(spark, sf_dir))
    return rows.select("document", "page", F.md5(F.col("text").cast("binary")).alias("text_hash"))


@query(f"WITH {PAGES_SQL} SELECT document, md5(string_agg(trim(text, ' '), chr(10) || chr(10) ORDER BY page)) AS text_hash, count(*) AS n_pages FROM pages_ WHERE trim(text, ' ') <> '' GROUP BY document")
def assemble_pages(spark, sf_dir):
    return T.assembled(pages_of(spark, sf_dir)).select("document", F.md5(F.col("text").cast("binary")).alias("text_hash"), "n_pages")


@query("SELECT doc_id, content_hash, first_id, copies, doc_id > first_id AS is_duplicate FROM (SELECT doc_id, md5(text) AS content_hash, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents)")
def exact_dedup(spark, sf_dir):
    return T.flagged_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query()
def request_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    return T.request_checks(rows).drop("text")


@query(r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, len(string_split(t, ' '))::INT AS n_words, CASE WHEN length(t) < 20 THEN 'too short' WHEN length(t) > 5000 THEN 'too long' WHEN len(string_split(t, ' ')) < 12 THEN 'too few words'
WHEN len(string_split(t, ' ')) < 15 AND t LIKE '%?' THEN 'a question' WHEN NOT list_has_any(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), ['that', 'will', 'because']) THEN 'no direction' END AS reason FROM t""")
def thesis_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    return T.thesis_checks(rows, ("that", "will", "because")).drop("text")


@query()
def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(X.documents(spark, sf_dir)).select("doc_id", "chunk_index", "chunk_id", "chars", "words", "chunk_hash")


@query()
def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(chunking.chunk_documents(X.documents(spark, sf_dir)))


def _any_sql(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


@query(rf"""WITH t AS (SELECT doc_id, lower(text) AS t, len(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS n FROM documents)
SELECT doc_id, CASE WHEN {_any_sql('t', lexicon.THESIS_PHRASES)} AND n > 15 THEN 'THESIS' WHEN {_any_sql('t', lexicon.REGULATORY_WORDS)} THEN 'REGULATORY' WHEN {_any_sql('t', lexicon.COMPARE_WORDS)} THEN 'COMPARATIVE' ELSE 'FACTUAL' END AS query_class FROM t""")
def classify_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tagging.query_class(F.col("text")).alias("query_class"))


CLASSES = {"COMPARATIVE": ("the", "vs"), "REGULATORY": ("der", "rbi"), "THESIS": ("les", "buy"), "ANALYTICAL": ("que", "why")}


@query(r"WITH t AS (SELECT doc_id, regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+') AS w FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN list_has_any(w, {list(m)}) THEN '{n}'" for n, m in CLASSES.items()) + " ELSE 'FACTUAL' END AS query_class FROM t")
def classify_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tagging.token_class(F.col("text"), CLASSES).alias("query_class"))


DICTIONARY = [(w, i) for i, w in enumerate("the and that with from this was are for not der die und das ist les des que pour dans los las para con".split())]


@query(rf"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS term FROM documents), d AS (SELECT unnest({[w for w, _ in DICTIONARY]}) AS term, unnest({[i for _, i in DICTIONARY]}) AS rank),
hits AS (SELECT doc_id, term, rank, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS nth FROM w JOIN d USING (term)) SELECT doc_id, array_to_string(list(term ORDER BY rank), ',') AS terms FROM hits WHERE nth <= 10 GROUP BY doc_id""")
def detect_terms(spark, sf_dir):
    known = spark.createDataFrame(DICTIONARY, "term string, rank int")
    return tagging.terms(table(spark, sf_dir, "documents"), known).select("doc_id", F.array_join("terms", ",").alias("terms"))


@query()
def acronym_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tagging.acronyms(F.col("text")), ",").alias("acronyms"))


@query()
def acronym_expand(spark, sf_dir):
    known = spark.createDataFrame([("GNU", "GNU's Not Unix"), ("CC", "Creative Commons"), ("MIT", "Massachusetts Institute of Technology")], "acronym string, meaning string")
    return tagging.expanded_acronyms(table(spark, sf_dir, "documents"), known)


@query(r"SELECT doc_id, CASE WHEN v <> '' THEN CAST(replace(v, ',', '') AS DOUBLE) END AS version FROM (SELECT doc_id, regexp_extract(text, '(?i)version ([0-9][0-9,]*(?:\.[0-9]+)?)', 1) AS v FROM documents) WHERE v <> ''")
def extract_figures(spark, sf_dir):
    found = tagging.figures(F.col("text"), {"version": (r"(?i)version ([0-9][0-9,]*(?:\.[0-9]+)?)", 0.0, 1000.0)})
    return table(spark, sf_dir, "documents").select("doc_id", found["version"].alias("version")).filter("version IS NOT NULL")


@query(r"SELECT o_orderkey, 'Q' || quarter(o_orderdate) AS quarter, 'FY' || right(CAST(year(o_orderdate) AS VARCHAR), 2) AS fiscal_year FROM orders")
def quarter_fy(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("results of q"), F.quarter("o_orderdate").cast("string"), F.lit(" fy "), F.year("o_orderdate").cast("string"))
    return o.select("o_orderkey", tagging.quarter(text).alias("quarter"), tagging.fiscal_year(text).alias("fiscal_year"))


@query(r"SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def lenient_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy", "MMMM d, yyyy"]
    text = F.element_at(F.array(*[F.date_format("ts", f) for f in forms]), (F.col("event_id") % len(forms) + 1).cast("int"))
    return e.select("event_id", C.lenient_date(text).alias("day"))


@query()
def decompose_comparison(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return tagging.subqueries(docs, ("the", "der", "les", "los"), ("and", "und", "est"))


STATED = r"(?:will|shall|expected\s+to|likely\s+to|projected\s+to|forecast\s+to)\s+\w+", r"(?:if|assuming|provided\s+that|given\s+that)\s+[\w\s,]+", r"(?:growth|expansion|improvement|compression|slowdown)\s+(?:of|in|to)\s+\d", r"(?:rate\s*cut|rate\s*hike|rbi|sebi|regulatory)"
STATED_SQL = [f"regexp_matches(s, '(?i){p}')" for p in STATED]
TAIL = ". Margins will widen by next year; Costs fall if rates ease further. Revenue growth of 5 percent. RBI rate cut is near! Costs fall if rates ease further"


@query(rf"""WITH p AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text || '{TAIL}', '[.!?;]') AS ls FROM documents)),
t AS (SELECT doc_id, pos, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(substr(s, 1, 40)) ORDER BY pos) AS nth FROM t WHERE length(s) >= 15 AND ({' OR '.join(STATED_SQL)})),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS n FROM f WHERE nth = 1)
SELECT doc_id, n, substr(s, 1, 300) AS sentence, CASE WHEN regexp_matches(lower(s), 'revenue|demand|volume|growth|market share') THEN 'demand' WHEN regexp_matches(lower(s), 'margin|ebitda|nim|npa|profitability|cost') THEN 'margin'
WHEN regexp_matches(lower(s), 'pe|p/e|valuation|multiple|re-rate|price') THEN 'valuation' WHEN regexp_matches(lower(s), 'rbi|sebi|regulatory|policy|regulation|law') THEN 'regulatory' WHEN regexp_matches(lower(s), 'rate|inflation|gdp|macro|fx|dollar') THEN 'macro'
WHEN regexp_matches(lower(s), 'competitor|competition|market share|moat') THEN 'competitive' ELSE 'unknown' END AS category,
CASE WHEN {STATED_SQL[0]} THEN 0.55::DOUBLE WHEN {STATED_SQL[1]} THEN 0.45 WHEN {STATED_SQL[2]} THEN 0.6 ELSE 0.5 END AS confidence, CASE WHEN n > 0 THEN [n - 1] ELSE [] END AS depends_on, n = 0 AS critical FROM n WHERE n < 8""")
def causal_assumptions(spark, sf_dir):
    stated = F.concat(F.col("text"), F.lit(TAIL))
    return tagging.causal_assumptions(table(spark, sf_dir, "documents").select("doc_id", stated.alias("text")))


@query(r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 2)) AS ws FROM documents),
q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 2)) AS qs FROM benchmark)
SELECT * FROM (SELECT item_id, doc_id, round(len(list_intersect(qs, ws)) / len(qs)::DOUBLE, 6) AS recall, round(len(list_intersect(qs, ws)) / (len(qs) + len(ws) - len(list_intersect(qs, ws)))::DOUBLE, 4) AS jaccard FROM w, q) WHERE recall >= 0.5""")
def benchmark_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", C.words(F.col("text")).alias("words"))
    items = table(spark, sf_dir, "benchmark").select("item_id", C.words(F.col("text")).alias("terms"))
    return T.term_overlaps(docs, items, 0.5)
