"""Registered queries: sections, tables, names and shared words of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assumptions as A
from ..operators import chunking as K
from ..operators import companies as N
from ..operators import overlap as O
from ..operators import sections as S
from ..operators import tables as B
from ..operators import tags
from ..session import new_folder, spread, spread_few
from ..sources import streams as R
from ..sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def numbered(spark, sf_dir):
    """Documents with a numbered header of its first words above every line."""
    titled = lambda line, i: F.concat_ws("\n", F.concat_ws(" ", (i + 1).cast("string"), F.initcap(F.array_join(F.slice(F.split(F.trim(line), r"\s+"), 1, 5), " "))), line)
    lines = F.transform(F.split("text", "\n"), titled)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


@query()
def document_sections(spark, sf_dir):
    return S.document_sections(numbered(spark, sf_dir)).select("doc_id", "n", "section", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


SHEET_SQL = """placed AS (SELECT l_orderkey AS page_id, l_returnflag AS flag, l_linenumber AS line, CAST(l_quantity AS INTEGER) AS quantity,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, CAST(l_quantity AS INTEGER)) AS nth FROM lineitem),
lines AS (SELECT *, nth = min(nth) OVER (PARTITION BY page_id, flag) AS opens FROM placed),
sheets AS (SELECT page_id, count(*) >= 2 AS financial FROM lines GROUP BY page_id),
slots AS (SELECT page_id, 0 AS row, unnest([0, 1, 2]) AS c, unnest(['Flag', 'Line and pieces', 'Line and pieces']) AS text, unnest([true, true, false]) AS begins FROM sheets
  UNION ALL SELECT page_id, nth, 0, flag, opens FROM lines UNION ALL SELECT page_id, nth, 1, CAST(line AS VARCHAR), true FROM lines UNION ALL SELECT page_id, nth, 2, CAST(quantity AS VARCHAR), true FROM lines)"""


@query(f"""WITH {SHEET_SQL} SELECT page_id, 0 AS "table", CAST(row AS INTEGER) AS row, c AS "column", text, begins, financial FROM slots JOIN sheets USING (page_id)""")
def table_cells(spark, sf_dir):
    """Order sheets as HTML: the lines of a return flag stand beside one cell of it, under a header that spans two columns."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), "l_returnflag", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"))
    lines = spread(lines, "page_id")  # short lines make long sheets, so that tasks cut by the bytes of lines are few
    parts = lines.groupBy("page_id", "l_returnflag").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "quantity"))).alias("rows"))
    row = lambda x: F.concat(F.lit("<td>"), x["l_linenumber"].cast("string"), F.lit("<td>"), x["quantity"].cast("string"))
    part = F.concat(F.lit("<tr><td rowspan="), F.size("rows").cast("string"), F.lit(">"), F.col("l_returnflag"), F.array_join(F.transform("rows", row), "</tr><tr>"), F.lit("</tr>"))
    sheets = parts.select("page_id", F.struct("l_returnflag", part.alias("html")).alias("p")).groupBy("page_id").agg(F.sort_array(F.collect_list("p")).alias("parts"))
    head = F.lit("<table><tr><th>Flag<th colspan=2>Line and pieces</tr>")
    return B.cells(sheets.select("page_id", F.concat(head, F.array_join(F.transform("parts", lambda p: p["html"]), ""), F.lit("</table>")).alias("html")))


@query()
def company_sector(spark, sf_dir):
    return N.company_and_sector(table(spark, sf_dir, "documents"))


PHRASES_SQL = r"""phrases AS (SELECT CAST(item_id AS INTEGER) AS number, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')[1:5], ' ') AS phrase FROM benchmark)"""


@query(rf"""WITH {PHRASES_SQL}, flat AS (SELECT doc_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(number) AS first_item, count(DISTINCT number) AS n_items FROM flat JOIN phrases ON phrase <> '' AND contains(t, phrase) GROUP BY doc_id""")
def named_phrases(spark, sf_dir):
    """Which items' first five words stand in a document."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    phrases = table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(words, 1, 5), " ").alias("phrase"), F.col("item_id").alias("number"))
    phrases = phrases.select(F.when(F.col("phrase") != "", F.concat(F.lit("*"), "phrase", F.lit("*"))).otherwise("").alias("phrase"), "number")
    hits = N.phrase_hits(table(spark, sf_dir, "documents"), phrases)
    return hits.select("doc_id", F.get("hits", F.lit(0)).alias("first_item"), F.size("hits").cast("long").alias("n_items"))


WORDS4_SQL = r"list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z]{{4,}}'))"


@query(rf"""WITH {PHRASES_SQL},
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
events AS (SELECT doc_id, n, line, number FROM lines JOIN phrases ON phrase <> '' AND contains(regexp_replace(lower(line), '\s+', ' ', 'g'), phrase)),
theses AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}'))) AS ws FROM conversations WHERE role = 'user'),
said AS (SELECT DISTINCT doc_id, n, list_distinct(list_filter(regexp_split_to_array(lower(line), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}'))) AS ws FROM events),
pairs AS (SELECT conv_id, turn, doc_id, n, len(list_intersect(t.ws, s.ws)) AS shared FROM theses t, said s WHERE len(list_intersect(t.ws, s.ws)) >= 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, number ORDER BY doc_id, n) AS nth FROM pairs JOIN events USING (doc_id, n))
SELECT conv_id, turn, number AS title, round(least(0.65 + shared / 100, 0.95), 3) AS score, doc_id, CAST(n AS INTEGER) AS line FROM ranked WHERE nth = 1""")
def corpus_analogs(spark, sf_dir):
    """For each user turn, the lines of documents that name an item of the benchmark and share three words or more with it."""
    documents = spread_few(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).select(F.struct("doc_id", "n").alias("place"), "text")
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    phrases = table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(words, 1, 5), " ").alias("phrase"), F.col("item_id").alias("number"))
    phrases = phrases.filter("phrase <> ''").select(F.concat(F.lit("*"), "phrase", F.lit("*")).alias("phrase"), "number")
    hits = N.phrase_hits(lines, phrases, "place", with_text=True)
    events = hits.select(F.col("place").alias("id"), "place", F.explode("hits").alias("title"), F.lit(0.65).alias("base"), "text")
    theses = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.struct("conv_id", "turn").alias("id"), "text")
    found = O.corpus_analogs(theses, events)
    return found.select("id.conv_id", "id.turn", "title", "score", "place.doc_id", F.col("place.n").alias("line"))


#: Answers made of an order's lines, each damaged in its own way: fenced, in Python's words, cut off, with a stray comma, or no list at all.
ITEMS_SQL = """l AS (SELECT l_orderkey AS answer_id, l_linenumber AS line, l_returnflag AS flag, CAST(l_quantity AS INT) AS q, l_discount AS d, l_partkey AS part,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INT)) - 1 AS place FROM lineitem),
items AS (SELECT *, 'Sales of part ' || part || ' rise' AS text, ['Demand', 'margin', 'other'][CAST(1 + part % 3 AS INT)] AS category, q > 25 AS critical FROM l),
firsts AS (SELECT *, row_number() OVER (PARTITION BY answer_id, text ORDER BY place) AS nth FROM items WHERE place < 8)"""


@query(f"""WITH {ITEMS_SQL}, states AS (SELECT answer_id, place, text, category, critical, d, CASE WHEN nth > 1 THEN 'repeated' END AS reject FROM firsts UNION ALL SELECT answer_id, place, text, category, critical, d, 'too many' FROM items WHERE place >= 8),
kept AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY place) AS id FROM states WHERE reject IS NULL)
SELECT s.answer_id, CAST(s.place AS INTEGER) AS place, CAST(k.id AS INTEGER) AS id, CASE WHEN k.id IS NOT NULL THEN k.text END AS text,
  CASE WHEN k.id IS NOT NULL THEN CASE k.category WHEN 'Demand' THEN 'demand' WHEN 'margin' THEN 'margin' ELSE 'unknown' END END AS category,
  CASE WHEN k.id IS NOT NULL THEN round(least(k.d * 20, 1.0), 6) END AS confidence, CASE WHEN k.id IS NOT NULL THEN k.critical END AS critical, s.reject
FROM states s LEFT JOIN kept k ON k.answer_id = s.answer_id AND k.place = s.place WHERE s.answer_id % 5 <> 4
UNION ALL SELECT DISTINCT answer_id, -1, NULL, NULL, NULL, NULL, NULL, 'no list' FROM items WHERE answer_id % 5 = 4""")
def model_assumptions(spark, sf_dir):
    """Orders as a model's answers: what is read of each, whatever its damage."""
    part, d = F.col("l_partkey"), F.col("l_discount") * 20
    category = F.element_at(F.array(F.lit("Demand"), F.lit("margin"), F.lit("other")), (1 + part % 3).cast("int"))
    critical = F.when(F.col("quantity") > 25, "True").otherwise("False")
    item = F.concat(F.lit('{"text": "Sales of part '), part.cast("string"), F.lit(" rise\", 'category': '"), category, F.lit("', \"confidence\": "), F.round(d, 6).cast("string"), F.lit(', "is_critical": '), critical, F.lit(", }"))
    lines = table(spark, sf_dir, "lineitem").withColumn("quantity", F.col("l_quantity").cast("int"))
    grouped = lines.groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "quantity", item.alias("item")))).alias("x"))
    items = F.array_join(F.transform("x", lambda x: x["item"]), ",\n")
    kind = F.col("answer_id") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("Here:\n```json\n["), items, F.lit(",]\n```\nAll [done]")))
        .when(kind == 1, F.concat(F.lit('{"assumptions": ['), items, F.lit("]}")))
        .when(kind == 2, F.concat(F.lit("["), items))
        .when(kind == 3, F.concat(F.lit("{'items': ["), items, F.lit(",")))
        .otherwise("I can't name any.")
    )
    return A.assumptions(grouped.select("answer_id", text.alias("text"))).drop("depends_on").withColumn("confidence", F.round("confidence", 6))


#: One statement of each figure; {v} is a number with one digit after the point, {n} a whole one with commas.
STATEMENTS = (
    "NIM was {v}%", "Gross NPA at {v} %", "NNPA of {v}%", "CASA ratio stood at {v}%", "Capital adequacy of {v}%", "Tier I capital ratio {v}%", "PCR {v}%", "Return on equity {v}%",
    "ROA {v}%", "P/E ratio of {v}x", "EPS of Rs. {v}", "Revenue of Rs {n} crore", "Revenue grew by {v}%", "PAT at Rs {n} crore", "EBITDA margin of {v}%", "AUM of Rs {n} cr", "CAGR of {v}%",
    "Dividend yield of {v}%", "Loan book growth of {v}%", "Deposit growth of {v}%", "Repo rate at {v}%", "CPI at {v}%", "Attrition rate was {v}%", "TCV of $ {v} billion",
)

FIGURES_SQL = """VALUES ('nim_pct', 0, 0.5, 15, 0), ('gnpa_pct', 1, 0, 50, 0), ('nnpa_pct', 2, 0, 30, 0), ('casa_ratio_pct', 3, 5, 80, 10), ('crar_pct', 4, 8, 50, 10), ('tier1_capital_pct', 5, 6, 40, 10), ('pcr_pct', 6, 10, 100, 10), ('roe_pct', 7, -20, 60, 0),
('roa_pct', 8, -5, 10, 0), ('pe_ratio', 9, 0, 500, 0), ('eps', 10, -500, 10000, 0), ('revenue_crore', 11, 1, 1000000, 0), ('revenue_growth_pct', 12, -50, 200, 0), ('pat_crore', 13, -100000, 1000000, 0), ('ebitda_margin_pct', 14, -10, 80, 0), ('aum_crore', 15, 1, 10000000, 0), ('cagr_pct', 16, -20, 100, 0),
('dividend_yield_pct', 17, 0, 20, 0), ('loan_growth_pct', 18, -50, 200, 0), ('deposit_growth_pct', 19, -50, 200, 0), ('repo_rate_pct', 20, 0.5, 20, 0), ('cpi_inflation_pct', 21, -5, 50, 0), ('attrition_pct', 22, 0, 100, 0), ('deal_tcv_bn_usd', 23, 0.01, 1000, 0)"""


@query(f"""WITH named AS (SELECT * FROM ({FIGURES_SQL}) t(figure, k, low, high, least)),
stated AS (SELECT p_partkey, figure, low, high, least, CASE WHEN figure IN ('revenue_crore', 'pat_crore', 'aum_crore') THEN (p_partkey * (37 + k)) % 900000 ELSE (p_partkey * (2 * k + 3)) % 1000 / 10.0 END AS v FROM part, named)
SELECT p_partkey, figure, round(CAST(v AS DOUBLE), 4) AS value FROM stated WHERE v >= low AND v <= high AND v >= least""")
def financial_figures(spark, sf_dir):
    """Parts as texts that state every figure, each with a number of the part, far enough apart that none is read for another."""
    key = F.col("p_partkey")
    said = []
    for k, statement in enumerate(STATEMENTS):
        v, n = F.format_string("%.1f", (key * (2 * k + 3)) % 1000 / 10.0), F.format_number((key * (37 + k)) % 900000, 0)
        before, after = statement.split("{v}" if "{v}" in statement else "{n}")
        said.append(F.concat(F.lit(before), v if "{v}" in statement else n, F.lit(after)))
    text = F.concat_ws(". " + "z" * 40 + " ", *said)
    stated = spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", text.alias("text"))
    return stated.select("p_partkey", F.explode(tags.figures(F.col("text"))).alias("figure", "value"))  # from a column of figures Spark would read texts twice, before they are dealt out too, to pass over empty ones


@query(r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#>]+)["'']', 1) AS links FROM pages),
l AS (SELECT page_id, unnest(links) AS link, unnest(range(len(links))) AS n FROM a)
SELECT link, page_id, CAST(n AS INTEGER) AS n, md5(link) AS url_hash FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, n) AS nth FROM l) WHERE nth = 1""")
def streamed_links(spark, sf_dir):
    """Every link of the stored pages once, with the first page that has it."""
    pages = R.table_stream(spark, f"{sf_dir.rstrip('/')}/pages.parquet", table(spark, sf_dir, "pages").schema)
    found = R.each_once(R.listing_links(pages), new_folder(spark, "links"), ["page_id", "n"])
    return found.select("link", "page_id", "n", "url_hash")


@query()
def section_chunks(spark, sf_dir):
    """Chunks that keep to the sections of the numbered documents."""
    docs = numbered(spark, sf_dir).withColumn("source_type", F.lit("annual_report"))
    return K.chunk_documents(docs, by_section=True).select("doc_id", "chunk_index", "section", "chars", "words", "chunk_hash")
