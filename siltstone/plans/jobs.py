"""Composed jobs: ingestion, question answering, thesis review; and their registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicon
from ..operators import chunking, graph, scoring, tagging
from ..operators import text as T
from ..operators import vector as V
from ..session import spread_few
from ..sources import feeds
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


def ingest(docs: DataFrame) -> DataFrame:
    """Documents, as a table is read, to tagged chunks: clean, chunk, flag duplicates, tag, route.

    Whole texts stay in the task that reads them, however many are alike. Only hashes and ids are grouped; a chunk is of a first copy if its id and hash are among theirs.
    """
    hashed = lambda rows: rows.filter(F.length("text") >= 50).filter("doc_id IS NOT NULL").withColumn("content_hash", F.md5(F.col("text").cast("binary")))
    cleaned = hashed(spread_few(docs)).withColumn("text", T.cleaned(F.col("text")))
    chunks = chunking.chunk_documents(cleaned, carried=("source_type", "doc_date", "content_hash"))
    firsts = hashed(docs).groupBy("content_hash").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    flagged = chunks.join(firsts, ["doc_id", "content_hash"], "left").withColumn("is_duplicate", F.col("is_first").isNull()).drop("content_hash", "is_first")
    tagged = flagged.withColumn("namespace", C.lookup(F.col("source_type"), lexicon.NAMESPACES, "default"))
    return tagged.withColumn("quarter", tagging.quarter(F.col("text"))).withColumn("fiscal_year", tagging.fiscal_year(F.col("text")))


def audit(chunks: DataFrame) -> DataFrame:
    """One row a namespace: documents, chunks, characters, duplicates. Chunks are summed by document first, so that distinct documents are counted without copies of the rows."""
    documents = chunks.groupBy("namespace", "doc_id").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.max("is_duplicate").alias("is_duplicate"))
    return documents.groupBy("namespace").agg(
        F.count("doc_id").alias("n_documents"), F.sum("n").alias("n_chunks"), F.sum("chars").alias("chars"), F.count(F.when(F.col("is_duplicate"), F.col("doc_id"))).alias("n_duplicates")
    )


def answer(vectors: DataFrame, queries: DataFrame, texts: DataFrame, as_of: str, k: int = 6, most_chars: int = 6000) -> DataFrame:
    """For each query: oversampled search, hybrid ranking, the k best, their context within a budget, and a confidence."""
    near = V.knn(vectors, queries, min(3 * k, 20)).drop("rank")
    ranked = V.best(V.hybrid_score(near, as_of), k, by="final_score")
    found = ranked.join(texts, "vec_id")
    fitting = scoring.context_budget(found, most_chars, "query_id")
    context = fitting.groupBy("query_id").agg(F.count("*").alias("n_context"), F.max("chars_so_far").cast("long").alias("context_chars"))
    sure = scoring.answer_confidence(ranked, "query_id").select("query_id", "confidence", F.round("avg_score", 6).alias("avg_score"))
    top = ranked.filter("rank = 1").select("query_id", F.col("vec_id").alias("best_id"), "final_score")
    return top.join(sure, "query_id").join(context, "query_id", "left")


def review(theses: DataFrame) -> DataFrame:
    """Theses as texts to assumptions, a chain of dependencies, and a robustness class."""
    found = tagging.causal_assumptions(theses, key="thesis").withColumn("supported", F.length("sentence") % 2 == 0)
    levels = found.withColumn("risk", graph.node_risk(F.col("confidence"), F.col("supported")))
    return scoring.robustness(levels, "thesis", F.lit(False)).drop("cyclic")


@query()
def ingest_audit(spark, sf_dir):
    return audit(ingest(X.documents(spark, sf_dir)))


@query()
def answer_queries(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return answer(X.vectors(spark, sf_dir), X.queries(spark, sf_dir), texts, X.AS_OF)


@query()
def thesis_review(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return review(d.select(F.col("doc_id").alias("thesis"), F.concat(F.col("text"), F.lit(" This will rise because demand grows. ")).alias("text")))


@query(r"""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#>]+)["'']', 1)) AS href FROM pages) SELECT page_id, href, lower(href) LIKE '%.pdf' AS is_pdf FROM l""")
def page_links(spark, sf_dir):
    return feeds.links(table(spark, sf_dir, "pages"))


@query("SELECT url_hash, seen_at FROM (SELECT md5(url) AS url_hash, min(page_id) AS seen_at FROM pages GROUP BY 1)")
def url_registry(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.md5("url").alias("url_hash"), F.col("page_id").alias("seen_at"))
    return feeds.register(pages.filter("seen_at % 2 = 0"), pages.filter("seen_at % 2 = 1"))


@query("SELECT doc_id, concat_ws(chr(10) || chr(10), nullif(lang, ''), nullif(source, '')) AS text FROM documents")
def article_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("title"), F.lit("").alias("content"), F.lit(None).cast("string").alias("url"), F.lit(" ").alias("date"), "source")
    return feeds.article_text(d).select("doc_id", "text")


@query(f"""WITH {X.DOCUMENTS_SQL}, hits AS (SELECT doc_id, u.name, u.i, (length(text) - length(replace(lower(text), u.word, ''))) > 0 AS hit FROM docs, (SELECT unnest(['macro', 'execution']) AS name, unnest([0, 1]) AS i, unnest(['the', 'der']) AS word) u),
s AS (SELECT doc_id, name, (doc_id * 37 % 100) / 100.0::DOUBLE * (1 + least(hit::INT / 3.0::DOUBLE, 1)) AS score FROM hits)
SELECT name, doc_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY round(score, 6) DESC, doc_id) AS INT) AS rank FROM s) WHERE rank <= 4""")
def dimension_topn(spark, sf_dir):
    d = X.documents(spark, sf_dir).withColumn("base", (F.col("doc_id") * 37 % 100) / F.lit(100.0))
    words = {"macro": ("the",), "execution": ("der",)}
    hits = lambda ws: sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in ws), F.lit(0))
    each = F.array(*[F.struct(F.lit(n).alias("name"), (F.col("base") * (1 + F.least(hits(ws) / F.lit(3.0), F.lit(1.0)))).alias("score")) for n, ws in words.items()])
    rows = d.select("doc_id", F.explode(each).alias("d")).select("doc_id", "d.name", F.round("d.score", 6).alias("score"))
    w = Window.partitionBy("name").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter("rank <= 4")
