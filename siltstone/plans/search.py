"""Registered queries: vector search, scoring, index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import lists as L
from ..operators import vector as V
from . import fixtures as X

QUERIES, SQL = {}, {}
OUT = ["query_id", "vec_id", "source_type", "namespace", "score", "rank"]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _scored() -> str:
    return f"WITH {X.VECTORS_SQL}, scored AS ({X.SIMILARITY_SQL})"


def _ranked(source: str, k: int, where: str = "true", by: str = "score", within: str = "query_id", out: str = ", ".join(OUT)) -> str:
    return f"SELECT {out} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {within} ORDER BY {by} DESC, vec_id) AS INT) AS rank FROM {source} WHERE {where}) WHERE rank <= {k}"


@query(f"{_scored()} {_ranked('scored', 10)}")
def knn_topk(spark, sf_dir):
    return V.knn(X.vectors(spark, sf_dir), X.queries(spark, sf_dir), 10).select(*OUT)


@query()
def knn_lists(spark, sf_dir):
    """The same by lists around centroids: approximate, with a measured recall."""
    return L.nearest(X.vectors(spark, sf_dir), X.queries(spark, sf_dir), 10)


@query(f"{_scored()} " + _ranked("scored", 5, "source_type IN ('rbi', 'sebi') AND label = 3"))
def knn_filtered(spark, sf_dir):
    wanted = {"source_type": ["rbi", "sebi"], "label": 3, "not_a_key": 1}
    return V.knn(X.vectors(spark, sf_dir), X.queries(spark, sf_dir), 5, wanted).select(*OUT)


@query(f"{_scored()} {_ranked('scored', 20, 'score >= 0.1')}")
def knn_min_score(spark, sf_dir):
    return V.knn(X.vectors(spark, sf_dir), X.queries(spark, sf_dir), 50, min_score=0.1).select(*OUT)


@query(f"{_scored()}, near AS ({_ranked('scored', 10, within='query_id, namespace', out='* EXCLUDE (rank)')}) {_ranked('near', 10)}")
def knn_fanout(spark, sf_dir):
    return V.fan_out(X.vectors(spark, sf_dir), X.queries(spark, sf_dir), 10).select(*OUT)


@query(f"{_scored()} {_ranked('scored', 5, 'score >= 0.15', within='query_id, namespace')}")
def per_namespace_results(spark, sf_dir):
    scored = V.similarity(X.vectors(spark, sf_dir), X.queries(spark, sf_dir), k=5, within="namespace").filter("score >= 0.15")
    return V.best(scored, 5, within=("query_id", "namespace")).select(*OUT)


HYBRID_SQL = f"""hybrid AS (
  SELECT *, round(0.55 * greatest(0, least(1, score)) + 0.25 * authority_score + 0.12 * recency_score + 0.08 * overlap_score, 6) AS final_score FROM (
    SELECT *, round(len(list_intersect(query_terms, terms)) / len(query_terms)::DOUBLE, 6) AS overlap_score,
      round(greatest(0, least(1, (authority_weight - 0.15) / (1.0::DOUBLE - 0.15))), 6) AS authority_score,
      CASE WHEN age <= 180 THEN 1.0::DOUBLE WHEN age >= 730 THEN 0.05::DOUBLE ELSE round(0.05 + 0.95 * (1 + cos(pi() * (age - 180) / 550.0::DOUBLE)) / 2, 6) END AS recency_score
    FROM (SELECT *, {X.case_sql('source_type', X.AUTHORITY, 0.2)} AS authority_weight, date_diff('day', doc_date, DATE '{X.AS_OF}') AS age FROM scored))
)"""
SCORES = ["authority_weight", "authority_score", "recency_score", "final_score"]


@query(f"{_scored()}, {HYBRID_SQL} {_ranked('hybrid', 10, by='final_score', out='query_id, vec_id, source_type, score, rank, ' + ', '.join(SCORES))}")
def hybrid_score(spark, sf_dir):
    return V.hybrid_best(X.vectors(spark, sf_dir), X.queries(spark, sf_dir), X.AS_OF, 10).select("query_id", "vec_id", "source_type", "score", "rank", *SCORES)


@query(f"{_scored()}, {HYBRID_SQL} SELECT vec_id, max(final_score) AS final_score, count(*) AS n_queries FROM hybrid GROUP BY vec_id ORDER BY final_score DESC, vec_id LIMIT 15")
def multi_query_merge(spark, sf_dir):
    found = V.best_of_queries(X.vectors(spark, sf_dir), X.queries(spark, sf_dir), X.AS_OF)
    return found.orderBy(F.desc("final_score"), "vec_id").limit(15)


@query(f"{_scored()}, {HYBRID_SQL} {_ranked('hybrid', 10, where='authority_weight >= 0.95', by='final_score', out='query_id, vec_id, source_type, final_score, rank')}")
def preset_regulatory(spark, sf_dir):
    return V.hybrid_best(V.authority_floor(X.vectors(spark, sf_dir), 0.95), X.queries(spark, sf_dir), X.AS_OF, 10).select("query_id", "vec_id", "source_type", "final_score", "rank")


@query(f"{_scored()}, {HYBRID_SQL} {_ranked('hybrid', 8, where='namespace = ' + repr('corporate') + ' AND label = 3', by='final_score', out='query_id, vec_id, source_type, final_score, rank')}")
def preset_corporate(spark, sf_dir):
    """Labels stand for companies."""
    named = X.vectors(spark, sf_dir).withColumn("company", F.concat(F.lit("company "), "label"))
    return V.preset(named, X.queries(spark, sf_dir), "corporate", X.AS_OF, "company 3").select("query_id", "vec_id", "source_type", "final_score", "rank")


@query(f"{_scored()}, {HYBRID_SQL} {_ranked('hybrid', 5, where='namespace = ' + repr('research') + ' AND authority_weight >= 0.2', by='final_score', out='query_id, vec_id, source_type, final_score, rank')}")
def preset_research(spark, sf_dir):
    return V.preset(X.vectors(spark, sf_dir), X.queries(spark, sf_dir), "research", X.AS_OF).select("query_id", "vec_id", "source_type", "final_score", "rank")


@query(f"""WITH {X.VECTORS_SQL} SELECT vec_id, date_diff('day', doc_date, DATE '{X.AS_OF}')::INT AS age,
  CASE WHEN age <= 180 THEN 1.0::DOUBLE WHEN age >= 730 THEN 0.05::DOUBLE ELSE round(0.05 + 0.95 * (1 + cos(pi() * (age - 180) / 550.0::DOUBLE)) / 2, 6) END AS recency FROM vectors""")
def recency_cosine(spark, sf_dir):
    as_of = F.lit(X.AS_OF).cast("date")
    return X.vectors(spark, sf_dir).select("vec_id", F.datediff(as_of, "doc_date").alias("age"), C.recency_cosine(F.col("doc_date"), as_of).alias("recency"))


@query(f"WITH {X.VECTORS_SQL} SELECT vec_id, round(greatest(0, 1 - date_diff('day', doc_date, DATE '{X.AS_OF}') / 365.0::DOUBLE), 6) AS recency FROM vectors")
def recency_linear(spark, sf_dir):
    as_of = F.lit(X.AS_OF).cast("date")
    return X.vectors(spark, sf_dir).select("vec_id", F.round(C.recency_linear(F.col("doc_date"), as_of), 6).alias("recency"))


@query(f"WITH {X.VECTORS_SQL} SELECT vec_id, source_type FROM vectors WHERE {X.case_sql('source_type', X.AUTHORITY, 0.2)} >= 0.6")
def authority_floor(spark, sf_dir):
    return V.authority_floor(X.vectors(spark, sf_dir), 0.6).select("vec_id", "source_type")


def _closed_sql(column: str) -> str:
    """Each term with its other spelling, those of X.SPELLINGS."""
    other = "CASE t WHEN 'nim' THEN 'net interest margin' WHEN 'net interest margin' THEN 'nim' WHEN 'roe' THEN 'return on equity' WHEN 'return on equity' THEN 'roe' END"
    return f"list_distinct(list_concat({column}, list_filter(list_transform({column}, lambda t: {other}), lambda u: u IS NOT NULL)))"


JACCARD_SQL = "round(len(list_intersect(qs, ts)) / (len(qs) + len(ts) - len(list_intersect(qs, ts)))::DOUBLE, 4)"


@query(f"""{_scored()}, near AS ({_ranked('scored', 20, 'score >= 0.05', out='* EXCLUDE (rank)')}), again AS (
  SELECT *, round(score * (1 + 0.3 * greatest(0, 1 - date_diff('day', doc_date, DATE '{X.AS_OF}') / 365.0::DOUBLE)) * {X.case_sql('source_type', X.AUTHORITY_FACTOR, 0.7)} * (1 + 0.2 * {JACCARD_SQL}), 6) AS rerank_score FROM (SELECT *, {_closed_sql('query_terms')} AS qs, {_closed_sql('terms')} AS ts FROM near)
) {_ranked('again', 6, where='rerank_score >= 0.1', by='rerank_score', out='query_id, vec_id, rerank_score, rank')}""")
def rerank_multiplicative(spark, sf_dir):
    near = V.knn(X.vectors(spark, sf_dir), X.queries(spark, sf_dir), 20, min_score=0.05).drop("rank")
    overlap = C.jaccard(C.closed_terms(F.col("query_terms"), X.SPELLINGS), C.closed_terms(F.col("terms"), X.SPELLINGS))
    return V.rerank(near, X.AS_OF, overlap, floor=0.05).select("query_id", "vec_id", "rerank_score", "rank")


@query(f"WITH {X.VECTORS_SQL} SELECT namespace, count(*) AS n_vectors, max(len(embedding))::INT AS dimension FROM vectors GROUP BY namespace")
def index_stats(spark, sf_dir):
    return V.index_stats(X.vectors(spark, sf_dir))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def fetch_ids(spark, sf_dir):
    ids = X.documents(spark, sf_dir).filter("lang = 'de'").select(F.col("doc_id").alias("vec_id"))
    return V.fetch(X.vectors(spark, sf_dir), ids).select("vec_id", "label")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm, len(embedding)::INT AS dimension FROM embeddings")
def vector_norms(spark, sf_dir):
    return V.checked(X.vectors(spark, sf_dir), 64).select("vec_id", F.round(C.norm(F.col("embedding")), 5).alias("norm"), F.size("embedding").alias("dimension"))


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM embeddings""")
def upsert_latest(spark, sf_dir):
    current = X.vectors(spark, sf_dir).select("vec_id", "label", F.lit(1).alias("version"))
    batch = current.filter("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version"))
    return V.upsert(current, batch)


@query("SELECT vec_id, label FROM embeddings WHERE label <> 4")
def delete_antijoin(spark, sf_dir):
    rows = X.vectors(spark, sf_dir)
    return V.delete(rows, rows.filter("label = 4")).select("vec_id", "label")
