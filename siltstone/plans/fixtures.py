"""How the driver's tables stand in for a corpus with metadata; the same expressions are in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicon
from ..session import spread_few
from ..sources.tables import table

AS_OF = "2024-06-30"
SOURCE_TYPES = ("rbi", "sebi", "mca", "annual_report", "tax_law", "earnings_transcript", "broker_research", "news", "blog", "unknown")


def source_type_of(number) -> F.Column:
    return F.element_at(F.array(*[F.lit(s) for s in SOURCE_TYPES]), (number % 10 + 1).cast("int"))


#: Terms that vectors and queries stand for, some of them two spellings of one.
TERMS = ("nim", "net interest margin", "npa", "roe", "return on equity", "casa", "crar", "margin")
SPELLINGS = {"nim": "net interest margin", "roe": "return on equity"}


def terms_of(number) -> F.Column:
    known = F.array(*[F.lit(t) for t in TERMS])
    return F.array_distinct(F.array(*[F.element_at(known, (number * k % 8 + 1).cast("int")) for k in (1, 3, 5)]))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_few(table(spark, sf_dir, "embeddings"))
    return (
        rows.withColumn("source_type", source_type_of(F.col("vec_id")))
        .withColumn("doc_date", F.date_sub(F.lit(AS_OF).cast("date"), (F.col("vec_id") * 7 % 1000).cast("int")))
        .withColumn("namespace", C.lookup(F.col("source_type"), lexicon.NAMESPACES, "default"))
        .withColumn("terms", terms_of(F.col("vec_id")))
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20. Four in a row are the angles of one thesis."""
    rows = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), terms_of(F.col("vec_id") + 1).alias("query_terms"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return rows.withColumn("source_type", source_type_of(number)).withColumn("doc_date", F.date_sub(F.lit(AS_OF).cast("date"), (F.col("doc_id") % 900).cast("int")))


TYPES_SQL = "[" + ", ".join(f"'{s}'" for s in SOURCE_TYPES) + "]"


def case_sql(column: str, values: dict, default) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"(CASE {column} " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in values.items()) + f" ELSE {quote(default)} END)"


#: The constants of the SQL, written out anew, so that a wrong one in the library shows.
AUTHORITY = {"rbi": 1.0, "sebi": 1.0, "mca": 0.95, "tax_law": 0.9, "annual_report": 0.75, "earnings_transcript": 0.65, "broker_research": 0.4, "news": 0.25, "unknown": 0.2, "blog": 0.15}
AUTHORITY_FACTOR = {"rbi": 1.5, "sebi": 1.5, "mca": 1.4, "annual_report": 1.3, "tax_law": 1.3, "earnings_transcript": 1.2, "broker_research": 1.1, "news": 1.0, "blog": 0.8, "unknown": 0.7}
NAMESPACES = {"rbi": "regulatory", "sebi": "regulatory", "mca": "regulatory", "tax_law": "regulatory", "annual_report": "corporate", "earnings_transcript": "corporate", "broker_research": "research", "news": "news", "blog": "research"}
RISK_WEIGHTS = {"demand": 1.3, "margin": 1.2, "valuation": 1.1, "regulatory": 1.0, "macro": 1.1, "competitive": 1.0}

def terms_sql(number: str) -> str:
    return "list_distinct([" + ", ".join(f"{list(TERMS)}[CAST({number} * {k} % 8 + 1 AS INT)]" for k in (1, 3, 5)) + "])"


VECTORS_SQL = f"""typed AS (
  SELECT *, {TYPES_SQL}[CAST(vec_id % 10 + 1 AS INT)] AS source_type, DATE '{AS_OF}' - CAST(vec_id * 7 % 1000 AS INT) AS doc_date FROM embeddings
), vectors AS (
  SELECT *, {case_sql('source_type', NAMESPACES, 'default')} AS namespace, {terms_sql('vec_id')} AS terms FROM typed
)"""

SIMILARITY_SQL = f"""SELECT v.*, q.vec_id AS query_id, {terms_sql('(q.vec_id + 1)')} AS query_terms,
  round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS score
  FROM vectors v, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q"""

DOCUMENTS_SQL = f"""docs AS (
  SELECT *, {TYPES_SQL}[CAST(CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 10 + 1 AS INT)] AS source_type,
    DATE '{AS_OF}' - CAST(doc_id % 900 AS INT) AS doc_date FROM documents
)"""
