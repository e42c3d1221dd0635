"""The best rows by score and by final score are chosen within tasks, with the same results as over all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import vector as V
from siltstone.plans import fixtures as X

AS_OF = X.AS_OF


@pytest.fixture(scope="module")
def table(spark):
    """Vectors with many copies, a null, a null component, a zero, one of another length, and lists of terms that may be null."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 4)).round(2).tolist()
    rows = [(i, base[i % 40] if i % 3 else base[7], X.SOURCE_TYPES[i % 10], f"n{i % 3}", X.TERMS[i % 8 : i % 8 + 2] if i % 11 else None) for i in range(600)]
    rows += [(600, None, "rbi", "n0", ["nim"]), (601, [1.0, None, 0.0, 0.0], "rbi", "n1", []), (602, [0.0] * 4, "rbi", None, ["nim", "nim"]), (603, [1.0] * 3, "rbi", "n2", ["nim"])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, source_type string, namespace string, terms array<string>")
    return df.withColumn("doc_date", F.date_sub(F.lit(AS_OF).cast("date"), (F.col("vec_id") * 7 % 1000).cast("int"))).repartition(3).cache()


@pytest.fixture(scope="module")
def asked(table):
    return table.filter("vec_id % 60 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("terms").alias("query_terms")).cache()


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_best_by_score_within_groups(table, asked):
    few = V.similarity(table, asked, k=4, within="namespace")
    assert few.count() <= 3 * 4 * 4 * asked.count()
    assert rows(V.best(few, 4, within=("query_id", "namespace"))) == rows(V.best(V.similarity(table, asked), 4, within=("query_id", "namespace")))


def test_best_by_final_score(table, asked):
    few = V.similarity(table, asked, k=5, as_of=AS_OF)
    assert few.count() <= 3 * 5 * asked.count()
    assert rows(V.best(V.hybrid_score(few, AS_OF), 5, by="final_score")) == rows(V.best(V.hybrid_score(V.similarity(table, asked), AS_OF), 5, by="final_score"))


def test_floor_and_best_of_queries(table, asked):
    every = V.hybrid_score(V.similarity(table, asked), AS_OF)
    assert rows(V.composite_floor(V.hybrid_score(V.similarity(table, asked, as_of=AS_OF, least=0.7), AS_OF), 0.7)) == rows(V.composite_floor(every, 0.7))
    assert rows(V.best_of_queries(table, asked, AS_OF)) == rows(every.groupBy("vec_id").agg(F.max("final_score").alias("final_score"), F.count("*").alias("n_queries")))


def test_rounded_as_spark_rounds(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=300), (rng.integers(-(10**6), 10**6, 300) + 0.5) / 10**6, [0.0, 1e-7, 5e-7, -5e-7, 12345678.0000005, 1e15 + 0.5, 1e300, np.inf, -np.inf, np.nan]])
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1).select(F.round("x", 6)).collect()]
    assert np.array_equal(np.array(got), V.rounded(x, 6), equal_nan=True)
