import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import lists, vector
from siltstone.sources.tables import table

from .conftest import SF_DIR


def recall(spark, folder):
    vectors = table(spark, folder, "embeddings")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r.query_id, r.vec_id): r.score for r in lists.nearest(vectors, queries).collect()}
    want = {(r.query_id, r.vec_id): r.score for r in vector.knn(vectors.select("vec_id", "embedding"), queries).collect()}
    assert all(abs(got[p] - want[p]) < 2e-6 for p in set(got) & set(want)) and len(got) == len(want)
    return len(set(got) & set(want)) / len(want)


@pytest.mark.parametrize("folder", [SF_DIR, "/root/testdata/sf0.1"])
def test_recall_over_every_twentieth_vector(spark, folder, monkeypatch):
    monkeypatch.setattr(lists, "ROWS_A_LIST", 60)
    assert recall(spark, folder) >= 0.9


def test_crowded_lists_are_many_blocks(spark, monkeypatch):
    """All lists probed: the exact answer, whatever the blocks."""
    monkeypatch.setattr(lists, "BLOCK", 37)
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((rng.standard_normal((200, 8)), np.tile(rng.standard_normal(8), (150, 1)))))]
    rows += [(900, None), (901, [0.0] * 8), (902, [1.0, None] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, rows[i][1]) for i in (3, 50, 210)], "query_id long, query array<double>")
    centroids = lists.fitted(vectors, 5)
    got = lists.search(lists.indexed(vectors, centroids), queries, centroids, probes=5, k=7).collect()
    x = np.array([v for _, v in rows[:350]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for q in (3, 50, 210):
        s = np.round(x @ x[q], 6)
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == np.lexsort((np.arange(350), -s))[:7].tolist()
