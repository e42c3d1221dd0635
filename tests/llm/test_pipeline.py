"""The pipeline, stage by stage, against plain Python on what each stage was given."""

import pytest
from pyspark.sql import functions as F

from siltstone.llm import pii
from siltstone.llm.shared import stage
from siltstone.sources.tables import table
from tests.conftest import SF_DIR

from .test_ngram_join import brute_force

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, given, results = docs.columns, [], []
    for i, (_, apply) in enumerate(pipeline.STAGES):
        given.append(docs)
        docs = stage(apply(spark, docs, SF_DIR), f"test-{i}")
        results.append(docs)
    assert all(r.columns == columns for r in results[:-1])
    ids = [[r.doc_id for r in df.select("doc_id").collect()] for df in results]
    assert len(ids[0]) > 0.8 * given[0].count()

    texts = [(r.doc_id, r.text) for r in given[2].collect()]
    assert sorted(ids[2]) == sorted(i for i, (_, c) in brute_force(texts).items() if i == c)

    before = {r.doc_id: r.text for r in given[3].collect()}
    accepted = pii.learn(given[3])
    for r in results[3].collect():
        assert r.text == pii.masked_text(before[r.doc_id], pii.spans_of(before[r.doc_id], accepted)[1]) and r.n_chars == len(r.text)

    packed = results[4].collect()
    totals = {}
    for r in packed:
        assert len(r.ids) == 4 * r.length
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    assert totals == {r.doc_id: r.doc_tokens for r in packed} and set(totals) == set(ids[3])


def test_toxic_documents_go(spark):
    """The first stage keeps just what op5 does not call toxic on the same documents, scores between 0.3 and 0.5 included."""
    from siltstone.llm import queries

    rows = queries.queries()["op5_kneser_ney_toxicity"](spark, SF_DIR).select("doc_id", "score", "predicted").collect()
    assert any(0.3 <= r.score < 0.5 for r in rows)
    docs = pipeline.STAGES[0][1](spark, table(spark, SF_DIR, "documents"), SF_DIR)
    assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(r.doc_id for r in rows if not r.predicted)


def test_columns_of_any_names(spark):
    """Dots, backticks, and the names that stages use for columns of their own; a repeated id and null texts among the rows."""
    names = ["a.b", "c`d", "again_id", "again", "lost", "carried", "score", "mean_evidence", "kept", "n_words", "class_distance", "commons", "sid", "key", "root", "measured", "ids", "length", "rank", "own", "block", "bucket"]
    base = table(spark, SF_DIR, "documents").limit(40)
    docs = base.unionByName(base.limit(3)).unionByName(base.limit(1).withColumn("text", F.lit(None).cast("string")))
    docs = stage(docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names)), "names")
    for _, apply in pipeline.STAGES[:-1]:
        out = stage(apply(spark, docs, SF_DIR), "names")
        assert out.columns == docs.columns and out.count() > 0
        for r in out.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in names)
    assert pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= 40
