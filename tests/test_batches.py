"""What tasks send: many pages in a batch, few chunks in a frame, and rows of one small file from several tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import chunking, tables
from siltstone.plans import structure

from .conftest import SF_DIR


def test_slots_of_many_pages_are_one_batch(spark, monkeypatch):
    page = "<table><tr><th>a<th>b</tr><tr><td>1<td>2</tr></table>"
    pages = spark.createDataFrame([(i, page if i % 4 else None) for i in range(400)], "page_id long, html string").coalesce(1)
    made = {}
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, run, schema: made.setdefault("run", run))
    tables.cells(pages)
    batches = list(made["run"](iter(pages.toArrow().to_batches())))
    assert len(batches) == 1 and batches[0].num_rows == 300 * 4
    assert batches[0].column(0).to_pylist() == [i for i in range(400) if i % 4 for _ in range(4)]
    monkeypatch.setattr(tables, "SENT", 40)
    small = list(made["run"](iter(pages.toArrow().to_batches())))
    assert len(small) == 30 and sum((b.to_pylist() for b in small), []) == batches[0].to_pylist()


def test_chunks_leave_by_their_characters(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "news", f"Sentence {i} says some twenty words or more so that the chunk is kept by all of the rules that there are for it here. " * 3) for i in range(50)], "doc_id long, source_type string, text string")
    made = {}
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, run, schema: made.setdefault("run", run))
    chunking.chunk_documents(docs)
    frame = docs.toPandas()
    whole = list(made["run"](iter([frame])))
    assert len(whole) == 1 and len(whole[0]) >= 50
    monkeypatch.setattr(chunking, "SENT_CHARS", 1000)
    parts = list(made["run"](iter([frame])))
    assert len(parts) > 5 and sum((p.values.tolist() for p in parts), []) == whole[0].values.tolist()


def test_small_files_are_read_by_several_tasks(spark):
    for name in ("table_cells", "financial_figures"):
        parts = structure.QUERIES[name](spark, SF_DIR).select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts >= 4, name


def test_figures_are_read_once_and_after_texts_are_dealt_out(spark):
    plan = structure.QUERIES["financial_figures"](spark, SF_DIR)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Exchange")


def test_patterns_by_their_first_letters():
    """Places and what groups hold are those of the whole pattern, and no text is walked letter by letter."""
    import random
    import re
    import time

    from siltstone.functions.patterns import Pattern
    from siltstone.operators import extraction, tags

    rng = random.Random(7)
    seen = lambda m: (m.span(), [g for g in m.groups() if g is not None])
    for pattern in [p for _, p, _, _ in tags.FIGURES] + [p for _, p, *_ in (*extraction.CLAIM_METRICS, *extraction.RECORD_METRICS)]:
        bits = re.findall(r"[a-z]{2,}", re.sub(r"\\[a-zA-Z]", " ", pattern)) + ["rate", "12.5 %", "7 cr", "3x fy24", " ", " ", "_", "p/e", "\n", "-"]
        for _ in range(150):
            text = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(12)))
            assert [seen(m) for m in Pattern(pattern).each(text)] == [seen(m) for m in re.finditer(pattern, text)], (pattern, text)
    text = ("Growth of the bank is said to be well above that of its peers. " * 400) + "CPI at 4.5%, P/E ratio of 20x, net NPA of 2 %"
    began = time.perf_counter()
    for _ in range(200):
        found = tags.stated_figures(text)
    assert found == {"cpi_inflation_pct": 4.5, "pe_ratio": 20.0, "nnpa_pct": 2.0} and time.perf_counter() - began < 1.5
