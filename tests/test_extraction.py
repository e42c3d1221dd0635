"""Places of names in texts, entities by plain search first, and statements dealt out over tasks."""

from __future__ import annotations

import random
import re
from functools import reduce

from pyspark.sql import functions as F

from siltstone.operators import extraction as E
from siltstone.plans import language

from .conftest import SF_DIR


def test_places_are_those_of_a_plain_search(spark):
    texts = ["NIM of 4, nim 5 and NIMBLE", "", "none", "nim", f"{E.MARK}nim{E.MARK}{E.OTHER_MARK} Nim {E.MARK}", "nimnim nim\nnim"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", E.places(F.col("text"), r"(?i)\bnim\b").alias("p")).collect()
    assert {r.id: [(p.start, p.end) for p in r.p] for r in found} == {i: [m.span() for m in re.finditer(r"(?i)\bnim\b", t)] for i, t in enumerate(texts)}


def test_plain_search_first_loses_no_entity_or_period(spark):
    said = {"hdfc  BANK": "HDFC Bank", "the state bank of INDIA": "SBI", "Kotak Bank": "Kotak", "reliance": "Reliance", "reserve bank": "RBI", "hdfc": None, "river bank": None}
    rows = spark.createDataFrame([(t,) for t in said], "text string")
    assert {r.text: r.e for r in rows.select("text", E.entity_of(F.col("text")).alias("e")).collect()} == said
    for name, pattern in E.ENTITIES:
        assert all(n and n == n.lower() for n in E.needles(pattern)), name
    periods = {"in Q1  fy 2024": "Q1 FY24", "h2 FY25": "H2 FY25", "JULY 2023": "JULY 2023", "no period": None}
    rows = spark.createDataFrame([(t,) for t in periods], "text string")
    assert {r.text: r.p for r in rows.select("text", E.period_of(F.col("text")).alias("p")).collect()} == periods


def test_statements_of_one_file_are_read_by_several_tasks(spark):
    assert language.statements(spark, SF_DIR).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_mentions_are_those_of_spark_patterns(spark):
    """What a reader finds in odd texts is what the patterns, run by Spark over whole texts and windows, find."""
    rng = random.Random(3)
    names = ["nim", "gross npa", "net non-performing", "GNPA", "price\rto earnings", "price-to-book", "Rev", "total income", "p/e ratio", "loan book"]
    said = ["HDFC  Bank", "xSBI", "SBÍ", "éSBI", "_RBI", "Reserve Bank", "Kotak Bank", "Q1 FY2024", "fy 26", "Mar'24", "sept 24", "FY204", "éFY24", "4.5%", "-3.2 per cent", "Rs. 5,000 crore", "₹-12 cr", "9bn", "5crown", "(7)", "٣"]
    odd = ["\n", " ", "́", "ſ", "K", "İ", " ", E.MARK, "日本", "and so on " * 15, "x" * 140]
    text = lambda: "".join(rng.choice(rng.choice([names, said, odd])) + rng.choice([" ", " ", "", ". "]) for _ in range(rng.randrange(1, 18)))
    rows = spark.createDataFrame([(i, text()) for i in range(600)] + [(600, None), (601, "")], "id int, text string").cache()
    every = [
        rows.select("id", "text", F.lit(k).alias("k"), F.lit(name).alias("metric"), F.explode(E.places(F.col("text"), f"(?i){pattern}")).alias("p")) for k, (name, pattern, _) in enumerate(E.CLAIM_METRICS)
    ]
    begin = F.greatest(F.col("p.start") - 150, F.lit(0))
    found = reduce(lambda a, b: a.unionByName(b), every).withColumn("window", F.substr("text", begin + 1, F.col("p.end") + 150 - begin))
    number = F.regexp_extract("window", E.NUMBER, 1)
    value, unit = F.replace(number, F.lit(","), F.lit("")).try_cast("double"), E.unit_of(F.regexp_extract("window", E.NUMBER, 2))
    entity = E.entity_of(F.col("window"))
    want = found.filter(value.isNotNull()).select("id", "k", "metric", "p.start", value, unit, entity, F.when(entity.isNull(), E.entity_of(F.col("text"))), F.coalesce(E.period_of(F.col("window")), E.period_of(F.col("text")), F.lit("")))
    want = [(r[0], *r[2:]) for r in sorted(want.collect(), key=lambda r: (r[0], r[1], r[3]))]
    got = [(r.id, *m) for r in rows.collect() for m in E._reader(E.CLAIM_METRICS, 150, 150, False).mentions(r.text or "")]
    assert len(want) > 500 and got == want
    read = rows.select("id", E._mentions(F.col("text"), E.CLAIM_METRICS, after=150).alias("m")).collect()
    assert [(r.id, *m) for r in sorted(read) for m in r.m] == want


def test_conflicts_read_texts_once(spark):
    """Gate, pairs and order are made of the latest claims, which are written once."""
    plan = language.QUERIES["extracted_conflicts"](spark, SF_DIR)._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and "orders.parquet" not in plan


def test_claims_are_sorted_once(spark):
    """Few claims repeat, so that no sort before the exchange helps; those that do, also over rows of one key, count once."""
    plan = language.QUERIES["claim_extraction"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("ArrowEvalPython") == 1
    texts = ["NIM was 4% for SBI. NIM of SBI is 5%", "At SBI NIM is 6%", "NIM of SBI is 7%"]
    rows = spark.createDataFrame([(1, "a", texts[0]), (1, "a", texts[1]), (1, "b", texts[2]), (2, "a", texts[2])], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r.source, r.value) for r in E.claims(rows).collect()) == [(1, "a", 4.0), (1, "b", 7.0), (2, "a", 7.0)]


def test_records_are_grouped_after_one_exchange(spark):
    """Of a metric's values in a record the first by place counts, also over rows of one key."""
    plan = language.QUERIES["record_extraction"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 1
    rows = spark.createDataFrame([(1, "Now NIM is 4% and ROE 9% at SBI"), (1, "NIM is 5% at SBI"), (2, "At SBI NIM is 6%, NIM of FY24 7%")], "doc_id long, text string")
    got = {(r.doc_id, r.entity, r.period): (r.metrics, r.units) for r in E.records(rows).collect()}
    assert got == {(1, "SBI", ""): ({"NIM": 5.0, "ROE": 9.0}, {"NIM": "%", "ROE": "%"}), (2, "SBI", "FY24"): ({"NIM": 6.0}, {"NIM": "%"})}
