"""Dictionary, extraction, questions and requests against plain Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltstone.operators import chunking, extraction, responses, understanding
from siltstone.operators import dictionary as D

from .conftest import SF_DIR
from .test_units import one


def table_of(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/{name}.parquet").select(*columns).collect()]


@pytest.mark.parametrize(("text", "pattern"), [("nim NIM, nim", r"(?i)\bnim\b"), ("no match", "x+"), ("aXbXX", "X"), ("", "x")])
def test_places(spark, text, pattern):
    got = one(spark, extraction.places(F.lit(text), pattern))
    assert [(p.start, p.end) for p in got] == [m.span() for m in re.finditer(pattern, text)]


def test_needles_are_in_every_match():
    said = "Net Interest Margin, gross non-performing, P/E ratio, PE ratio, price to earnings, revenue, rev, total income, market capitalisation, shareholders equity, return on asset"
    for name, pattern, *_ in (*extraction.CLAIM_METRICS, *extraction.RECORD_METRICS):
        assert all(len(n) >= 2 for n in extraction.needles(pattern)), name
        for part, needle in zip(pattern.split("|"), extraction.needles(pattern), strict=True):
            assert all(needle in m.group().lower() for m in re.finditer(f"(?i){part}", said))


def test_claims_of_a_text(spark):
    text = "HDFC Bank's NIM stood at 4.2% for Q3 FY2026, while the gross NPA ratio came to 1.26 per cent"
    rows = spark.createDataFrame([(1, "s", text), (2, "s", None), (3, "s", "nothing of note"), (4, "s", "NIM without a figure")], "doc_id long, source string, text string")
    got = {(r.doc_id, r.metric): (r.value, r.unit, r.entity, r.period, r.is_ratio) for r in extraction.claims(rows).collect()}
    assert got[1, "NIM"] == (4.2, "%", "HDFC Bank", "Q3 FY26", True) and got[1, "GNPA"][0] == 4.2  # the first number around the name
    record = extraction.records(rows).first()
    assert record.metrics == {"NIM": 4.2, "GNPA": 1.26, "NPA": 1.26} and record.units["GNPA"] == "%"  # the number after the name
    wide = extraction.wide_records(extraction.records(rows)).first()
    assert (wide.nim, wide.gnpa, wide.roe) == (4.2, 1.26, None)


def test_dictionary(spark):
    known = D.inserted(D.default(spark), spark.createDataFrame([("npa", "Bad loan $1")], "acronym string, meaning string"))
    assert known.filter("acronym = 'NPA'").first().meaning == "Bad loan $1"
    rows = spark.createDataFrame([(1, "GNPA's share; NPA and NPAs. NPA"), (2, "Net Interest Margin (NIM) and NIM"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.expanded for r in D.expanded(rows, known).collect()}
    assert got[1] == "Gross Non-Performing Assets (GNPA)'s share; Bad loan $1 (NPA) and NPAs. NPA"
    assert got[2] == "Net Interest Margin (NIM) and NIM" and got[3] is None


def test_questions(spark):
    rows = spark.createDataFrame([(1, "NIM NIM and roe of sbi vs axis"), (2, None), (3, "what is the broehm ratio")], "query_id long, text string")
    parsed = {r.query_id: r for r in understanding.parsed(rows).collect()}
    assert parsed[1].metrics == ["nim", "roe"] and parsed[1].entities == ["SBI", "Axis Bank"] and parsed[1].compares
    assert parsed[3].metrics == []
    assert [r.subquery for r in understanding.decomposed(rows).filter("query_id = 1").orderBy("priority").collect()] == ["SBI nim", "Axis Bank nim", "SBI roe", "Axis Bank roe"]


def test_triggered_matches_parts_of_words(spark):
    conditions = spark.createDataFrame([(1, "growth falls below 5 in loans"), (2, "growth in loans")], "condition_id int, condition string")
    chunks = spark.createDataFrame([(1, "Ungrowthy loans", 0.9), (2, "loanstock growth", 0.7), (3, "growth loans", 0.6)], "chunk_id int, text string, score double")
    assert {r.condition_id: r.triggered for r in responses.triggered(conditions, chunks).collect()} == {1: True, 2: False}


def test_short_labels(spark):
    fillers = {"the", "a", "an", "of", "and", "to", "in", "for", "on", "with", "is", "are", "will"}
    got = {r.doc_id: r.label for r in entry.queries()["short_labels"](spark, SF_DIR).collect()}
    for doc_id, text in table_of(spark, "documents", "doc_id", "text"):
        words = [w for w in re.findall(r"[^\W_]+", text) if w.lower() not in fillers][:5]
        want = " ".join(words)[:40]
        assert got[doc_id].casefold() == want.casefold(), doc_id


def test_acronyms_of_the_table(spark):
    got = {r.doc_id: r.acronyms for r in entry.queries()["acronym_detect"](spark, SF_DIR).collect()}
    for doc_id, text in table_of(spark, "documents", "doc_id", "text"):
        found = dict.fromkeys(re.findall(r"\b[A-Z]{2,6}[0-9]{0,4}\b", text))
        want = [a for a in found if a not in ("THE", "AND", "FOR", "NOT", "ARE")][:8]
        assert got[doc_id] == ",".join(want), doc_id


def test_chunks_of_the_table(spark):
    """Chunks have only words of their document, are numbered without gaps, and each is given once."""
    texts = {i: set(t.split()) for i, t in table_of(spark, "documents", "doc_id", "text")}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", F.lit("news").alias("source_type"), "text")
    seen: dict[int, list] = {}
    for r in chunking.chunk_documents(docs).collect():
        assert set(r.text.split()) <= texts[r.doc_id] and r.chars == len(r.text) >= 80 and r.words == len(r.text.split()) >= 20
        seen.setdefault(r.doc_id, []).append((r.chunk_index, r.chunk_hash))
    for found in seen.values():
        assert sorted(i for i, _ in found) == list(range(len(found))) and len({h for _, h in found}) == len(found)


def test_requests_of_the_table(spark):
    def reason(text):
        t = re.sub(r"\s+", " ", text).strip(" ")
        if len(t) < 5:
            return "too short"
        if len(t) > 2000:
            return "too long"
        if len(t.split(" ")) < 2:
            return "one word"
        if sum(ord(c) < 128 for c in t) / len(t) < 0.6:
            return "not ascii"
        if re.search(r"(.)\1{9,}", t):
            return "repeated character"
        if not re.search(r"[^\W_]", t):
            return "only symbols"
        return "only digits" if re.fullmatch(r"[\d\s]+", t) else None

    want = {(c, n): reason(t or "") for c, n, r, t in table_of(spark, "conversations", "conv_id", "turn", "role", "text") if r == "user" and t is not None}
    got = {(r.conv_id, r.turn): r.reason for r in entry.queries()["request_validation"](spark, SF_DIR).collect()}
    assert {k: got[k] for k in want} == want
