"""Boundary values and invariants of operators on hand-made rows."""

from __future__ import annotations

import datetime as dt
import json
import statistics

import pytest
from pyspark.sql import functions as F

from siltstone.functions import columns as C
from siltstone.operators import checks, chunking, claims, graph, logs, quantiles, scoring, tagging, vector
from siltstone.operators import text as T
from siltstone.sources import feeds
from siltstone.streaming import events as stream


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("age", "want"), [(-5, 1.0), (180, 1.0), (730, 0.05), (731, 0.05), (455, 0.525)])
def test_recency_cosine(spark, age, want):
    day = dt.date(2024, 6, 30) - dt.timedelta(days=age)
    assert one(spark, C.recency_cosine(F.lit(day), F.lit(dt.date(2024, 6, 30)))) == pytest.approx(want)


@pytest.mark.parametrize(("age", "want"), [(0, 1.0), (365, 0.0), (366, 0.0), (-1, 1.0), (73, 0.8)])
def test_recency_linear(spark, age, want):
    day = dt.date(2024, 6, 30) - dt.timedelta(days=age)
    assert one(spark, C.recency_linear(F.lit(day), F.lit(dt.date(2024, 6, 30)))) == pytest.approx(want)


def test_unknown_dates(spark):
    nothing = F.lit(None).cast("date")
    today = F.lit(dt.date(2024, 6, 30))
    assert one(spark, C.recency_cosine(nothing, today)) == 0.4 and one(spark, C.recency_linear(nothing, today)) == 0.5


@pytest.mark.parametrize(("text", "want"), [("2024-02-03", "2024-02-03"), ("03/02/2024", "2024-02-03"), ("3 Feb 2024", "2024-02-03"), ("2024-02", "2024-02-01"), ("2024", "2024-01-01"), ("on 2024-02-03 at", "2024-02-03"), ("soon", None), ("2024-13-45", None)])
def test_lenient_date(spark, text, want):
    got = one(spark, C.lenient_date(F.lit(text)))
    assert (str(got) if got else None) == want


def claim_rows(spark, *values, ratio=False):
    days = [dt.date(2024, 1, 1 + i) for i in range(len(values))]
    rows = [(i, "nim", "Bank", "Q1 FY2026", f"s{i}", "news", v, days[i], ratio) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "claim_id long, metric string, entity string, period string, source string, source_type string, value double, day date, is_ratio boolean")


@pytest.mark.parametrize(("a", "b", "ratio", "conflict", "severity"), [(100.0, 105.1266, False, False, "Minor"), (100.0, 105.13, False, True, "Moderate"), (100.0, 122.5, False, True, "Major"), (0.0, 0.0, False, False, "Minor"), (-100.0, -120.0, False, True, "Moderate"), (50.0, 50.5, True, False, "Minor"), (50.0, 50.51, True, True, "Minor")])
def test_conflicts(spark, a, b, ratio, conflict, severity):
    r = claims.compared(claims.pairs(claims.keyed(claim_rows(spark, a, b, ratio=ratio)))).first()
    assert (r.is_conflict, r.severity, r.period) == (conflict, severity, "q1 fy26")


def test_signed_mean_hides_negative_conflicts(spark):
    assert not claims.compared(claims.pairs(claim_rows(spark, -100.0, -120.0)), signed_mean=True).first().is_conflict


def test_resolution(spark):
    r = claims.conflicts(claim_rows(spark, 1.0, 2.0, 4.0)).first()
    assert (r.winner, r.reason) == ("B", "newer: B")


def test_conflicts_need_three_sources_in_all(spark):
    assert claims.conflicts(claim_rows(spark, 1.0, 2.0)).count() == 0
    assert claims.conflicts(claim_rows(spark, 1.0, 2.0, 1.0)).count() == 2


def test_outliers(spark):
    rows = lambda g, *vs: [(g, float(v)) for v in vs]
    data = rows("few", 1, 1, 99) + rows("flat", 5, 5, 5, 5, 5) + rows("spread", 1, 2, 3, 4, 5, 100) + rows("nomad", 5, 5, 5, 5, 5, 5, 5, 50)
    got = checks.outliers(spark.createDataFrame(data, "g string, v double"), "g", "v").collect()
    assert {(r.g, r.v) for r in got} == {("spread", 100.0), ("nomad", 50.0)}


def test_strength_boundaries(spark):
    rows = [("a", "macro", 7), ("b", "macro", 4), ("c", "macro", 3), ("d", "demand", 10), ("d", "regulatory", 1)]
    got = {r.t: (r.weighted_strength, r.strength) for r in scoring.strength(spark.createDataFrame(rows, "t string, dimension string, score int"), "t").collect()}
    assert got == {"a": ("Medium", "Weak"), "b": ("Medium", "Medium"), "c": ("Strong", "Strong"), "d": ("Medium", "Medium")}
    assert scoring.strength(spark.createDataFrame(rows, "t string, dimension string, score int"), "t").filter("t = 'd'").first().weighted == round(14 / 2.3, 4)


def test_heuristic_risk_rounds_half_to_even(spark):
    assert one(spark, scoring.heuristic_risk(F.lit(0.5), F.lit(0))) == 5  # 4.5 to 4, plus 1


def test_context_budget_stops_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([("q", 1, "aaa"), ("q", 2, "bbbbbb"), ("q", 3, "c")], "k string, rank int, text string")
    assert [r.rank for r in scoring.context_budget(df, 5, "k").collect()] == [1]


def test_coverage(spark):
    subs = spark.createDataFrame([(1, 1, ["a", "b", "c", "d"]), (1, 2, ["x"]), (2, 3, ["a"])], "query_id int, subquery_id int, tokens array<string>")
    chunks = spark.createDataFrame([(1, 0.9, ["a", "b"]), (1, 0.1, ["x"])], "query_id int, score double, words array<string>")
    assert {r.subquery_id: r.covered for r in scoring.coverage(subs, chunks).collect()} == {1: True, 2: False, 3: False}


def test_graph(spark):
    nodes = spark.createDataFrame([(1, []), (2, [1, 2, 9]), (3, [2]), (4, [5]), (5, [4]), (6, [5])], "node int, depends_on array<int>")
    arcs = graph.edges(nodes)
    assert {(r.src, r.dst) for r in arcs.collect()} == {(1, 2), (2, 3), (4, 5), (5, 4), (5, 6)}
    assert {r.node: r.level for r in graph.levels(nodes, arcs).collect()} == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None}
    assert {r.node: r.cycle_length for r in graph.cycles(arcs).collect()} == {4: 2, 5: 2}


def test_long_chains_and_cycles(spark):
    """No length is fixed: a chain of 90 nodes with short cuts, and a cycle of 12 beside it."""
    chain = spark.createDataFrame([(i, [i - 1, i // 2] if i else []) for i in range(90)], "node int, depends_on array<int>")
    found = {r.node: r for r in graph.critical_path(chain, graph.edges(chain)).collect()}
    assert len(found) == 90 and found[89].n_nodes == 90 and found[89].path == ">".join(map(str, range(90)))
    ring = spark.createDataFrame([(i, [(i + 1) % 12]) for i in range(12)] + [(12, [0]), (13, [])], "node int, depends_on array<int>")
    assert {r.node: r.cycle_length for r in graph.cycles(graph.edges(ring)).collect()} == dict.fromkeys(range(12), 12)


def test_longest_path_takes_the_smallest_of_equals(spark):
    nodes = spark.createDataFrame([(1, []), (2, [1]), (3, [1]), (4, [3, 2]), (5, [])], "node int, depends_on array<int>")
    found = {r.node: (r.n_nodes, r.path) for r in graph.critical_path(nodes, graph.edges(nodes)).collect()}
    assert found == {1: (1, "1"), 2: (2, "1>2"), 3: (2, "1>3"), 4: (3, "1>2>4")}


@pytest.mark.parametrize("buckets, crowded", [(4096, 1_000_000), (3, 40)])
def test_exact_places(spark, monkeypatch, buckets, crowded):
    """Against sorting, with ties, nulls, infinities, and a key that has most of the rows; once with few buckets, which are cut again and again."""
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    monkeypatch.setattr(quantiles, "CROWDED", crowded)
    import random

    rng = random.Random(2)
    rows = [("big" if i % 10 else f"k{i % 70}", rng.choice([rng.random(), 0.5, -3.0, None, rng.choice([1e300, -1e300, float("inf"), float("-inf"), 7.0])])) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, v double")
    places = {"p50": lambda n: F.floor(n * 0.5), "p99": lambda n: F.floor(n * 0.99), "first": lambda n: F.lit(0)}
    got = {r.k: (r.n, r.p50, r.p99, r.first) for r in quantiles.values_at(df, "k", "v", places).collect()}
    for k in {k for k, _ in rows}:
        v = sorted(x for key, x in rows if key == k and x is not None)
        assert got[k] == (len(v), v[int(len(v) * 0.5)], v[int(len(v) * 0.99)], v[0])
    for r in quantiles.medians(df, "k", "v").collect():
        assert r.median == pytest.approx(statistics.median(x for key, x in rows if key == r.k and x is not None))


def test_unit_pairs_are_all_found(spark):
    rows = [("m", "e", "p", "crore", 500.0), ("m", "e", "p", "crore", 5.0), ("m", "e", "p", "lakh", 400.0), ("m", "e", "p", "lakh", 400.0)]
    got = checks.unit_mismatch(spark.createDataFrame(rows, "metric string, entity string, period string, unit string, value double")).collect()
    assert [(r.value_a, r.value_b, r.n_pairs) for r in got] == [(500.0, 400.0, 2)]


def test_spaced_capitals(spark):
    import re

    for raw in ("A B C D and E F G", "É A B C", "a A B C d", "A B C D E F G H I", "X Y Z."):
        want = re.sub(r"\b([A-Z])\s([A-Z])\s([A-Z])\b", r"\1\2\3", re.sub(r"\b([A-Z])\s([A-Z])\s([A-Z])\s([A-Z])\b", r"\1\2\3\4", raw))
        assert one(spark, T.cleaned(F.lit(raw))) == want


def test_term_overlaps(spark):
    """Against comparing every pair."""
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, rng.sample(words, rng.randint(0, 20))) for i in range(60)]
    items = [(i, rng.sample(words, rng.randint(1, 9))) for i in range(12)]
    want = {(i, d) for i, q in items for d, w in docs if len(set(q) & set(w)) / len(q) >= 0.5}
    got = T.term_overlaps(spark.createDataFrame(docs, "doc_id int, words array<string>"), spark.createDataFrame(items, "item_id int, terms array<string>"), 0.5)
    assert {(r.item_id, r.doc_id) for r in got.collect()} == want


def test_chunks_cover_the_text_and_overlap():
    text = " ".join(f"Sentence number {i} has a few plain words in it." for i in range(120))
    found = chunking.chunks(text, 600, 120)
    assert all(len(c) <= 700 for c in found) and all(s in " ".join(found) for s in chunking.sentences(text))
    assert found[0].split(". ")[-1] in found[1]


def test_sentences_and_tables():
    assert chunking.sentences("Acme Ltd. Grew by four. It rose. then fell. Q3. Was good.") == ["Acme Ltd. Grew by four.", "It rose. then fell.", "Q3. Was good."]
    table = "\n".join(f"row {i} | {i}" for i in range(60))
    assert table in chunking.chunks(f"Words before the table that are long enough to stay in a chunk of their own, surely.\n\n{table}", 300, 0)


def test_chunks_of_awkward_texts(spark):
    docs = spark.createDataFrame([(1, "news", None), (2, None, ""), (3, "rbi", "word " * 100), (4, "news", "x" * 5000)], "doc_id long, source_type string, text string")
    assert {r.doc_id for r in chunking.chunk_documents(docs).collect()} == {3}


def test_request_checks(spark):
    texts = {"ok text here": None, "hey": "too short", "onewordonly": "one word", "aaaaaaaaaa bbb": "repeated character", "aaaaaaaaa bbb": None, "12 34 56": "only digits", "!? !? !?": "only symbols", "ééé ééé ééa": "not ascii"}
    rows = T.request_checks(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r.text: r.reason for r in rows} == texts


def test_figures_like_each_pattern_tried(spark):
    """The plain words pass over no text that a pattern matches, whatever the case, folded letters too."""
    import random
    import re

    from siltstone.operators import tags

    def tried(text):
        found = {}
        for name, pattern, low, high in tags.FIGURES:
            match = re.search(f"(?i){pattern}", text or "")
            said = next((g for g in match.groups() if g is not None), None) if match else None
            if said is not None and low <= float(said.replace(",", "")) <= high:
                found[name] = round(float(said.replace(",", "")), 4)
        return found

    rng = random.Random(2)
    words = sorted({w for _, p, _, _ in tags.FIGURES for w in re.findall(r"[a-z]{2,}", re.sub(r"\\[a-zA-Z]", " ", p))} | {"p/e ratio", "net interest margin", "tier i ratio", "R\u017f", "repo rate", "return on a\u017fset\u017f", "n\u0130m", "t\u0131er-i ratio"})
    part = lambda: rng.choice([rng.choice(words), rng.choice(words).upper(), f"{rng.randrange(100)}.{rng.randrange(10)}%", f"{rng.randrange(1000)} crore", "12x fy24", "of", "4.5 billion"])
    texts = [None, "", *(" ".join(part() for _ in range(rng.randrange(2, 9))) for _ in range(4_000))]
    assert sum(tags.stated_figures(t) != {} for t in texts) > 200
    assert [tags.stated_figures(t) for t in texts] == [tried(t) for t in texts]
    assert set(tags.FIGURE_WORDS) == {name for name, *_ in tags.FIGURES}
    rows = spark.createDataFrame([(i, texts[i % 50]) for i in range(150)], "i long, t string")
    from pyspark.sql import functions as F

    assert {r.i: r.f for r in rows.select("i", tags.figures(F.col("t")).alias("f")).collect()} == {i: tried(texts[i % 50]) for i in range(150)}


def test_groups_with_sources_are_counted_after_one_exchange(spark, tmp_path):
    """Tasks that count grow in number with those that read; one constant key brings no second exchange, and null sources count as claims only."""
    from pyspark.sql import functions as F

    from siltstone.operators import claims as M

    spark.range(4_000, numPartitions=6).withColumn("v", F.col("id") % 50).write.parquet(f"{tmp_path}/t")
    rows = spark.read.option("maxPartitionBytes", 1).parquet(f"{tmp_path}/t")
    claims = rows.select(F.lit("M").alias("metric"), F.col("v").cast("string").alias("entity"), F.lit("p").alias("period"), F.when(F.col("id") % 5 > 0, F.concat(F.lit(" S"), F.col("id") % 3)).alias("source"))
    found = M.groups_with_sources(claims, 3)
    got = {r.entity: (r.metric, r.period, r.n_sources, r.n_claims) for r in found.collect()}
    assert got == {str(v): ("M", "p", 3, 80) for v in range(50) if v % 5}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]
    assert M.spread_far(claims, "entity").rdd.getNumPartitions() >= 8 * claims.rdd.getNumPartitions()


def test_ingest_cleans_on_arrow_columns(spark):
    """No text goes through the replacements one by one in Spark's expressions."""
    from siltstone.plans import jobs

    docs = spark.createDataFrame([(1, "Growth \u2014 of the bank is well. " * 40, "news", "2024-01-01")], "doc_id long, text string, source_type string, doc_date string")
    found = jobs.ingest(docs)
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() > 0 and found.filter("contains(text, '\u2014')").count() == 0


def test_ingest_joins_no_texts(spark, tmp_path):
    """Texts are cut in the tasks that read them, so that no copies meet in one; each row's chunks count once, though an id comes twice."""
    import datetime

    from siltstone.plans import jobs

    said = {k: " ".join(f"Line {i} of the {k} report says that growth of the bank is well above that of {i} others. " for i in range(n)) for k, n in (("first", 40), ("second", 9), ("third", 25))}
    kinds = ("rbi", "news", "blog", "annual_report", None)
    texts = [said["first"], said["second"], said["first"], None, "short", said["third"], said["first"], said["second"] + "\u2014", *[said["third"]] * 12]
    rows = [(i, t, kinds[i % 5], datetime.date(2024, 1, 1)) for i, t in enumerate(texts)] + [(5, said["second"], "news", None), (None, said["first"], "rbi", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source_type string, doc_date date").repartition(8).write.parquet(f"{tmp_path}/d")
    docs = spark.read.option("maxPartitionBytes", 1).parquet(f"{tmp_path}/d")
    found = jobs.ingest(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInPandas") :].split("Aggregate")[0]
    assert "Join" not in below and "Repartition" not in below

    want: dict[str, list] = {}
    for i, t, kind, _ in rows:
        if i is None or len(t or "") < 50:
            continue
        cut = [c for c in dict.fromkeys(chunking.chunks(t.replace("\u2014", "-").strip(), *chunking.lexicon.CHUNK_SIZES[kind or "unknown"])) if len(c.split()) >= 20]
        later = any(u == t and j is not None and j < i for j, u, _, _ in rows)
        want.setdefault(chunking.lexicon.NAMESPACES.get(kind, "default"), []).extend((i, len(c), later) for c in cut)
    got = {r.namespace: tuple(r)[1:] for r in jobs.audit(found).collect()}
    assert got == {n: (len({i for i, _, _ in w}), len(w), sum(c for _, c, _ in w), len({i for i, _, later in w if later})) for n, w in want.items()}
    assert found.columns == "doc_id chunk_index chunk_id text chars words chunk_hash source_type doc_date is_duplicate namespace quarter fiscal_year".split()


def test_sentences_of_many_initials():
    """A split that was none costs by its last word, not by all that was joined before."""
    import time

    began = time.perf_counter()
    assert chunking.sentences("A. " * 60_000 + "It ends here.") == ["A. " * 60_000 + "It ends here."]
    assert time.perf_counter() - began < 5


def test_cleaned_like_its_sql(spark, duck):
    """Odd texts as the SQL has them, letters that fold to ASCII and marks after letters too; in one pass of Arrow columns, not one of Spark's for each pattern."""
    import random

    from pyspark.sql import functions as F
    from siltstone.plans.texts import _clean_sql

    rng = random.Random(5)
    parts = ["a", "1", " ", "\t", "\n", "-\n", "-", "___", "**", "A B C", " A B C D ", "e\u0301", "\u00a0", "\x0b", "\x85", "\r\n", "• x", "“q”", "12345", "Page 3 of 4", "all right\u017f reserved", "12", "é", "\u2028", "word"]
    texts = [None, "", "x", "12", "ab\ncd", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(1_500))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    cleaned = rows.select("i", T.cleaned(F.col("t")).alias("t"))
    import pyarrow as pa

    odd = pa.table({"i": range(len(texts)), "t": texts})  # noqa: F841
    want = duck.sql(f"SELECT i, {_clean_sql('t')} FROM (SELECT i, coalesce(t, '') AS t FROM odd)").fetchall()
    assert {r.i: r.t for r in cleaned.collect()} == dict(want)
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 0


def test_cleaned(spark):
    raw = "bank-\ning grew 4%\n\n\n\nPage 3 of 9\nAB\n12\nH D F C said – fine___\n"
    assert one(spark, T.cleaned(F.lit(raw))) == "banking grew 4%\n\nHDFC said - fine"


def test_acronyms(spark):
    df = spark.createDataFrame([(1, "THE GNPA and NIM26 beat NIM; XYZ too")], "doc_id long, text string")
    known = spark.createDataFrame([("GNPA", "gross npa"), ("NIM", "net interest margin")], "acronym string, meaning string")
    got = {r.acronym: r.meaning for r in tagging.expanded_acronyms(df, known).collect()}
    assert got == {"GNPA": "gross npa", "NIM26": "net interest margin", "NIM": "net interest margin"}
    assert one(spark, tagging.with_acronyms(F.lit("a NIM b NIM"), F.lit("NIM"), F.lit("margin"))) == "a NIM (margin) b NIM"


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "vec_id int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "vec_id int, v string, version int")
    both = vector.upsert(old, new)
    assert {(r.vec_id, r.v) for r in both.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {r.vec_id for r in vector.delete(both, new).collect()} == {1}


def test_breaker(spark):
    outcomes = [True, True, False, False, False, True, False]
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=25 * i)
    df = spark.createDataFrame([("k", i, at(i), f) for i, f in enumerate(outcomes)], "k string, i int, ts timestamp, failed boolean")
    for span in ("1 hour", "10 days"):
        r = logs.breaker(df, "k", F.col("failed"), ["i"], trip=2, rest=3, span=span).first()
        assert (r.state, r.trips, r.refused) == ("OPEN", 2, 4)


def test_streams(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), "k", i % 4 != 0) for i in range(12)]
    for i in range(3):  # three files, a batch each
        spark.createDataFrame(rows[4 * i : 4 * i + 4], "event_id long, ts timestamp, k string, failed boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    source = stream.event_stream(spark, f"{tmp_path}/events.parquet", spark.read.parquet(f"{tmp_path}/events.parquet").schema, "*.parquet", files_per_trigger=1)
    got = {r.window_start.minute: r.n for r in stream.run_available(stream.rate_windows(source, "k", 300), "complete").collect()}
    assert got == {0: 5, 5: 5, 10: 2}
    last = stream.run_available(stream.breaker_states(source, "k", 3), "update", ["k"]).collect()
    assert [(r.failures_in_row, r.trips, r.open) for r in last] == [(3, 3, True)]
    assert [r.k for r in stream.run_available(stream.once_within(source, ["k"])).collect()] == ["k"]


def test_feeds(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"title": "T", "content": " ", "url": "u", "date": None, "source": "s"}))
    assert feeds.json_articles(spark, str(tmp_path / "a.json")).first().text == "T\n\nu\n\ns"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("hello\nthere")
    (tmp_path / "in" / "y.bin").write_text("no")
    assert [r.text for r in feeds.text_files(spark, str(tmp_path / "in")).collect()] == ["hello\nthere"]
    items = "".join(f"<item><title>Rate {i}</title><link>http://x/{i}</link><pubDate>{d}</pubDate></item>" for i, d in enumerate(["Mon, 01 Jan 2024 10:00:00 +0000", "Sat, 01 Jan 2022 10:00:00 +0000", ""]))
    (tmp_path / "feed.xml").write_text(f"<rss><channel>{items}<item><title>no link</title></item></channel></rss>")
    rss = feeds.rss_items(spark, str(tmp_path / "feed.xml"))
    cutoff = F.lit("2023-06-01").cast("timestamp")
    assert {r.link for r in feeds.fresh_items(rss, cutoff).collect()} == {"http://x/0", "http://x/2"}
    seen = rss.select(F.md5("link").alias("url_hash")).limit(1)
    assert {r.link for r in feeds.fresh_items(rss, cutoff, ("rate",), seen).collect()} == {"http://x/2"}


def test_heuristic_risk_of_means_next_to_a_half(spark):
    """Means whose nine-fold distance to 1 is a half but for the last digits."""
    halves = [(k, 1 - (k + 0.5) / 9) for k in range(9)]
    found = spark.createDataFrame(halves, "k int, c double").select("k", scoring.heuristic_risk(F.col("c"), F.lit(0)).alias("r")).collect()
    assert {r.k: r.r for r in found} == {k: round(k + 0.5) + 1 for k in range(9)}
