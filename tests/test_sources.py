"""Readers, writers and tags on hand-made files and rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import tags
from siltstone.sources import feeds

from .test_units import one


def test_mixed_batch_keeps_the_order(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"title": "T", "content": "c", "url": "u", "date": None, "source": "s"}))
    (tmp_path / "b.txt").write_text("plain")
    got = feeds.mixed_batch(spark, [("text", str(tmp_path / "b.txt")), ("json", str(tmp_path / "a.json"))]).orderBy("place").collect()
    assert [(r.kind, r.text) for r in got] == [("text", "plain"), ("json", "T\n\nc\n\nu\n\ns")]


def test_listing_rows(spark):
    html = """<ul><li><a class="x" href="/r/2021/a.pdf">Report <b>2021</b></a><a href='/r/2021/a.pdf'>again</a><a href="/n">News</a></ul>"""
    got = {r.url: (r.title, r.year, r.out_of_range) for r in feeds.listing_rows(spark.createDataFrame([(1, html)], "page_id int, html string"), (2022, 2024)).collect()}
    assert got == {"/r/2021/a.pdf": ("Report 2021", 2021, True), "/n": ("News", None, False)}


@pytest.mark.parametrize(("hrefs", "want"), [(["/x.html", "b.pdf", "/annual.pdf"], "https://h.org/annual.pdf"), (["b.pdf?v=1"], "https://h.org/d/b.pdf?v=1"), (["//c.org/z.PDF"], "https://c.org/z.PDF"), (["x.html"], None)])
def test_resolved_link(spark, hrefs, want):
    assert one(spark, feeds.resolved_link(F.array(*[F.lit(h) for h in hrefs]), F.lit("https://h.org/d/page?q=1"))) == want


def test_articles_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "u2")], "title string, url string")
    known = rows.filter("url = 'u1'").select(F.md5("url").alias("url_hash"))
    feeds.write_new_articles(rows, f"{tmp_path}/out", known)
    assert [r.url for r in spark.read.json(f"{tmp_path}/out").collect()] == ["u2"]
    feeds.write_logs(spark.createDataFrame([("audit", 1), ("error", 2)], "log_type string, n int"), f"{tmp_path}/logs")
    assert {r.log_type for r in spark.read.parquet(f"{tmp_path}/logs").collect()} == {"audit", "error"}


def test_cached_vectors(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b "), (3, "b"), (4, None)], "id int, text string")
    cache = spark.createDataFrame([("a", [1.0])], "t string, embedding array<double>").select(F.md5(F.col("t").cast("binary")).alias("text_hash"), "embedding")
    have, need = tags.cached_vectors(texts, cache)
    assert [r.id for r in have.collect()] == [1] and sorted(r.text or "" for r in need.collect()) == ["", "b"]


def test_explained(spark):
    line = one(spark, tags.explained(F.lit(1), F.lit(0.5), F.lit("rbi"), F.lit(1.0), F.lit(0.25)))
    assert line == "#1: similarity 0.50, rbi (authority 1.5), recency 1.00, term overlap 0.25"


RSS = """<rss><channel><title>C</title><item><title>One &amp; <![CDATA[two <b>x</b>]]></title><link>http://a/1</link><pubDate>Mon, 1 Jan 2024 10:00:00 +0000</pubDate></item>
<item><title>No link</title></item><item><title>Again</title><link> http://a/1 </link></item><item><title>B</title><link>http://a/2</link><description>d</description></item></channel></rss>"""
ATOM = """<feed><entry><title type="html">Three</title><link rel="self" href="http://a/self"/><link rel="alternate" href="http://a/3?x=1&amp;y=2"/><updated>2024-01-02T00:00:00Z</updated><summary>s</summary></entry>
<entry><title>B too</title><link href='http://a/2'/></entry></feed>"""


def test_feed_items_of_both_kinds(spark):
    from siltstone.sources import streams

    rows = streams.feed_items(spark.createDataFrame([("r", RSS), ("a", ATOM), ("n", None), ("e", "")], "path string, content string")).collect()
    assert sorted((r.path, r.n, r.title, r.link, r.published, r.description) for r in rows) == [
        ("a", 0, "Three", "http://a/3?x=1&y=2", "2024-01-02T00:00:00Z", "s"), ("a", 1, "B too", "http://a/2", None, None), ("r", 0, "One & two x", "http://a/1", "Mon, 1 Jan 2024 10:00:00 +0000", None),
        ("r", 2, "Again", "http://a/1", None, None), ("r", 3, "B", "http://a/2", None, "d"),
    ]


def test_items_come_once_over_two_runs(spark, tmp_path):
    from siltstone.sources import streams

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(RSS)
    take = lambda: {(r.link, r.title, r.batch) for r in streams.each_once(streams.feed_items(streams.feed_files(spark, f"{tmp_path}/in")), f"{tmp_path}/out", ["path", "n"]).collect()}
    first = {("http://a/1", "One & two x", 0), ("http://a/2", "B", 0)}
    assert take() == first and take() == first
    (tmp_path / "in" / "b.xml").write_text(ATOM)
    assert take() == first | {("http://a/3?x=1&y=2", "Three", 1)}


def test_links_stream_from_a_folder_of_files_and_from_none(spark, tmp_path):
    from siltstone.plans import structure
    from siltstone.sources import streams

    pages = spark.createDataFrame([(i, f'<a href="http://a/{i % 3}">') for i in range(9)], "page_id long, html string")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert {(r.link, r.page_id) for r in structure.streamed_links(spark, str(tmp_path)).collect()} == {(f"http://a/{i}", i) for i in range(3)}
    pages.filter("false").coalesce(1).write.parquet(f"{tmp_path}/empty/pages.parquet")
    assert structure.streamed_links(spark, f"{tmp_path}/empty").collect() == []
    (tmp_path / "in").mkdir()
    assert streams.each_once(streams.feed_items(streams.feed_files(spark, f"{tmp_path}/in")), f"{tmp_path}/out", ["path", "n"]).collect() == []
