import zlib

from siltstone.llm import queries, sharding
from tests.conftest import SF_DIR


def check(rows, texts, shards, slack):
    """The law: every row once, near-equal bytes, slots without gaps, equal texts side by side."""
    assert len(rows) == len(texts)
    sizes, slots, by_shard = [0] * shards, {}, {}
    for r in rows:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        by_shard.setdefault(r.shard, []).append((r.slot, r.text_crc32))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    share = sum(sizes) / shards
    assert max(abs(s - share) for s in sizes) <= slack, (share, sizes)
    for rows_ in by_shard.values():
        crcs = [c for _, c in sorted(rows_)]
        assert sum(a != b for a, b in zip(crcs, crcs[1:], strict=False)) == len(set(crcs)) - 1


def test_query_on_the_table(spark, duck):
    texts = duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    rows = queries.queries()["op10_histogram_sort"](spark, SF_DIR).collect()
    want = {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == want
    check(rows, texts, 40, 2 * max(s for s, _ in want.values()))


def test_a_group_of_copies_is_cut(spark):
    docs = [(i, "the same text in a third of all rows" if i % 3 == 0 else f"text number {i} " * (i % 7)) for i in range(3000)]
    rows = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string"), shards=10).collect()
    check(rows, docs, 10, 400)
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}" * (i % 9)) for i in range(500)], "doc_id long, text string")
    sharding.write_shards(docs, f"{tmp_path}/out", shards=5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 500 and back.select("shard").distinct().count() == 5


def test_awkward_rows(awkward, nothing):
    rows = sharding.assign(awkward, shards=3).collect()
    assert len(rows) == awkward.count() and all(r.source in (None, "src1", "s") for r in rows)
    assert sharding.assign(nothing).count() == 0


def test_clashing_columns_pass_through(spark):
    names = ["key", "rank", "first", "leaf", "rows", "id", "carried", "own text", "n", "b"]
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('x', int(id)) AS text", *[f"concat('{c}', id) AS `{c}`" for c in names], "'old' AS law")
    out = sharding.assign(docs, shards=4)
    assert out.columns == ["doc_id", *names, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in names)


def test_a_hot_range_without_a_boundary_is_split(spark):
    """A text of many copies that lies within one shard is counted in many ranges, so no task sorts all of them."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'one hot text', concat('other ', id)) AS text")
    light = docs.select(sharding.sort_key(docs.text, docs.doc_id).alias("key"), sharding.size_of(docs.text).alias("size"))
    _, splits = sharding.find_splitters(light, 2)
    leaves = light.filter(docs.text == "one hot text").select(sharding._leaf(splits).alias("leaf")).distinct().count()
    assert leaves > 100


def test_repeats_of_one_row_are_cut_like_other_copies(spark):
    docs = [(7, "the same row in a third of all rows, id and text") if i % 3 == 0 else (i, f"text number {i} " * (i % 7)) for i in range(6000)]
    rows = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string"), shards=20).collect()
    check(rows, docs, 20, 500)
