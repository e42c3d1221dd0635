import base64
import hashlib
import struct

from siltstone.llm import queries, spotsigs
from tests.conftest import SF_DIR


def test_edits_and_neighbours(spark, duck):
    rows = {r.doc_id: r for r in queries.queries()["op2_spotsigs"](spark, SF_DIR).collect()}
    texts = duck.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    assert len(rows) == len(texts)
    for i, (doc_id, text) in enumerate(texts):
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[(i + 1) % len(texts)][1][:half]
        assert rows[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[doc_id].n_chars == len(text) and 0 <= rows[doc_id].near_edited <= 1
    by_text = {}
    for doc_id, text in texts:
        assert by_text.setdefault(text, rows[doc_id].fingerprint) == rows[doc_id].fingerprint
    assert len(set(by_text.values())) > 0.99 * len(by_text)  # texts that differ outside every chain share theirs
    assert all(c.isalnum() or c in '+/=' for f in by_text.values() for c in f)


def test_signatures_by_hand(spark):
    df = spark.createDataFrame([("The quick fox of a red house",), ("quick fox",)], "text string")
    first, second = [r.sigs for r in spotsigs.with_signatures(df, "text", "sigs").collect()]
    want = spark.sql("SELECT array_sort(array(hash('the', 'quick', 'fox'), hash('of', 'red', 'house'), hash('a', 'red', 'house'))) AS s").first().s
    assert first == want and len(second) == 1


def test_likeness_is_jaccard_and_pruned_by_length(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1, 2, 3, 4], [3, 4, 5, 6]), ([1], [1, 2, 3, 4, 5])], "a array<int>, b array<int>")
    assert [r.x for r in df.select(spotsigs.likeness(F.col("a"), F.col("b")).alias("x")).collect()] == [2 / 6, 0.2]
    assert [r.x for r in df.select(spotsigs.likeness(F.col("a"), F.col("b"), 0.75).alias("x")).collect()][1] == 0.0


def test_next_across_buckets(spark):
    ids = [*range(0, 40), 10**12, 10**12 + 5, -(10**15)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    old = spotsigs._fences.__defaults__
    try:
        spotsigs._fences.__defaults__ = (4, 4096)
        got = {r.doc_id: r.next_text for r in spotsigs.with_next(df, ["text"]).collect()}
    finally:
        spotsigs._fences.__defaults__ = old
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_awkward_rows(awkward, nothing):
    rows = spotsigs.compare_with_edits(awkward).collect()
    assert len(rows) == awkward.count()
    one, two = [r.fingerprint for r in rows if r.doc_id in (6, 7)][:2]
    assert one == two
    assert spotsigs.compare_with_edits(nothing).count() == 0


def test_clashing_columns_pass_through(spark):
    names = ["ord", "tie", "bucket", "tail", "own", "place", "row", "following", "sigs_lines"]
    df = spark.range(30).selectExpr("id AS doc_id", "concat('t', id) AS text", *[f"concat('{c}', id) AS {c}" for c in names])
    got = spotsigs.with_next(df, ["text"])
    assert got.columns == ["doc_id", "text", *names, "next_text"]
    for r in got.collect():
        assert r.next_text == f"t{(r.doc_id + 1) % 30}" and all(r[c] == f"{c}{r.doc_id}" for c in names)


def test_likenesses_of_the_table(spark, duck):
    """Both likenesses of every row are the Jaccard of the fingerprints, read back from their text."""
    rows = {r.doc_id: r for r in queries.queries()["op2_spotsigs"](spark, SF_DIR).collect()}

    def read(fingerprint):
        raw = base64.b64decode(fingerprint)
        return set(struct.unpack(f">{len(raw) // 4}I", raw))

    ids = sorted(rows)
    for i, doc_id in enumerate(ids):
        r, following = rows[doc_id], rows[ids[(i + 1) % len(ids)]]
        for one, two, got in ((r.fingerprint, r.edited_fingerprint, r.near_edited), (r.fingerprint, following.fingerprint, r.near_next)):
            a, b = read(one), read(two)
            assert abs(got - len(a & b) / len(a | b)) < 1e-12, doc_id
