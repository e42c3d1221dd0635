import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import packing, queries
from tests.conftest import SF_DIR


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=40))
def test_every_piece_has_a_place_of_its_own(histogram):
    placed, n = packing.shortest_pack_first(histogram, 64)
    used = defaultdict(list)
    for length, steps in placed.items():
        starts = [s[0] for s in steps]
        for rank in range(histogram[length]):
            i = max(k for k, s in enumerate(starts) if s <= rank)
            used[steps[i][1] + rank - starts[i]].append((steps[i][2], length))
    assert len(used) == n
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64


def test_query_against_tokenizers(spark, duck):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts = dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    want = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    rows = queries.queries()["op3_shortest_pack_first"](spark, SF_DIR).collect()
    seen, used = defaultdict(int), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        seen[r.doc_id] += r.length
        used[r.sequence_id].append((r.offset, r.length))
    assert seen == {d: len(ids) for d, ids in want.items()}
    for spans in used.values():
        assert [o for o, _ in sorted(spans)] == [sum(x for _, x in sorted(spans)[:i]) for i in range(len(spans))]
        assert sum(x for _, x in spans) <= 2048
    assert sum(seen.values()) / (2048 * len(used)) > 0.97


def test_awkward_rows(awkward, nothing):
    pieces = packing.tokenize(awkward, packing.vocabulary_path("byte_bpe_50k.tiktoken"), size=64)
    packed = packing.assign(pieces, size=64).collect()
    assert len(packed) == pieces.count() and any(r.doc_id == 0 and r.length == 1 for r in packed)
    assert packing.assign(packing.tokenize(nothing, packing.vocabulary_path("byte_bpe_50k.tiktoken"))).count() == 0
    built = packing.sequences(packing.assign(pieces, size=64)).collect()
    assert all(sum(len(p.ids) // 4 for p in s.pieces) == s.used <= 64 for s in built)


def test_special_tokens_are_those_of_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    texts = ["<|endoftext|> hi", "a <|endoftext|>b", "<|endoftext|><|endoftext|>", "x<|endoftext|", "", None]
    want = [[*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.tokenize(docs, packing.vocabulary_path("byte_bpe_50k.tiktoken"), special=packing.special_tokens(path)).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == dict(enumerate(want))


def test_clashing_columns_pass_through(spark):
    names = ["rank", "bucket", "within", "base", "ranks", "sequences", "offsets", "step", "n", "carried", "sequence_id"]
    rows = spark.range(40).selectExpr("id AS doc_id", "0L AS start", "id % 7 + 1 AS length", *[f"concat('{c}', id) AS {c}" for c in names])
    packed = packing.assign(rows, size=16)
    assert packed.columns == [*rows.columns[:-1], "sequence_id", "offset"]
    for r in packed.collect():
        assert all(r[c] == f"{c}{r.doc_id}" for c in names[:-1]) and 0 <= r.offset < 16
