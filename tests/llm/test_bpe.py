import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import bpe, packing, queries
from tests.conftest import SF_DIR

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_multi_50k.tiktoken")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=5))
def test_same_ids_as_the_library_and_a_round_trip(texts):
    own, library = bpe.vocabulary(PATH, public.PATTERN), packing.encoder(PATH)
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    ids, at = own.encode(texts)
    raw, begin = own.decode(ids)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t)
        assert raw[begin[at[i]] : begin[at[i + 1]]].tobytes().decode() == t


def test_long_pieces():
    own, library = bpe.vocabulary(PATH, public.PATTERN), packing.encoder(PATH)
    for t in ("a" * 5000, "qx" * 2000, "日本" * 1500, " " * 4000 + "x"):
        assert own.encode([t])[0].tolist() == library.encode_ordinary(t)


def test_query_on_the_table(spark, duck):
    library = packing.encoder(PATH)
    rows = {r.doc_id: r for r in queries.queries()["op7_byte_bpe"](spark, SF_DIR).collect()}
    for doc_id, text in duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        ids = library.encode_ordinary(text)
        assert (rows[doc_id].n_tokens, rows[doc_id].ids_sha256) == (len(ids), bpe.sha256_of_ids(ids))
        assert rows[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_awkward_rows(awkward, nothing):
    rows = bpe.round_trip(awkward, PATH, public.PATTERN).collect()
    want = sorted((r.doc_id or -1, (r.text or "").encode()) for r in awkward.collect())
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in rows) == want
    assert bpe.round_trip(nothing, PATH, public.PATTERN).count() == 0


def test_forgetting_keeps_results(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 5)
    own, library = bpe.Vocabulary(PATH, public.PATTERN), packing.encoder(PATH)
    for t in ("alpha beta gamma delta", "beta epsilon zetaq etaq thetaq iotaq", "alpha"):
        assert own.encode([t])[0].tolist() == library.encode_ordinary(t)


def test_a_long_run_takes_time_in_proportion():
    import random
    import time

    own, library = bpe.vocabulary(PATH, public.PATTERN), packing.encoder(PATH)
    rng = random.Random(1)
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    for t in (run, run[:3000], "ab" * 3000, "é" * 2500 + "q"):
        assert own.encode([t])[0].tolist() == library.encode_ordinary(t)
    began = time.time()
    own.encode(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))])
    assert time.time() - began < 20
