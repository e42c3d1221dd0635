"""Names, shared words and sections against plain Python."""

import random
import re

import pytest

from siltstone.operators import companies as N
from siltstone.operators import overlap as O
from siltstone.plans import structure as P

from .conftest import SF_DIR
from .test_sections import brute as cut_by_search


def pattern(phrase):
    words = re.escape(phrase.strip("*")).replace(r"\ ", r"\s+")
    return ("" if phrase.startswith("*") else r"\b") + words + ("" if phrase.endswith("*") else r"\b")


def plain(text):
    """By trying each pattern, the first company first; then counting each keyword."""
    found = [i for i, (_, _, phrases) in enumerate(N.COMPANIES) if any(re.search(pattern(p), text, re.I) for p in phrases.split("|"))]
    scores = {s: sum(w in text.lower() for w in words.split("|")) for s, words in N.SECTORS.items()}
    best = max(scores, key=lambda s: scores[s])
    company, sector = N.COMPANIES[found[0]][:2] if found else (None, best if scores[best] >= 2 else None)
    return company, sector, len(found)


def test_companies_like_each_pattern_tried(spark):
    rng = random.Random(1)
    names = [p.strip("*") for _, _, phrases in N.COMPANIES for p in phrases.split("|")] + [w for words in N.SECTORS.values() for w in words.split("|")]
    texts = []
    for _ in range(600):
        parts = [rng.choice([rng.choice(names), rng.choice(names).upper(), rng.choice("xyz_9é"), "the", "\n", "bank"]) for _ in range(rng.randrange(8))]
        texts.append(rng.choice(["", " ", "  ", " \t"]).join(parts))
    texts += ["HDFC\n Bank and LIC", "xlife insurance corporationx", "jios", "Nestlé  India", None, "", "npa and deposit"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.company, r.sector, r.n_companies) for r in N.company_and_sector(rows).collect()}
    assert got == {i: plain(t or "") for i, t in enumerate(texts)}


def test_overlapping_phrases_and_no_phrases(spark):
    rows = spark.createDataFrame([(1, "a  b c"), (2, "b"), (3, None)], "doc_id long, text string")
    phrases = spark.createDataFrame([("a b", 4), ("b c", 2), ("b", 9), ("a b c", 1), ("", 5)], "phrase string, number int")
    assert {r.doc_id: r.hits for r in N.phrase_hits(rows, phrases).collect()} == {1: [1, 2, 4, 9], 2: [9]}
    assert N.phrase_hits(rows, phrases.filter("false")).count() == 0


@pytest.mark.parametrize("least", [1, 3, 5])
def test_shared_words_equal_all_pairs(spark, least):
    rng = random.Random(least)
    words = [f"w{i}" for i in range(60)]
    made = lambda n: [(i, [words[min(59, int(rng.paretovariate(0.4)) - 1)] for _ in range(rng.randrange(14))]) for i in range(n)]
    left, right = made(60), made(80)
    frame = lambda rows: spark.createDataFrame([*rows, (None, words), (999, None)], "id long, words array<string>")
    want = {(i, j): len(set(a) & set(b)) for i, a in left for j, b in right if len(set(a) & set(b)) >= least}
    assert {(r.left_id, r.right_id): r.shared for r in O.sharing(frame(left), frame(right), least).collect()} == want


@pytest.mark.parametrize("rows", [7, 10_000])
def test_firsts_without_pairs(spark, monkeypatch, rows):
    """Against all pairs, with repeated ids, many blocks and one; and no pairs are made."""
    monkeypatch.setattr(O, "LEFT_ROWS", rows)
    monkeypatch.setattr(O, "RIGHT_ROWS", rows)
    monkeypatch.setattr(O, "sharing", None)
    rng = random.Random(rows)
    words = [f"w{i}" for i in range(40)]
    said = lambda: rng.sample(words, rng.randrange(9)) + ["zz"]
    theses = [(i // 2 if i < 10 else i, said()) for i in range(60)]
    events = [(rng.randrange(5), i, said()) for i in rng.sample(range(80), 80)] + [(3, 900 + i, words) for i in range(30)]
    want = {}
    for i, a in theses:
        for title, first, b in events:
            if (n := len(set(a) & set(b))) >= 3:
                want[i, title] = min(want.get((i, title), (first, n)), (first, n))
    left = spark.createDataFrame(theses, "id long, words array<string>")
    right = spark.createDataFrame(events, "title long, first long, words array<string>")
    got = O.first_sharing(left, right).collect()
    assert len(got) == len(want) > 50 and {(r.id, r.title): (r.first, r.shared) for r in got} == want
    assert O.first_sharing(left, right.filter("false")).count() == O.first_sharing(left.filter("false"), right).count() == 0


def test_only_firsts_leave_a_group(spark, monkeypatch, tmp_path):
    """Of thirty passages of a title that a thesis shares words with one leaves the task; few theses meet many titles; batches are small."""
    import uuid

    import pyarrow as pa

    real, folder = O._firsts, str(tmp_path)

    def counted(least, names):
        run = real(least, names)

        def go(left, right):
            out = run(left, right)
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(out.num_rows))
            return out

        return go

    monkeypatch.setattr(O, "_firsts", counted)
    monkeypatch.setattr(O, "FOUND_ROWS", 100, raising=False)
    words = [f"w{i}" for i in range(12)]
    left = spark.createDataFrame([(i, words[:6]) for i in range(200)], "id long, words array<string>")
    right = spark.createDataFrame([(t, t * 100 + k, [*words[:4], f"x{t} {k}"]) for t in range(20) for k in range(30)], "title long, first long, words array<string>")
    got = {(r.id, r.title): (r.first, r.shared) for r in O.first_sharing(left, right).collect()}
    assert got == {(i, t): (t * 100, 4) for i in range(200) for t in range(20)}
    sent = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(sent) == len(got) and max(sent) < 500

    monkeypatch.setattr(O, "SENT", 10)
    tables = [pa.table({"id": list(range(40)), "words": [words] * 40}), pa.table({"title": [1, 2], "first": [5, 6], "words": [words] * 2, "nth": [1, 2], "group": [1, 2]})]
    out = real(3, ["id", "title", "first", "shared"])(*tables)
    assert out.num_rows == 80 and max(b.num_rows for b in out.to_batches()) <= 10


def test_sections_of_the_numbered_documents(spark):
    """Against a search for each header, and nothing lost: sections and headers together are the text."""
    import hashlib

    texts = {r.doc_id: r.text for r in P.numbered(spark, SF_DIR).collect()}
    got = {}
    for r in P.QUERIES["document_sections"](spark, SF_DIR).collect():
        got.setdefault(r.doc_id, []).append((r.n, r.section, r.n_chars, r.text_sha256))
    some = 0
    for doc_id, text in texts.items():
        if len(text) > 30_000 or not text.strip():
            continue
        want = cut_by_search(text)
        some += len(want) > 2
        assert [(n, s, len(t), hashlib.sha256(t.encode()).hexdigest()) for n, (s, t) in enumerate(want)] == sorted(got[doc_id])
    assert some > 50


def test_chunks_keep_to_sections(spark):
    """Each chunk is one of those of its own section alone."""
    from siltstone.operators import chunking, sections

    texts = {r.doc_id: r.text for r in P.numbered(spark, SF_DIR).limit(60).collect()}
    rows = spark.createDataFrame([(i, "annual_report", t) for i, t in texts.items()] + [(-1, "annual_report", None)], "doc_id long, source_type string, text string")
    got = chunking.chunk_documents(rows, by_section=True).collect()
    assert len(got) > 60 and {r.section == "" for r in got} >= {False}
    for r in got:
        assert r.text in {c for name, part in sections.sections(texts[r.doc_id]) if name == r.section for c in chunking.chunks(part, 1200, 200)}
