import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import pii, queries
from tests.conftest import SF_DIR

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The base rules as they are written, by Python's own search."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 14 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1239.@+-() _%", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_linear_on_hostile_texts():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 100_000, "a@" * 100_000, "+1" * 100_000):
        pii.base_spans(text)


def test_query_on_the_table(spark, duck):
    got = {r.doc_id: r for r in queries.queries()["op1_weak_supervision_pii"](spark, SF_DIR).collect()}
    texts = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(texts)
    for doc_id, text in texts:
        base = [f"{k}:{a}:{b}" for k, a, b in plain_spans(text)]
        assert got[doc_id].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[doc_id].spans.split(",")) | {""}
        assert got[doc_id].n_email == sum(b.startswith("email") for b in base)


def test_labelers_that_agree_are_believed():
    good, bad = ("secret", (1, 1, 1, 1, 1)), ("secret", (-1, -1, 0, -1, -1))
    code = lambda kind, v: __import__("functools").reduce(lambda c, x: c * 3 + x + 1, v, pii.KINDS.index(kind) * 3 + 1)
    counts = {code(*good): 50, code(*bad): 50}
    p = pii.train(counts, pii.estimate(counts))
    assert p[code(*good)] > 0.8 > 0.2 > p[code(*bad)]


def test_added_spans_and_masking():
    text = "see password=abc123def456ghi and a@b.co"
    base, spans = pii.spans_of(text, frozenset({pii.pattern_code(text, s, False) for s in pii.proposed_spans(text, pii.base_spans(text))}))
    assert [s[0] for s in spans] == ["secret", "email"] and [s[0] for s in base] == ["email"]
    assert pii.masked_text(text, spans) == "see password=[SECRET] and [EMAIL]"


def test_awkward_rows(spark, awkward, nothing):
    accepted = pii.learn(awkward)
    found = {(r.doc_id, len(r.spans)) for r in pii.find(awkward, accepted).collect()}
    assert (0, 0) in found and (12, 4) in found and pii.find(awkward, accepted).count() == awkward.count()
    masked = {r.doc_id: r for r in pii.mask(awkward, accepted).collect()}
    assert masked[0].text is None and masked[12].text == "[EMAIL], call [PHONE] or [IP] card [CARD]" and masked[12].key == "k"
    assert pii.find(nothing, pii.learn(nothing)).count() == 0
