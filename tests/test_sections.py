import random
import re

from siltstone.operators import sections as S


def brute(text):
    """By the words: every header is searched for with a pattern in what is left of the text."""
    headers = []
    for line in map(str.strip, text.split("\n")):
        if line and S.is_header(line) and line.lower() not in [h.lower() for h in headers]:
            headers.append(line)
    out, left, name = [], text, ""
    for h in headers:
        m = re.search(r"(?im)(?:^|\n)\s*" + re.escape(h) + r"\s*(?::)?\s*(?:\n|$)", left)
        if m:
            if left[: m.start()].strip():
                out.append((name, left[: m.start()].strip()))
            left, name = left[m.end() :], h
    if left.strip():
        out.append((name, left.strip()))
    return out or [("", text)]


LINES = ["Risk Factors", "RISK FACTORS:", "risk factors", "1. Asset Quality", "2.1 Asset Quality", "Balance Sheet", "Balance Sheet :", "3 Own Title Of A Part", "the bank grew by 4 per cent.", "Plain Words Here", ":", "", "   ", "Outlook for", "12.5", "CSR", "About the company", "A line that Is Long and Ends with a Full Stop, so it is None.", "Annexure", "  Key Ratios  "]


def test_headers():
    assert [x for x in LINES if S.is_header(x.strip())] == ["Risk Factors", "RISK FACTORS:", "1. Asset Quality", "2.1 Asset Quality", "Balance Sheet", "Balance Sheet :", "3 Own Title Of A Part", "CSR", "Annexure", "  Key Ratios  "]


def test_cuts_like_a_search_for_each_header():
    rng = random.Random(2)
    for _ in range(3000):
        text = "\n".join(rng.choice(LINES) for _ in range(rng.randrange(14)))
        assert S.sections(text) == brute(text), text


def test_long_texts_are_read_once():
    text = "\n".join(f"{i} Part Number {i} Of Many\nsome words of it" for i in range(20_000))
    found = S.sections(text)
    assert len(found) == 20_000 and found[7] == ("7 Part Number 7 Of Many", "some words of it")


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "no header"), (4, "no header"), (5, "before\nRisk Factors\nmuch\nCSR\n\nlittle")]
    got = sorted(tuple(r) for r in S.document_sections(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(4, 0, "", "no header")] * 2 + [(5, 0, "", "before"), (5, 1, "Risk Factors", "much"), (5, 2, "CSR", "little")]
