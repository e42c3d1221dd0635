"""Small tables with every awkward row: nulls, empty, long, tied and repeated, and columns with clashing names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, score double, sid long, offset long"


def awkward_texts() -> list[str | None]:
    rng = random.Random(3)
    words = ["the", "of", "und", "der", "alpha", "beta", "gamma", "delta", "epsilon", "idiot"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(n))
    base = prose(150)
    near = base.split()
    near[70] = "changed"
    return [
        None, "", "   \n\t ", "one", "one two three", "ONE two Three", base, base, " ".join(near), prose(60), prose(20_000),
        "x" * 50_000, "a.b@c.de, call +1 (415) 555-0101 or 10.0.0.1 card 4111 1111 1111 1111", "naïve café 日本語 🙂 text " * 9, "word " * 300, "line one here\n" * 20, "### assistant: </turn> \\ <end>",
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else "src1", len(t or ""), 1, "k", 0.5, 7, 3) for i, t in enumerate(awkward_texts())]
    rows += [rows[6], (None, "no id at all, but five words", "en", "s", 1, 1, "k", 0.5, 7, 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
