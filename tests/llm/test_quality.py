import collections
import re

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import quality, queries
from tests.conftest import SF_DIR


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = list(zip(w, w[1:], w[2:], strict=False))
    counts = collections.Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if counts[t] > 1 for k in range(3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


def test_query_on_the_table(spark, duck):
    rows = {r.doc_id: r for r in queries.queries()["op6_divergence_rules"](spark, SF_DIR).collect()}
    for doc_id, text in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        r, want = rows[doc_id], base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    marks = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    good = [r.kept for i, r in rows.items() if marks.get(i) == 1 and not r.base_failed]
    junk = [r.kept for i, r in rows.items() if marks.get(i) == 0 and not r.base_failed]
    assert np.mean(good) > 0.97 and np.mean(junk) < 0.1


def test_distance_against_numpy(spark):
    from pyspark.sql import functions as F

    p, q = np.array([5, 0, 3, 2]), np.array([0.1, 0.4, 0.5, 0.0])
    m = (p / 10 + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    df = spark.createDataFrame([(p.tolist(), q.tolist())], "c array<long>, r array<double>")
    got = df.select(quality.js_distance(F.col("c"), F.lit(10), F.col("r")).alias("d")).first().d
    assert abs(got - np.sqrt((kl(p / 10) + kl(q)) / 2)) < 1e-12


def test_awkward_rows(awkward, nothing):
    rows = {r.doc_id: r for r in quality.judged(awkward.drop("sid")).collect()}
    for i, text in ((r.doc_id, r.text) for r in awkward.collect()):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text)
    assert rows[0].base_failed and not rows[0].kept and rows[6].key == "k"
    clash = awkward.withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(-1))
    assert {(r.kept, r.n_words) for r in quality.passing(clash).collect()} <= {("mine", -1)}
    assert quality.judged(nothing).count() == 0 and quality.passing(nothing).columns == nothing.columns


def test_a_language_is_judged_alike_whatever_its_share(spark, monkeypatch):
    """English under a hundredth of all characters, beside a large language: by its own reference, literal, broadcast or joined; a language with too little text passes."""
    import random

    rng = random.Random(4)
    prose = lambda common, rest: " ".join(rng.choice(common if rng.random() < 0.5 else rest) for _ in range(150))
    english, german, made = quality.REFERENCE_WORDS[:40], "der die und das von zu mit sich auf ein eine nicht".split(), [a + b for a in ("tar", "mol", "ven", "ris") for b in ("ka", "do", "lin")]
    rows = [(i, prose(english, made), "en") for i in range(40)]
    rows += [(100 + i, prose(made, made).upper(), "xx") for i in range(3)]
    rows += [(200 + i, " ".join(rng.choice(german) + " " + rng.choice(made) for _ in range(8_000)), "de") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for candidates, most in ((200, quality.MOST_BROADCAST), (1, quality.MOST_BROADCAST), (1, 0)):
        monkeypatch.setattr(quality, "MOST_CANDIDATES", candidates)
        monkeypatch.setattr(quality, "MOST_BROADCAST", most)
        got = {r.doc_id: r for r in quality.judged(docs).collect()}
        sound = [r for r in got.values() if not r.base_failed]
        assert len(got) == len(rows) and len(sound) > 40 and all(r.kept for r in sound if r.lang != "xx")
        assert all(got[i].kept and got[i].common_distance < 0.45 for i in range(40))
        assert all(got[i].kept == (not got[i].base_failed) for i in range(100, 103))
        assert any(got[i].class_distance > 0.16 and got[i].kept for i in range(100, 103))
    kept = {r.doc_id for r in quality.passing(docs).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_a_wrong_tag_costs_nothing_whatever_the_share_of_the_true_language(spark):
    rng = __import__("random").Random(4)
    prose = lambda common, rest: " ".join(rng.choice(common if rng.random() < 0.5 else rest) for _ in range(150))
    english, german, made = quality.REFERENCE_WORDS[:40], "der die und das von zu mit sich auf ein eine nicht".split(), [a + b for a in ("tar", "mol", "ven", "ris") for b in ("ka", "do", "lin")]
    rows = [(i, prose(english, made), "en" if i < 40 else "de") for i in range(45)]
    rows += [(200 + i, " ".join(rng.choice(german) + " " + rng.choice(made) for _ in range(8_000)), "de") for i in range(50)]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.kept == (not r.base_failed) for r in got) and sum(r.kept for r in got if 40 <= r.doc_id < 45) >= 3


def plain_verdicts(docs):
    """(class_distance, common_distance, kept) of each (id, lang, text), by the docstring, in plain Python."""
    common = list(dict.fromkeys(quality.REFERENCE_WORDS))

    def histograms(text):
        kinds = [0] * 8
        for c in text:
            if c >= "\x80":
                kinds[7] += 1
            elif c.isalpha():
                kinds[0 if c.islower() else 1] += 1
            elif c.isdigit():
                kinds[2] += 1
            elif c in " \t\n\x0b\f\r":
                kinds[3] += 1
            else:
                kinds[4 if c in ".,;:'\"-()?" else 5 if c in "#*$%&|<>" else 6] += 1
        found = collections.Counter(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[a-zA-Z\x80-\U0010ffff]+", text))
        known = [found[w] for w in common]
        return np.array(kinds), np.array([*known, sum(found.values()) - sum(known)])

    def distance(p, q):
        p = p / max(p.sum(), 1)
        m = (p + q) / 2
        part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
        return np.sqrt(max(0, (part(p) + part(q)) / 2))

    rows = {i: (lang, *histograms(text or ""), base(text)) for i, lang, text in docs}
    failed = {i: s[0] < 50 or 100 * s[4] > 50 * s[0] for i, (_, _, _, s) in rows.items()}

    def learned(ids):
        sums = {}
        for i in ids:
            lang, k, c, _ = rows[i]
            a = sums.setdefault(lang, [0, 0, 0])
            a[0], a[1], a[2] = a[0] + k, a[1] + c, a[2] + 1
        enough = {x: (k / k.sum(), c / c.sum()) for x, (k, c, n) in sums.items() if k.sum() >= quality.ENOUGH_CHARS and n >= quality.ENOUGH_DOCS}
        return enough

    def distances(i, refs):
        lang, k, c, _ = rows[i]
        return min(distance(k, r[0]) for r in refs.values()), min(distance(c, r[1]) for r in refs.values())

    sound = [i for i in rows if not failed[i]]
    first = learned(sound)
    refs = learned([i for i in sound if round(distances(i, first)[0], 6) <= 0.2])
    out = {}
    for i, (lang, k, c, _) in rows.items():
        d = distances(i, refs)
        far = (k.sum() >= 200 and round(d[0], 6) > 0.16) or (c.sum() >= 50 and round(d[1], 6) > 0.45)
        out[i] = (*d, not failed[i] and not (far and lang in refs))
    return out


def test_distances_and_verdicts_of_the_table(spark, duck):
    want = plain_verdicts(duck.sql("SELECT doc_id, lang, text FROM documents").fetchall())
    rows = queries.queries()["op6_divergence_rules"](spark, SF_DIR).collect()
    assert len(rows) == len(want)
    for r in rows:
        a, b, kept = want[r.doc_id]
        assert abs(r.class_distance - a) < 2e-6 and abs(r.common_distance - b) < 2e-6 and r.kept == kept, r.doc_id
