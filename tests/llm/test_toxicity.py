import random
import zlib

from siltstone.llm import queries, toxicity
from tests.conftest import SF_DIR


def corpus(n=600):
    rng = random.Random(1)
    syllables = ["ba", "ren", "tol", "mi", "sa", "ker", "un", "dor"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(1, len(w) // 40)):
                w.insert(rng.randrange(len(w)), rng.choice(["vilewort", "hagface"]) + rng.choice(["", "s", "ba"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_on_planted_words(spark):
    docs, labels = corpus()
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(d, toxicity.learn(d, m)).collect()}
    held = [(scores[i], t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(scores) == len(docs) and all(0 <= s <= 1 for s in scores.values())
    assert sum((s >= 0.3) == bool(t) for s, t in held) / len(held) > 0.95


def test_query_on_the_table(spark, duck):
    rows = queries.queries()["op5_kneser_ney_toxicity"](spark, SF_DIR).collect()
    labels = dict(duck.sql("SELECT doc_id, toxic FROM labels").fetchall())
    assert len(rows) == len(duck.sql("SELECT doc_id FROM documents").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == t for p, t in held) / len(held) > 0.85


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    one, two = (toxicity.learn(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert (one.weights == two.weights).all()


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(6, 0), (6, 1), (8, 0), (9, None), (None, 1), (10, 0), (14, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.learn(awkward, labels)
    rows = toxicity.score(awkward, model, keep_text=True)
    assert rows.count() == awkward.count() and all(0 <= r.score <= 1 for r in rows.collect())
    assert toxicity.score(nothing, model).count() == 0
    kept = toxicity.ordinary(awkward, model, 1.1)
    assert kept.columns == awkward.columns and {r.score for r in kept.collect()} == {0.5}
    assert not toxicity.learn(awkward, labels.filter("false")).trained
    assert {r.score for r in toxicity.score(awkward, toxicity.learn(nothing, labels)).collect()} == {0.0}


def brute_force(train, texts):
    """Evidence of every word of ``texts`` by the formulas, in plain Python over strings."""
    import collections
    import math
    import string

    def words(text):
        for c in string.punctuation:
            text = text.replace(c, " ")
        found, before = [], ""
        for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split():
            found.append((before, w))
            before = w[-1]
        return found

    def stem(w):
        return w[:4] if len(w) > 4 else None

    models = []
    for part in (lambda w: w, stem):
        pair, word, history, after = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
        followed, seen, total = collections.defaultdict(set), collections.defaultdict(set), collections.Counter()
        for text, c in train:
            for h, w in words(text):
                e = part(w)
                if e is not None:
                    pair[h, e, c] += 1
                    word[e, c] += 1
                    history[h, c] += 1
                    total[c] += 1
                    after[e].add(h)
                    followed[h, c].add(e)
                    seen[c].add(e)
        both = lambda counts: collections.Counter(sum((collections.Counter({k[:-1]: n}) for k, n in counts.items()), collections.Counter()).values())
        d = []
        for counts in (word, pair):
            times = both(counts)
            d.append(min(max(times[1] / max(times[1] + 2 * times[2], 1), 0.3), 0.95))
        places = sum(map(len, after.values())) + 0.5 * (len(after) + 1)

        def p(h, e, c, d=d, pair=pair, word=word, history=history, after=after, followed=followed, seen=seen, total=total, places=places):
            low = max(word[e, c] - d[0], 0) / total[c] + d[0] * len(seen[c]) / total[c] * (len(after[e]) + 0.5) / places
            if not history[h, c]:
                return low
            return max(pair[h, e, c] - d[1], 0) / history[h, c] + d[1] * len(followed[h, c]) / history[h, c] * low

        models.append((part, p))
    out = []
    for text in texts:
        row = []
        for h, w in words(text):
            parts = [math.log(p(h, e, 1)) - math.log(p(h, e, 0)) for part, p in models if (e := part(w)) is not None]
            row.append(sum(parts) / len(parts))
        out.append(row)
    return out


def test_evidence_is_that_of_the_formulas(spark, monkeypatch):
    """Over many ranges and blocks, against plain Python."""
    import numpy as np

    docs, labels = corpus(160)
    docs = [(i, t.replace(" ba ", ", BA: ")) for i, t in docs]
    monkeypatch.setattr(toxicity, "RANGE_BYTES", 2_000)
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 3_000)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    kept = [(t, c) for (i, t), (_, c) in zip(docs, labels, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2]
    want = brute_force(kept, [t for _, t in docs])
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert len(model.table.collect()) > 10
    for (i, _), x in zip(docs, want, strict=True):
        features = [np.mean(x), sum(sorted(x)[-toxicity.TOP :]) / toxicity.TOP, np.mean(np.array(x) > toxicity.CLEAR)]
        assert np.allclose([got[i][c] for c in toxicity.FEATURES], features, atol=1e-4), i


def test_own_counts_are_left_out_of_the_fit(spark):
    """A training text's evidence is that of a model that never saw it, but for histories and weights."""
    import numpy as np

    docs, labels = corpus(60)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = spark.createDataFrame([("hagface once more hagface", 1), ("hagface once more hagface", 0)], "text string, toxic int")
    own = toxicity.with_features(rows, model, ["toxic"], "toxic").collect()
    assert all(np.isfinite([r[c] for c in toxicity.FEATURES]).all() for r in own)
    assert own[0].top_evidence != own[1].top_evidence


def test_model_grows_with_the_texts(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9))) for _ in range(300))
    sizes = []
    for n in (40, 160):
        d = spark.createDataFrame([(i, text()) for i in range(n)], "doc_id long, text string")
        model = toxicity.learn(d, spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int"))
        sizes.append(sum(len(toxicity.loaded(r.data)[0]) for r in model.table.collect()))
    assert sizes[1] > 3 * sizes[0]
