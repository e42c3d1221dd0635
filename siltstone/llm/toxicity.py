"""Toxicity by class-conditional Kneser-Ney models of words and their stems.

Words are runs of the normalised text (ASCII lower case; white space and ASCII punctuation part
them); a stem is the first STEM bytes of a longer word, so that an unseen form of a known word still
says something. A word's history is the ending (last byte) of the word before it in the text, 0 for the
first: endings stand for the grammatical classes of words, so that histories stay few and are seen
often. For each class, toxic and ordinary, and for words and stems w alike, there is a conditional
model with two steps back:

    P(w | h, class) = max(count(h w, class) - D2, 0) / count(h, class) + weight(h, class) * P(w | class)
    P(w | class)    = max(count(w, class) - D1, 0) / count(class) + weight(class) * shared(w)

with absolute discounts D1 and D2 from how many words and pairs were seen once and twice, weights
that give back just what the discounts took, and the Kneser-Ney continuation distribution
``shared``: after how many different histories w stands in all training texts of both classes. A
word rare in both classes so counts alike in both. The evidence of a word is the difference of its
log-likelihoods, log P(w | h, toxic) - log P(w | h, ordinary), and has the stem's averaged in if
there is one. A text's evidence is compared by
length: its mean over all words, its mean over the TOP words that speak most for toxic, and the
share of words with clear evidence. The second grows with the length of any text, as the highest of more words are higher; so it counts
by how far it lies above what chance gives at the text's length, a line in the logarithm of the number of words, fitted to the
ordinary texts of the sample. A logistic function of these three gives the score.

Counts come from every labelled training text and are exact: each pair of word and history has its
count in each class (words by 55-bit hashes). They are written as a table that grows with the
corpus, dealt by ranges of hashes. To score, texts are packed into blocks; the distinct pairs of
each block meet the table range by range, and their evidence goes back to the block, where the
texts wait as numbers of pairs. A task holds one range of the table and one block, whatever the size
of either side. Only the logistic function is fitted on a bounded sample: about ``fit_rows``
training rows, chosen by a hash of their id, each scored with its own counts taken out.

Blocks are formed twice from the same rows, once to ask and once to wait for the answers, so ``docs``
should be rows that come in the same order each time, as those of a table do; where an order has
changed the step fails, and never mixes answers up.

Defined results: null and empty texts have no evidence and get the score of none; repeated rows
score alike; if an id has several labels, it is toxic if one of them says so; a label without a
text, or a null label, is not used; without any labels of both classes every score is 0; an
empty table gives an empty result; other columns pass through ``score`` unless they bear the
names of its results.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stage, tucked, untucked
from .textnum import U, WHITE, runs, slices, span_hashes

RANGE_BYTES = 32 << 20  # training text for each range of the table
BLOCK_BYTES = 16 << 20
MOST_HELD = 2_000_000  # pairs that a counting task gathers before it makes equal ones one
MOST_SENT = 2_000_000  # labels that are sent to every executor at most
STEM = 4
TOP = 3
CLEAR = 3.0
TOXIC = 0.3  # the score from which a document counts as toxic
FEATURES = ("mean_evidence", "top_evidence", "clear_share")
EVIDENCE = (*FEATURES, "evidence_words")


def _normal_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[WHITE] = 32
    table[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 32
    return table


NORMAL = _normal_table()


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised texts in a row, each with a leading space, and len + 1 offsets."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, 32, np.uint8)
    of_byte = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(data)) + of_byte + 1] = NORMAL[data]
    at = offsets + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[at[:-1]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], total[at]


def pairs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key of each word with its history, in order, that of its stem (0 for none), and their per-text index (len + 1).

    The low byte of a key is the history, the next bit is set for stems.
    """
    norm, at = normalised(data, offsets)
    starts, ends, first = runs(norm != 32, at)
    history = np.zeros(len(starts), U)
    history[1:] = norm[ends[:-1] - 1]
    history[first[:-1][first[:-1] < len(starts)]] = 0
    stems = (span_hashes(norm, starts, np.minimum(starts + STEM, ends)) & ~U(511)) | U(256) | history
    return (span_hashes(norm, starts, ends) & ~U(511)) | history, np.where(ends - starts > STEM, stems, U(0)), first


def dumped(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, the first bytes of all items together, then the second ones and so on."""
    planes = lambda a: np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return pickle.dumps([(a.dtype.str, len(a), pa.compress(planes(a), "zstd", asbytes=True) if len(a) else b"") for a in arrays])


def loaded(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, packed in pickle.loads(data):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(pa.decompress(packed, n * size, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n))
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences; ``np.cumsum`` gives the keys again."""
    return np.diff(keys, prepend=U(0))


def gathered(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the same key made one, ``counts`` (2, n) by sum; keys ascend."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[:, order], first, axis=1)


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return gathered(*(np.concatenate(x, axis=-1) for x in zip(*parts, strict=True)))


def words_in(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From sorted pairs: the words, their counts in both classes, and how many histories each has."""
    word = keys >> U(8)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    return word[first], np.add.reduceat(counts, first, axis=1), np.diff(np.concatenate((first, [len(word)])))


class Ranges:
    """Equal ranges of hashes; they deal the work out and have no part in the results."""

    def __init__(self, number: int):
        self.bounds = np.array([(i << 64) // number for i in range(1, number)], U) & ~U(511)  # a word's pairs stay together

    def split(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The number of each range that has some of the sorted keys, and where they lie."""
        cut = np.concatenate(([0], np.searchsorted(keys, self.bounds, "left"), [len(keys)]))
        for i in np.flatnonzero(np.diff(cut)):
            yield int(i), slice(int(cut[i]), int(cut[i + 1]))


#: Places in a kind's totals: ten sums, then for each history its counts and numbers of words by class.
WORDS, PAIRS, WORDS_ONCE, WORDS_TWICE, PAIRS_ONCE, PAIRS_TWICE, COUNT, SEEN = 0, 1, 2, 3, 4, 5, 6, 8
HISTORIES = 10
SIZE = HISTORIES + 4 * 256


def kind_of(keys: np.ndarray) -> np.ndarray:
    """0 for words, 1 for stems."""
    return ((keys >> U(8)) & U(1)).astype(np.int64)


def totals_of(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The totals of words, then those of stems."""
    return np.concatenate([_totals_of(keys[of], counts[:, of]) for of in (kind_of(keys) == 0, kind_of(keys) == 1)])


def _totals_of(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(SIZE, np.int64)
    history = (keys & U(255)).astype(np.int64)
    _, of_words, _ = words_in(keys, counts)
    both = (of_words.sum(0), counts.sum(0))
    sums = [of_words.shape[1], len(keys), *((x == n).sum() for x in both for n in (1, 2)), *counts.sum(1), *(of_words > 0).sum(1)]
    by_history = [np.bincount(history, x, 256) for x in (counts[0], counts[1], counts[0] > 0, counts[1] > 0)]
    return np.concatenate((sums, *by_history)).astype(np.int64)


def count(train: DataFrame, ranges: Ranges) -> DataFrame:
    """The table of counts over all rows of ``train`` (text, toxic), a row for each range, with its totals."""

    def passed_on(parts: list) -> Iterator[pa.RecordBatch]:
        if parts:
            keys, counts = joined(parts)
            for bucket, at in ranges.split(keys):
                data = dumped(steps(keys[at]), *counts[:, at].astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "data"])
        parts.clear()

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                keys, stems, first = pairs_of(data, offsets)
                if not len(keys):
                    continue
                toxic = np.repeat(np.array(part.column("toxic").to_pylist(), np.int64), np.diff(first))
                keys, toxic = np.concatenate((keys, stems[stems > 0])), np.concatenate((toxic, toxic[stems > 0]))
                held.append(gathered(keys, np.stack((toxic == 0, toxic == 1)).astype(np.int64)))
                size += len(held[-1][0])
                if size > MOST_HELD:
                    held = [joined(held)]
                    size = len(held[0][0])
                    if size > MOST_HELD // 2:
                        yield from passed_on(held)
                        size = 0
        yield from passed_on(held)

    def row(bucket: int, parts: list) -> pa.RecordBatch:
        keys, counts = joined(parts)
        arrays = [pa.array([bucket], pa.int32()), pa.array([totals_of(keys, counts)], pa.list_(pa.int64())), pa.array([dumped(steps(keys), *counts)], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["bucket", "totals", "data"])

    def of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, size = None, [], 0
        for batch in batches:
            for b, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
                if b != bucket and parts:
                    yield row(bucket, parts)
                    parts, size = [], 0
                delta, *counts = loaded(data.as_py())
                bucket = b
                parts.append((np.cumsum(delta, dtype=U), np.stack(counts).astype(np.int64)))
                size += len(delta)
                if size > MOST_HELD:
                    parts = [joined(parts)]
                    size = 0
        if parts:
            yield row(bucket, parts)

    rows = train.select("text", "toxic").mapInArrow(of_texts, "bucket int, data binary").repartition("bucket").sortWithinPartitions("bucket")
    return stage(rows.mapInArrow(of_ranges, "bucket int, totals array<long>, data binary"), "toxicity-counts")


class Known:
    """What the table says of the pairs that are asked for: counts of the pair and of the word by class, and the word's histories."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.words, self.of_words, self.histories = words_in(keys, counts) if len(keys) else (keys, counts, np.zeros(0, np.int64))

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """Five rows: counts of the pair (ordinary, toxic), of the word (the same), and the number of its histories."""
        out = np.zeros((5, len(wanted)), np.int64)
        for rows, known, asked, values in ((slice(0, 2), self.keys, wanted, self.counts), (slice(2, 5), self.words, wanted >> U(8), np.vstack((self.of_words, self.histories)))):
            if len(known):
                place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                out[rows] = np.where(known[place] == asked, values[:, place], 0)
        return out


class Model:
    """The table of counts, the totals, and the logistic function."""

    def __init__(self, table: DataFrame, ranges: Ranges):
        self.table, self.ranges = table, ranges
        total = np.zeros(2 * SIZE, np.int64)
        for place, n in table.select(F.posexplode("totals")).groupBy("pos").agg(F.sum("col")).collect():  # as many rows as there are totals
            total[place] = n
        total = total.reshape(2, SIZE)  # words, stems
        self.d1, self.d2 = (np.clip(total[:, a] / np.maximum(total[:, a] + 2 * total[:, b], 1), 0.3, 0.95) for a, b in ((WORDS_ONCE, WORDS_TWICE), (PAIRS_ONCE, PAIRS_TWICE)))
        self.count = total[:, COUNT : COUNT + 2]
        self.weight = np.where(self.count > 0, self.d1[:, None] * total[:, SEEN : SEEN + 2] / np.maximum(self.count, 1), 1.0)
        by_history = total[:, HISTORIES:].reshape(2, 4, 256)
        self.of_history = by_history[:, :2]
        self.history_weight = np.where(self.of_history > 0, self.d2[:, None, None] * by_history[:, 2:] / np.maximum(self.of_history, 1), 1.0)
        self.places = total[:, PAIRS] + 0.5 * (total[:, WORDS] + 1)  # one place more for all words that were not seen
        self.weights = np.array([-4.0, 1.0, 4.0, 1.0])
        self.chance = (0.0, 0.0)  # of the top evidence: at no words, and for each unit of log(1 + words)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def likelihoods(self, keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        """P(word | history, class) for ordinary and toxic, from the five rows of ``Known.of``."""
        history, kind = (keys & U(255)).astype(np.int64), kind_of(keys)
        shared = (known[4] + 0.5) / self.places[kind]
        out = []
        for c in (0, 1):
            word = np.maximum(known[2 + c] - self.d1[kind], 0) / np.maximum(self.count[kind, c], 1) + self.weight[kind, c] * shared
            out.append(np.maximum(known[c] - self.d2[kind], 0) / np.maximum(self.of_history[kind, c, history], 1) + self.history_weight[kind, c, history] * word)
        return np.stack(out)

    def evidence(self, keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        ordinary, toxic = np.log(self.likelihoods(keys, known))
        return toxic - ordinary

    @property
    def trained(self) -> bool:
        return bool(self.count[0].min() > 0)

    def fit(self, features: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> None:
        """The line of chance by least squares over ordinary texts; logistic regression by Newton's method with halved steps, drawn towards the starting weights."""
        size = np.log1p(features[:, 3])
        away = size[toxic == 0] - size[toxic == 0].mean()
        slope = float(away @ features[toxic == 0, 1] / max(away @ away, 1e-9)) if len(away) > 2 else 0.0
        self.chance = float(features[toxic == 0, 1].mean() - slope * size[toxic == 0].mean()), slope
        features = features[:, :3] - np.outer(self.chance[0] + self.chance[1] * size, [0.0, 1.0, 0.0])
        x = np.concatenate((np.ones((len(features), 1)), features * SCALE), 1)
        prior, w = self.weights, self.weights.copy()
        loss = lambda v: np.logaddexp(0, x @ v).sum() - toxic @ (x @ v) + ridge / 2 * ((v - prior) ** 2).sum()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (p - toxic) + ridge * (w - prior)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
            rate = 1.0
            while rate > 1e-6 and loss(w - rate * step) > loss(w):
                rate /= 2
            w = w - rate * step
            if np.abs(rate * step).max() < 1e-6:
                break
        self.weights = w


def features_of(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row for each text from the evidence of its words: the mean, the mean of the TOP highest (missing ones count 0), the share of clear ones, their number."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((-value, text))
    rank = np.arange(len(value)) - np.repeat(first[:-1], n)
    sums = lambda x, at: np.bincount(at, x, len(n))
    top = rank < TOP
    per = np.maximum(n, 1)
    return np.stack((sums(value, text) / per, sums(value[order][top], text[top]) / TOP, sums(value > CLEAR, text) / per, n.astype(float)), 1)


SCALE = np.array([10.0, 1.0, 50.0])


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Block:
    """The words of some rows as numbers of distinct pairs, with the stem of each."""

    def __init__(self, rows: pa.RecordBatch):
        pairs, stems, counts = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(1, np.int64)]
        for _, data, offsets in slices(rows, "text"):
            found, stem, first = pairs_of(data, offsets)
            pairs.append(found)
            stems.append(stem)
            counts.append(np.diff(first))
        self.first = np.cumsum(np.concatenate(counts))
        self.pairs, at, self.number = np.unique(np.concatenate(pairs), return_index=True, return_inverse=True)
        self.stems = np.concatenate(stems)[at]
        self.asked = np.unique(np.concatenate((self.pairs, self.stems[self.stems > 0])))

    def arrays(self) -> list[np.ndarray]:
        """What turns evidence for ``asked`` into that of the words: per-text index, number of each word, and for each number where its pair and its stem are."""
        at = lambda keys: np.searchsorted(self.asked, keys).astype(np.uint32)
        return [self.first, self.number.astype(np.uint32), at(self.pairs), np.where(self.stems > 0, at(self.stems), len(self.asked)).astype(np.uint32)]


def with_stems(word: np.ndarray, stem: np.ndarray, has_stem: np.ndarray) -> np.ndarray:
    return np.where(has_stem, (word + stem) / 2, word)


def with_features(rows: DataFrame, model: Model, kept: list[str], toxic: str | None = None) -> DataFrame:
    """The columns ``kept`` of ``rows`` (with text) and the features; ``toxic`` names the labels of training texts, whose own counts are left out."""
    ranges = model.ranges
    schema = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(c, T.DoubleType()) for c in EVIDENCE)])
    row_schema = "block long, bucket int, data binary"
    made = lambda *row: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "bucket", "data"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for batch in batches:
            for block, bucket, data in zip(*(batch.column(c) for c in ("block", "bucket", "data")), strict=True):
                yield block.as_py(), bucket.as_py(), data.as_py()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, _, _ in slices(batch, "text", BLOCK_BYTES):
                yield number, part
                number += 1

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in blocks(batches):
            keys = Block(part).asked
            for bucket, at in ranges.split(keys):
                yield made(block, bucket, dumped(steps(keys[at])))

    def waiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in blocks(batches):
            found = Block(part)
            keys = found.asked
            sink = io.BytesIO()
            held = part.select(kept)
            with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(held)
            yield made(block, -1, pickle.dumps((sink.getvalue(), dumped(*found.arrays(), *([keys] if toxic else [])), len(keys), int(np.bitwise_xor.reduce(keys)))))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, Known(np.zeros(0, U), np.zeros((2, 0), np.int64))
        nothing = known
        for block, bucket, data in each(batches):  # of each range, the table comes first
            if bucket != at:
                at, known = bucket, nothing
            found = loaded(data)
            keys = np.cumsum(found[0], dtype=U)
            if block < 0:
                known = Known(keys, np.stack(found[1:]))
                continue
            counts = known.of(keys)
            values = list(counts) if toxic else [model.evidence(keys, counts).astype(np.float32)]
            yield made(block, bucket, pickle.dumps((dumped(*values), int(np.bitwise_xor.reduce(keys)))))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(block: bytes, found: list[tuple[bytes, int]]) -> pa.RecordBatch:
            held, stream, n, sign = pickle.loads(block)
            first, number, pair, stem, *keys = loaded(stream)
            values = [np.concatenate(x) for x in zip(*(loaded(v) for v, _ in found), strict=True)] or [np.zeros(0)] * 5
            if len(values[0]) != n or sign != int(np.bitwise_xor.reduce(np.array([x for _, x in found] or [0], U))):
                raise RuntimeError("rows came in another order when read again; write the table first")
            rows = pa.ipc.open_stream(held).read_next_batch()
            has_stem = stem < n
            stem = np.minimum(stem, max(n - 1, 0))
            if toxic:
                of = lambda at: without_own([v[at][number] for v in values], keys[0][at][number], first, np.array(rows.column(toxic).to_pylist(), np.int64))
                value = with_stems(of(pair), of(stem), has_stem[number])
            else:
                value = with_stems(values[0][pair], values[0][stem], has_stem)[number].astype(np.float64)
            return pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c) for c in features_of(value, first).T)], names=schema.names)

        def without_own(counts: list[np.ndarray], keys: np.ndarray, first: np.ndarray, label: np.ndarray) -> np.ndarray:
            text = np.repeat(np.arange(len(label)), np.diff(first))
            own = []
            for name in (keys, keys >> U(8)):
                order = np.lexsort((name, text))
                new = np.concatenate(([True], (name[order][1:] != name[order][:-1]) | (text[order][1:] != text[order][:-1])))[: len(order)]
                times = np.diff(np.concatenate((np.flatnonzero(new), [len(order)])))
                of = np.empty(len(order), np.int64)
                of[order] = np.repeat(times, times)
                own.append(of)
            mine = label[text]
            left = [np.maximum(counts[2 * k + c] - own[k] * (mine == c), 0) for k in (0, 1) for c in (0, 1)]
            return model.evidence(keys, np.stack([*left, counts[4]]))

        rows, found = None, []
        for _, bucket, data in chain(each(batches), [(None, -1, None)]):  # of each block, the texts come first
            if bucket >= 0:
                found.append(pickle.loads(data))
                continue
            if rows is not None:
                yield scored(rows, found)
            rows, found = data, []

    both = rows.mapInArrow(asked, row_schema).unionByName(model.table.select(F.lit(-1).cast("long").alias("block"), "bucket", "data"))
    evidence = both.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(told, row_schema)
    return rows.mapInArrow(waiting, row_schema).unionByName(evidence).repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(finished, schema)


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> Model:
    """A model from the labelled rows that are not held out.

    Few labels go to the texts by broadcast, more than MOST_SENT (about 100 MB) meet them in a join by id.
    """
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = stage(marks, "toxicity-labels")
    join_by = "broadcast" if marks.count() <= MOST_SENT else "shuffle_hash"
    train = docs.select("doc_id", "text").join(marks.hint(join_by), "doc_id")
    size = train.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = Ranges(max(docs.sparkSession.sparkContext.defaultParallelism, 1 + (size.bytes or 0) // RANGE_BYTES))
    model = Model(count(train, ranges), ranges)
    if not model.trained:
        return model
    chosen = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, fit_rows / size.rows) * 1_000_000))
    sample = stage(chosen.select("text", F.col("toxic").cast("int").alias("toxic")), "toxicity-sample")
    got = with_features(sample, model, ["toxic"], "toxic").select(*EVIDENCE, "toxic").toArrow()
    model.fit(np.stack([got.column(c).to_numpy() for c in EVIDENCE], 1), got.column("toxic").to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """``docs`` with score, the three features and the number of words; the text goes unless it is kept."""
    names = ["score", *EVIDENCE]
    kept = [c for c in docs.columns if c not in names and (keep_text or c != "text")]
    rows = docs.select(*kept, *(["text"] if "text" not in kept else []))
    if not model.trained:
        return rows.select(*kept, *[F.lit(0.0).alias(c) for c in names])
    value = F.lit(float(model.weights[0]))
    for c, w, unit in zip(FEATURES, model.weights[1:], SCALE, strict=True):
        chance = model.chance[0] + model.chance[1] * F.log1p("evidence_words") if c == "top_evidence" else F.lit(0.0)
        value = value + (F.col(c) - chance) * float(w * unit)
    likely = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), value))))
    return with_features(rows, model, kept).select(*kept, likely.alias("score"), *EVIDENCE)


def ordinary(docs: DataFrame, model: Model, below: float = TOXIC) -> DataFrame:
    """The documents that score below the bound, whole."""
    return score(tucked(docs, ["text"]), model, keep_text=True).filter(F.col("score") < below).select(*untucked(docs.columns, ["text"]))
