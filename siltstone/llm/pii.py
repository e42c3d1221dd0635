"""Personal data by weak supervision.

Four strict patterns give base spans, which always stay. Looser patterns propose further spans
(spelled-out addresses, national phone numbers, long numbers, IPv6 addresses, credentials). Five
labelers vote on every span, for (1), against (-1) or not at all (0):

    pattern     the strict pattern matched, or only the loose one
    checksum    Luhn sum, octet range, number of digits, mix of characters
    gazetteer   top-level domains, dial codes, card issuers, key prefixes
    context     cue words in the 40 characters before the span
    shape       whether the span stands alone or inside a longer token

Spans with the same kind, votes and length class are one pattern; there are at most 6 * 3**5 * 3
patterns, whatever the corpus, and Spark counts them over all documents. On the counts,
expectation-maximisation (Dawid-Skene, for each kind) estimates how reliable each labeler is and
how likely each pattern is personal data, and a logistic classifier is fitted on these soft labels. A
proposed span is accepted if the classifier gives it one half or more.

Defined results: null and empty texts have no spans; texts are read whole; a text without a digit,
an @ or a spelled-out dot is settled by one vectorised test; repeated rows give repeated
results; an empty table gives an empty result; other columns pass through unless they bear the
name of a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import tucked, untucked
from .textnum import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "shape")
Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOOSE = (
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z0-9-]{1,63}){1,4}")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("card", re.compile(r"(?<![\w-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    ("secret", re.compile(r"\bAKIA[0-9A-Z]{16}\b")),
    ("secret", re.compile(r"(?i)(?:\b(?:password|passwd|token|secret|api[_-]?key)[ ]?[:=][ ]?\"?)([A-Za-z0-9_-]{12,})")),
)

#: What each kind's gazetteer holds.
TOP_DOMAINS = frozenset("com org net edu gov info io co uk de fr es it nl eu us ca au ch at be".split())
DIAL_CODES = ("1", "31", "32", "33", "34", "39", "41", "43", "44", "49", "52", "55", "61", "81", "86", "91")
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
KEY_PREFIXES = ("AKIA", "ghp_", "sk-", "xox")
#: Words before a span that speak for or against its kind.
CUES = {
    "email": "mail email e-mail contact correo courriel kontakt write",
    "ip": "ip host server address adresse from client login",
    "card": "card visa mastercard amex credit carte karte tarjeta payment",
    "phone": "phone tel telephone call mobile fax telefon teléfono téléphone",
    "secret": "password passwd token secret key apikey credential",
}
CUES = {kind: frozenset(words.split()) for kind, words in CUES.items()}
COUNTER_CUES = frozenset("version license isbn issn order invoice page figure table section chapter release build".split())
WORD = re.compile(r"[^\W\d_][\w-]*")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in linear time: the local part grows backwards from each @, as far as the last match or @."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        floor = found.end() if found else at + 1
        if found:
            yield start, floor
        at = text.find("@", floor)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        d = digits_of(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m.group())) <= 15:
            yield m.span()


BASE = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> list[Span]:
    found = [(kind, a, b) for kind, of in BASE.items() for a, b in of(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def proposed_spans(text: str, base: list[Span]) -> list[Span]:
    """Loose matches that touch no base span and no earlier proposal, leftmost and longest first."""
    found = []
    for kind, pattern in LOOSE:
        for m in pattern.finditer(text):
            group = 1 if pattern.groups else 0
            found.append((kind, m.start(group), m.end(group)))
    taken = [(a, b) for _, a, b in base]
    out = []
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b))
    return out


def votes(text: str, span: Span, strict: bool) -> tuple[int, ...]:
    kind, a, b = span
    body = text[a:b]
    digits = digits_of(body)
    mixed = len(digits) >= 4 and len(body) - len(digits) >= 4
    check = {
        "email": 1 if "@" in body else 0,
        "ip": 1,
        "card": 1 if luhn(digits) and 13 <= len(digits) <= 19 else -1,
        "phone": 1 if 10 <= len(digits) <= 15 else -1,
        "secret": 1 if mixed else -1,
    }[kind]
    known = {
        "email": re.split(r"[^a-z]+", body.lower())[-1] in TOP_DOMAINS,
        "ip": digits[:1] not in ("", "0"),
        "card": digits.startswith(CARD_PREFIXES),
        "phone": body.startswith("+") and digits.startswith(DIAL_CODES),
        "secret": body.startswith(KEY_PREFIXES),
    }[kind]
    before = {w.lower() for w in WORD.findall(text[max(0, a - 40) : a])}
    context = 1 if before & CUES[kind] else -1 if before & COUNTER_CUES else 0
    alone = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    return (1 if strict else -1, check, 1 if known else 0, context, 1 if alone else -1)


def pattern_code(text: str, span: Span, strict: bool) -> int:
    """Kind, votes and length class as one number."""
    size = span[2] - span[1]
    code = KINDS.index(span[0]) * 3 + (0 if size < 12 else 1 if size < 24 else 2)
    for v in votes(text, span, strict):
        code = code * 3 + v + 1
    return code


def decoded(code: int) -> tuple[str, int, list[int]]:
    out = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        out.append(v - 1)
    kind, size = divmod(code, 3)
    return KINDS[kind], size, out[::-1]


def _texts_to_read(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, column: str) -> np.ndarray:
    """Rows that can hold a span at all."""
    mark = np.zeros(256, bool)
    mark[[*range(0x30, 0x3A), 0x40]] = True
    upto = np.concatenate(([0], np.cumsum(mark[data])))
    spelled = pc.match_substring_regex(part.column(column), r"\bdot\b|\(dot\)|\[dot\]").fill_null(False).to_numpy(zero_copy_only=False)
    return np.flatnonzero((upto[offsets[1:]] > upto[offsets[:-1]]) | spelled)


def pattern_counts(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """How many spans of all documents have each pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, text):
                codes = []
                for i in _texts_to_read(part, data, offsets, text):
                    t = part.column(text)[int(i)].as_py()
                    base = base_spans(t)
                    codes += [pattern_code(t, s, True) for s in base] + [pattern_code(t, s, False) for s in proposed_spans(t, base)]
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32())], names=["code"])

    rows = docs.select(text).mapInArrow(run, "code int").groupBy("code").agg(F.count("*").alias("n")).collect()
    return {r.code: r.n for r in rows}


def estimate(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Probability of each pattern to be personal data, by expectation-maximisation for each kind.

    Votes are three-way; a labeler starts from the belief that it is right more often than wrong.
    """
    out: dict[int, float] = {}
    for kind in KINDS:
        codes = [c for c in counts if decoded(c)[0] == kind]
        if not codes:
            continue
        v = np.array([decoded(c)[2] for c in codes]) + 1
        n = np.array([counts[c] for c in codes], float)
        prior_yes = np.array([[1.0, 2.0, 4.0]] * len(LABELERS))
        prior_no = prior_yes[:, ::-1]
        p = 1 / (1 + np.exp(-(v - 1).sum(1)))
        for _ in range(rounds):
            rate = (n @ p + 1) / (n.sum() + 2)
            tables = []
            for weight, prior in ((n * p, prior_yes), (n * (1 - p), prior_no)):
                seen = prior + np.stack([np.bincount(v[:, j], weight, minlength=3) for j in range(len(LABELERS))])
                tables.append(np.log(seen / seen.sum(1, keepdims=True)))
            score = np.log(rate / (1 - rate)) + sum(tables[0][j][v[:, j]] - tables[1][j][v[:, j]] for j in range(len(LABELERS)))
            new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            if np.abs(new - p).max() < 1e-9:
                break
            p = new
        out |= dict(zip(codes, p.tolist(), strict=True))
    return out


def features(code: int) -> np.ndarray:
    kind, size, v = decoded(code)
    kinds = [float(kind == k) for k in KINDS]
    sizes = [float(size == s) for s in (1, 2)]
    return np.array([*kinds, *sizes, *(float(x > 0) for x in v), *(float(x < 0) for x in v)])


def train(counts: dict[int, int], soft: dict[int, float], ridge: float = 1.0) -> dict[int, float]:
    """The span classifier's probability for each pattern: logistic regression on the soft labels, weighted by the counts."""
    if not counts:
        return {}
    codes = sorted(counts)
    x = np.stack([features(c) for c in codes])
    n, y = np.array([counts[c] for c in codes], float), np.array([soft[c] for c in codes])
    w = np.zeros(x.shape[1])
    loss = lambda u: n @ (np.logaddexp(0, x @ u) - y * (x @ u)) + ridge / 2 * u @ u
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def learn(docs: DataFrame, text: str = "text") -> frozenset[int]:
    """The patterns whose proposed spans are accepted."""
    counts = pattern_counts(docs, text)
    return frozenset(c for c, p in train(counts, estimate(counts)).items() if p >= 0.5)


def spans_of(text: str, accepted: frozenset[int]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by start and kind."""
    base = base_spans(text)
    added = [s for s in proposed_spans(text, base) if pattern_code(text, s, False) in accepted]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def find(docs: DataFrame, accepted: frozenset[int], text: str = "text") -> DataFrame:
    """``docs`` without its text, with base and spans: arrays of (kind, start, end) in code points."""
    kept = [c for c in docs.columns if c not in (text, "base", "spans")]
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("base", span), T.StructField("spans", span)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end")
        for batch in batches:
            for part, data, offsets in slices(batch, text):
                base: list[list] = [[]] * part.num_rows
                spans: list[list] = [[]] * part.num_rows
                for i in map(int, _texts_to_read(part, data, offsets, text)):
                    one, two = spans_of(part.column(text)[i].as_py(), accepted)
                    base[i], spans[i] = [dict(zip(names, s, strict=True)) for s in one], [dict(zip(names, s, strict=True)) for s in two]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(base, arrow), pa.array(spans, arrow)], names=schema.names)

    return docs.select(*kept, text).mapInArrow(run, schema)


def masked_text(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, accepted: frozenset[int], text: str = "text") -> DataFrame:
    """``docs`` with the spans masked in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, text):
                texts = part.column(text).to_pylist()
                for i in map(int, _texts_to_read(part, data, offsets, text)):
                    texts[i] = masked_text(texts[i], spans_of(texts[i], accepted)[1])
                at = part.schema.get_field_index(text)
                yield part.set_column(at, text, pa.array(texts, part.schema.field(text).type))

    whole = tucked(docs, [text])
    return whole.mapInArrow(run, whole.schema).select(*untucked(docs.columns, [text]))
