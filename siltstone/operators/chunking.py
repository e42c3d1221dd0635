"""Documents into overlapping chunks of whole sentences.

Packing carries state from sentence to sentence, so it runs as a vectorised Python function over
each document's text; documents are independent and nothing is shuffled. Tables (runs of lines
with a bar in them) stay whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from .sections import sections

SENTENCE_END = re.compile(r"[.!?;]\s+(?=[A-Z\"'\n])")
WORD, FISCAL_YEAR = re.compile(r"\w+"), re.compile(r"fy\d{2,4}")
ABBREVIATIONS = frozenset(lexicon.ABBREVIATIONS)
LEAST_CHARS, LEAST_WORDS = 80, 20
SENT_CHARS = 1 << 22  # characters of chunks after which a task sends a frame; a document stays whole


def last_word(done: str) -> str:
    """The word that the end mark of a text follows at once, or none; read from the end, so that a long text costs no more."""
    if done[-1:] not in {".", "!", "?", ";"}:
        return ""
    stem = done[done.rfind(" ") + 1 : -1]
    if stem.isalnum():
        return stem
    found = WORD.match(stem[::-1])
    return found.group()[::-1] if found else ""


def goes_on(done: str, following: str) -> bool:
    """Whether a split after an abbreviation, an initial or a number was none."""
    if following[:1].islower():
        return True
    word = last_word(done).lower()
    return bool(word) and (word in ABBREVIATIONS or len(word) == 1 or word.isdigit() or (word.startswith("fy") and FISCAL_YEAR.fullmatch(word) is not None))


def sentences(paragraph: str) -> list[str]:
    ends = [0, *(m.start() + 1 for m in SENTENCE_END.finditer(paragraph)), len(paragraph)]
    pieces = [p for p in (paragraph[i:j].strip() for i, j in pairwise(ends)) if p]
    starts = [0, *(k for k, (done, following) in enumerate(pairwise(pieces), 1) if not goes_on(done, following)), len(pieces)]
    return [" ".join(pieces[i:j]) if j - i > 1 else pieces[i] for i, j in pairwise(starts) if j > i]


def units(text: str) -> list[tuple[str, bool]]:
    """Atomic parts in order, each with whether it is a table: paragraphs, and sentences of those over 200 characters."""
    out: list[tuple[str, bool]] = []
    for paragraph in filter(None, map(str.strip, re.split(r"\n{2,}", text))):
        if "|" not in paragraph:
            out += [(u, False) for u in plain_units(paragraph)]
            continue
        lines, table = [], []
        for line in [*paragraph.split("\n"), None]:
            if line is not None and "|" in line:
                table.append(line)
                continue
            if len(table) >= 2:
                out += [(u, False) for u in plain_units("\n".join(lines))] + [("\n".join(table), True)]
                lines = []
            else:
                lines += table
            table = []
            if line is not None:
                lines.append(line)
        out += [(u, False) for u in plain_units("\n".join(lines))]
    return out


def plain_units(paragraph: str) -> list[str]:
    paragraph = paragraph.strip()
    if not paragraph:
        return []
    return sentences(paragraph) if len(paragraph) > 200 else [paragraph]


def tail(parts: list[str], most: int) -> list[str]:
    """The longest run of last parts with at most so many characters."""
    total, at = 0, len(parts)
    while at and total + len(parts[at - 1]) <= most:
        at -= 1
        total += len(parts[at])
    return parts[at:]


def pieces_of(unit: str, size: int) -> list[str]:
    """An oversized unit, packed anew by its sentences."""
    out: list[str] = []
    for s in sentences(unit):
        if out and len(out[-1]) + 1 + len(s) <= size:
            out[-1] = f"{out[-1]} {s}"
        else:
            out.append(s)
    return out


def chunks(text: str, size: int = 1000, overlap: int = 150) -> list[str]:
    """Chunks of about ``size`` characters; neighbours share whole units of up to ``overlap`` characters."""
    size = max(200, min(size, 2000))
    overlap = max(0, min(overlap, size // 2))
    out: list[str] = []
    current: list[str] = []
    held = 0  # characters of current
    for unit, is_table in units(text):
        oversized = len(unit) > size and not is_table
        if current and (oversized or held + len(unit) > size):
            out.append(" ".join(current))
            current = tail(current, overlap)
            held = sum(map(len, current))
        if oversized:
            out += pieces_of(unit, size)
        else:
            current.append(unit)
            held += len(unit)
    if current:
        out.append(" ".join(current))
    return [c for c in map(str.strip, out) if len(c) >= LEAST_CHARS]


def chunk_documents(docs: DataFrame, sizes: dict[str, tuple[int, int]] | None = None, by_section: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row a chunk: doc_id, chunk_index, chunk_id, text, chars, words, chunk_hash, and section if chunks keep to sections. docs: doc_id (long), source_type, text.

    ``carried`` names further columns of docs, of strings or dates, that each chunk has from its document; no join brings them then. Repeats within a document are kept once, chunks under twenty words go, the rest are numbered from 0.
    """
    table = sizes or lexicon.CHUNK_SIZES
    schema = "doc_id long, chunk_index int, chunk_id string, text string, chars int, words int, chunk_hash string" + ", section string" * by_section

    names = [part.split()[0] for part in schema.split(", ")] + list(carried)
    schema = ", ".join([schema, *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for doc_id, kind, text, *more in zip(frame.doc_id, frame.source_type, frame.text, *(frame[c] for c in carried), strict=True):
                parts = sections(text or "") if by_section else [("", text or "")]
                found: dict[str, str] = {}
                for section, part in parts:
                    for c in chunks(part, *table.get(kind, table["unknown"])):
                        found.setdefault(c, section)
                kept = [(c, n) for c in found if (n := len(c.split())) >= LEAST_WORDS]
                rows += [(*(doc_id, i, f"{doc_id}_chunk_{i}", c, len(c), n, hashlib.md5(c.encode()).hexdigest(), found[c])[: 7 + by_section], *more) for i, (c, n) in enumerate(kept)]
                held += sum(len(c) for c, _ in kept)
                if held >= SENT_CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return docs.select(*dict.fromkeys(("doc_id", "source_type", "text", *carried))).mapInPandas(run, schema)


def chunk_stats(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("chars").alias("chars"), F.max("chars").alias("longest"))
