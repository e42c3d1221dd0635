"""Assumptions that a model states as JSON: mending the JSON, reading it by type, and saying why an item was left out.

The text is read once, by a machine that knows whether it is in a string and which brackets are open. It begins at the first bracket and ends where that
closes; what is still open at the end of the text is closed. Outside strings, Python's words for true, false and null become JSON's, and commas
before a closing bracket go. In strings, line ends and tabs are escaped; strings in single quotes become strings in double quotes.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("demand", "margin", "valuation", "regulatory", "macro", "competitive", "operational", "financial", "unknown")
MOST, SHORTEST, ALIKE = 8, 10, 60
WORDS = {"True": "true", "False": "false", "None": "null", "NaN": "null"}
WORD = re.compile(r"[A-Za-z_]+")
CLOSES = {"[": "]", "{": "}"}
ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def mended(text: str) -> str | None:
    """The first array or object of a text as JSON, as far as it goes; None without a bracket."""
    at = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=-1)
    if at < 0:
        return None
    out: list[str] = []
    open_: list[str] = []
    quote = ""
    while at < len(text):
        c = text[at]
        if quote:
            if c == "\\" and at + 1 < len(text):
                out.append("'" if text[at + 1] == "'" else text[at : at + 2])
                at += 2
                continue
            if c == quote:
                quote = ""
                c = '"'
            elif c == '"':
                c = '\\"'
            out.append(ESCAPES.get(c, c))
        elif c in "\"'":
            quote = c
            out.append('"')
        elif c in CLOSES:
            open_.append(CLOSES[c])
            out.append(c)
        elif c in "]}":
            if c not in open_:
                at += 1
                continue
            while open_[-1] != c:  # a bracket in between was never closed
                _close(out, open_.pop())
            _close(out, open_.pop())
            if not open_:
                break
        else:
            word = WORD.match(text, at)
            if word:
                out.append(WORDS.get(word[0], word[0]))
                at = word.end()
                continue
            out.append(c)
        at += 1
    if quote:
        out.append('"')
    while open_:
        _close(out, open_.pop())
    return "".join(out)


def _close(out: list[str], bracket: str) -> None:
    """Append a closing bracket, without commas and colons that lead nowhere."""
    while out and (out[-1].isspace() or out[-1] in ",:"):
        out.pop()
    out.append(bracket)


def items_of(text: str | None) -> list | None:
    """The list that a text states, bare or under one of the usual names; None if there is none."""
    whole = mended(text or "")
    try:
        found = json.loads(whole) if whole else None
    except ValueError:
        return None
    if isinstance(found, dict):
        found = next((found[k] for k in ("assumptions", "items", "data") if k in found), [])
    return found if isinstance(found, list) else None


def read(items: list, most: int = MOST) -> tuple[list[dict], list[tuple[int, str]]]:
    """Assumptions numbered from 1, and (place, reason) of each item left out."""
    kept: list[dict] = []
    out: list[tuple[int, str]] = [(i, "too many") for i in range(most, len(items))]
    seen: set[str] = set()
    for place, item in enumerate(items[:most]):
        if not isinstance(item, dict):
            out.append((place, "not an object"))
            continue
        text = str(item.get("text", "")).strip()
        alike = text[:ALIKE].lower()
        try:
            number = int(item.get("id", len(kept) + 1))
            depends = [int(str(x)) for x in item.get("dependency_on") or [] if str(x).isdigit()]
        except (TypeError, ValueError, OverflowError):
            out.append((place, "bad number"))
            continue
        if len(text) < SHORTEST:
            out.append((place, "too short"))
            continue
        if alike in seen:
            out.append((place, "repeated"))
            continue
        seen.add(alike)
        try:
            confidence = float(item.get("confidence", 0.5))
        except (TypeError, ValueError):
            out.append((place, "bad confidence"))
            continue
        category = str(item.get("category", "unknown")).lower().strip()
        kept.append({
            "place": place, "id": number if 1 <= number <= most else len(kept) + 1, "text": text, "category": category if category in CATEGORIES else "unknown",
            "confidence": 0.0 if math.isnan(confidence) else max(0.0, min(1.0, confidence)), "depends_on": depends, "critical": bool(item.get("is_critical", False)),
        })
    numbers = {a["id"]: n for n, a in enumerate(kept, 1)}
    for n, a in enumerate(kept, 1):
        a["id"], a["depends_on"] = n, [numbers[d] for d in a["depends_on"] if numbers.get(d, n) != n]
    return kept, sorted(out)


def assumptions(answers: DataFrame, key: str = "answer_id", text: str = "text", most: int = MOST) -> DataFrame:
    """key, place, id, text, category, confidence, depends_on, critical and reject.

    A row for each item of an answer, with its reason in ``reject`` and nothing else if it was left out. An answer without a list gives one row, place -1, ``no list``, so that
    the caller can go on to rules over the thesis (``tagging.causal_assumptions``) for just these; null and empty answers are such.
    """
    kind = answers.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, place int, id int, text string, category string, confidence double, depends_on array<int>, critical boolean, reject string"
    names = ["place", "id", "text", "category", "confidence", "depends_on", "critical", "reject"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int32()), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, answer in enumerate(batch.column(1).to_pylist()):
                items = items_of(answer)
                kept, left = read(items, most) if items is not None else ([], [(-1, "no list")])
                rows += [*kept, *({"place": p, "reject": why} for p, why in left)]
                keys += [i] * (len(rows) - len(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int32())), *(pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds, strict=True))], names=[key, *names])

    return answers.select(key, F.col(text).cast("string")).mapInArrow(run, schema)
