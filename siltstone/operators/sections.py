"""Sections of documents, by their headers.

A header is a short line, mostly capitalised, that is one of the known section titles (with a number before or a colon after it, if any) or that is
numbered. Headers count once, whatever their case. The text is cut at the first line of each header's words after the cut before, so
one pointer moves over the lines of a text; nothing is searched twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Titles of sections.
TITLES = (
    r"(?:financial\s+)?highlights?",
    r"financial\s+(?:results?|performance|summary)",
    r"key\s+(?:financial\s+)?(?:metrics?|indicators?|ratios?|highlights?)",
    r"profit\s+(?:and\s+loss|&\s+loss)",
    r"balance\s+sheet",
    r"cash\s+flow\s+statement",
    r"statement\s+of\s+(?:profit|income)",
    r"income\s+statement",
    r"notes?\s+to\s+(?:the\s+)?(?:financial\s+)?accounts?",
    r"management(?:'s?)?\s+discussion\s+(?:and\s+analysis|&\s+analysis)",
    r"md\s*&\s*a",
    r"business\s+(?:overview|review|summary|description|segments?)",
    r"operating\s+(?:performance|review|highlights?)",
    r"segment(?:al)?\s+(?:performance|results?|review)",
    r"geographic\s+(?:performance|breakdown)",
    r"risk\s+(?:factors?|management|framework|governance)",
    r"credit\s+risk",
    r"market\s+risk",
    r"liquidity\s+risk",
    r"operational\s+risk",
    r"concentration\s+risk",
    r"net\s+interest\s+(?:margin|income)",
    r"(?:gross|net)\s+npa",
    r"capital\s+adequacy",
    r"asset\s+quality",
    r"casa\s+(?:ratio|deposits?)",
    r"loan\s+(?:book|portfolio|growth)",
    r"deposit\s+(?:growth|mix|base)",
    r"provisioning\s+(?:coverage|policy)",
    r"corporate\s+governance",
    r"board\s+of\s+directors",
    r"director(?:'s?)?\s+report",
    r"auditor(?:'s?)?\s+report",
    r"statutory\s+(?:report|compliance)",
    r"related\s+party\s+transactions?",
    r"dividend\s+(?:policy|distribution)",
    r"outlook\s+(?:and\s+guidance|for)?",
    r"guidance\s+(?:and\s+outlook)?",
    r"future\s+(?:plans?|prospects?|strategy)",
    r"strategic\s+(?:priorities?|direction|initiatives?)",
    r"growth\s+(?:strategy|drivers?|levers?)",
    r"regulatory\s+(?:compliance|framework|updates?|changes?)",
    r"(?:sebi|rbi|mca)\s+(?:guidelines?|circulars?|regulations?)",
    r"statutory\s+information",
    r"executive\s+summary",
    r"chairman(?:'s?)?\s+(?:message|letter|statement)",
    r"ceo(?:'s?)?\s+(?:message|letter|statement)",
    r"(?:managing\s+)?director(?:'s?)?\s+(?:message|statement)",
    r"about\s+(?:the\s+)?(?:company|bank|us)",
    r"company\s+overview",
    r"products?\s+(?:and\s+)?services?",
    r"distribution\s+network",
    r"human\s+resources?|people\s+initiatives?",
    r"technology\s+(?:and\s+digital)?(?:\s+initiatives?)?",
    r"esg|sustainability|corporate\s+social\s+responsibility|csr",
    r"awards?\s+(?:and\s+)?recognition",
    r"glossary|abbreviations?|definitions?",
    r"annexure|appendix|schedule",
)

TITLE = re.compile(rf"(?i)(?:\d[\d.]*\s+)?(?:{'|'.join(f'(?:{t})' for t in TITLES)})\s*:?\s*")
NUMBERED = re.compile(r"\d+(?:\.\d+)*\s+(.+)")
NUMBER = re.compile(r"\d+\.?\d*")
LONGEST, SENTENCE = 80, 40


def is_header(line: str) -> bool:
    """Whether a stripped line is a header."""
    if not 3 <= len(line) <= LONGEST or (len(line) > SENTENCE and line.endswith(".")) or NUMBER.fullmatch(line):
        return False
    words = line.split()
    capitals = sum(w[0].isupper() for w in words)
    if 10 * capitals < 6 * len(words) and not (len(line) > 3 and line.isupper()):
        return False
    if TITLE.fullmatch(line):
        return True
    numbered = NUMBERED.fullmatch(line)
    return numbered is not None and len(numbered[1]) > 3 and not numbered[1].endswith(".")


def _without_colon(line: str) -> str:
    return line[:-1].rstrip() if line.endswith(":") else line


def sections(text: str) -> list[tuple[str, str]]:
    """(header, text) of each section that has text, in order; the header of what stands before the first is empty. Whole and empty-headed without any."""
    lines = text.split("\n")
    bare = [line.strip() for line in lines]
    headers: dict[str, str] = {}
    for line in bare:
        if is_header(line):
            headers.setdefault(line.lower(), line)
    out: list[tuple[str, str]] = []
    header, start, at = "", 0, 0
    for wanted, name in headers.items():
        line = at
        while line < len(bare) and bare[line].lower() != wanted and _without_colon(bare[line]).lower() != wanted:
            line += 1
        if line == len(bare):
            continue
        before = "\n".join(lines[start:line]).strip()
        if before:
            out.append((header, before))
        at = line + 1
        if not bare[line].lower().endswith(":") or bare[line].lower() == wanted:  # a colon may follow on a line of its own
            after = at
            while after < len(bare) and not bare[after]:
                after += 1
            at = after + 1 if after < len(bare) and bare[after] == ":" else at
        header, start = name, at
    rest = "\n".join(lines[start:]).strip()
    if rest:
        out.append((header, rest))
    return out or [("", text)]


def document_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (from 0), section and text. Documents without headers are one section without a name; null and empty ones have none."""
    schema = T.StructType([docs.schema[key], T.StructField("n", T.IntegerType()), T.StructField("section", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, whole in enumerate(batch.column(1).to_pylist()):
                found = sections(whole) if whole and whole.strip() else []
                if found:
                    arrays = [pa.array([batch.column(0)[i].as_py()] * len(found), batch.schema.field(0).type), pa.array(range(len(found)), pa.int32()), *(pa.array([s[k] for s in found], pa.string()) for k in (0, 1))]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)
