"""Tables of HTML pages as grids of cells, and whether they look like financial tables.

A cell fills the slots that its ``colspan`` and ``rowspan`` cover, within the rows that its part of the table has; cells of later rows go to the first free
slots, so that every row has its columns where a reader sees them. A table within a cell is a table of its own, and its text is not the cell's.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words of which one in a header row makes a table financial.
HEADER_WORDS = (
    "particulars", "description", "item", "quarter", "year",
    "fy", "q1", "q2", "q3", "q4", "total", "amount", "crore",
    "lakh", "million", "billion", "net", "gross", "ratio",
    "%", "rs.", "inr", "usd", "revenue", "profit", "loss",
    "asset", "liability", "equity", "income", "expense",
    "nim", "gnpa", "nnpa", "casa", "crar", "roe", "eps",
)
LEAST_COLUMNS, LEAST_ROWS, LOOKED_AT = 2, 2, 3
WIDEST, ENDLESS = 1000, 65_534

Slot = tuple[str, bool]  # the text of a cell, and whether the slot is its first
SENT = 8_192  # slots after which a task sends a batch; a page stays whole


class _Table:
    """Rows of a table under way: for each, the slots by column. ``held`` has cells that reach into rows to come: column to (rows left, text)."""

    def __init__(self) -> None:
        self.rows: list[dict[int, Slot]] = []
        self.held: dict[int, tuple[int, str]] = {}
        self.cell: list[str] | None = None
        self.span = (1, 1)

    def row(self) -> None:
        self.end_cell()
        self.rows.append({})
        waiting, self.held = self.held, {}
        for column, (left, text) in waiting.items():
            self.rows[-1][column] = text, False
            if left > 1:
                self.held[column] = left - 1, text

    def part(self) -> None:
        self.end_cell()
        self.held = {}

    def begin_cell(self, attributes: dict[str, str | None]) -> None:
        self.end_cell()
        if not self.rows:
            self.row()

        def number(name: str) -> int:
            digits = (attributes.get(name) or "").strip()
            return int(digits[:6]) if digits.isascii() and digits.isdigit() else 1

        self.span = max(1, min(number("colspan"), WIDEST)), number("rowspan") or ENDLESS
        self.cell = []

    def end_cell(self) -> None:
        if self.cell is None:
            return
        text, self.cell = " ".join("".join(self.cell).split()), None
        row, column = self.rows[-1], 0
        while column in row:
            column += 1
        for k in range(self.span[0]):
            if column + k not in row:
                row[column + k] = text, k == 0
                if self.span[1] > 1:
                    self.held[column + k] = min(self.span[1], ENDLESS) - 1, text


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Table] = []
        self.found: list[_Table] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.silent += 1
        if tag == "table":
            self.open.append(_Table())
            self.found.append(self.open[-1])
        elif self.open:
            table = self.open[-1]
            if tag == "tr":
                table.row()
            elif tag in ("td", "th"):
                table.begin_cell(dict(attrs))
            elif tag in ("thead", "tbody", "tfoot"):
                table.part()
            elif table.cell is not None and tag in ("br", "p", "div", "li"):
                table.cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        if self.open and tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "table"):
            self.open[-1].end_cell()
            if tag in ("thead", "tbody", "tfoot"):
                self.open[-1].part()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].cell is not None and not self.silent:
            self.open[-1].cell.append(data)

    def tables(self, page: str) -> list[list[dict[int, Slot]]]:
        self.feed(page)
        self.close()
        for table in self.open:
            table.end_cell()
        return [[row for row in t.rows if row] for t in self.found]


def grids(page: str) -> list[list[dict[int, Slot]]]:
    """The tables of a page in the order in which they begin, each a list of rows: column to (text, whether the cell begins there)."""
    return [t for t in _Reader().tables(page) if t]


def is_financial(grid: list[dict[int, Slot]]) -> bool:
    """At least two columns in the first row and two rows below, and either a financial word in the first row or a digit in the three below."""
    headers = [text for text, _ in grid[0].values()]
    rows = grid[1:]
    if len(headers) < LEAST_COLUMNS or len(rows) < LEAST_ROWS:
        return False
    said = " ".join(headers).lower()
    return any(w in said for w in HEADER_WORDS) or any(c.isdigit() for row in rows[:LOOKED_AT] for text, _ in row.values() for c in text)


def cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, table, row (0 is the header), column, text, begins (a cell's first slot) and financial: one row for each slot of each table. Null pages have none."""
    fields = [("table", T.IntegerType()), ("row", T.IntegerType()), ("column", T.IntegerType()), ("text", T.StringType()), ("begins", T.BooleanType()), ("financial", T.BooleanType())]
    schema = T.StructType([pages.schema[key], *(T.StructField(*f) for f in fields)])
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]

    def sent(keys: list, out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, kind = [], [], batch.schema.field(0).type
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, grid in enumerate(grids(page or "")):
                    verdict = is_financial(grid)
                    out += [(n, r, c, *row[c], verdict) for r, row in enumerate(grid) for c in sorted(row)]
                keys += [name] * (len(out) - len(keys))
                if len(out) >= SENT:
                    yield sent(keys, out, kind)
                    keys, out = [], []
            if out:
                yield sent(keys, out, kind)

    return pages.select(key, html).mapInArrow(run, schema)
