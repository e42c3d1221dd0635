"""Layout-aware text of HTML pages.

A page is read tag by tag onto a stack of open elements, with the tags that HTML lets authors
leave out (``</p>``, ``</li>``, ``</td>``, ``</tr>``, ``</head>``, ``<tr>`` ...) put in. What the reader of
the page would not see is left out: head, scripts, styles, templates, comments, elements with
``hidden`` or with ``display:none`` in their style, and text whose nearest word on visibility is ``hidden`` or ``collapse`` (a child may
be visible again). Of a ``select`` the chosen option is seen (the first, if none is), of one with ``multiple`` or a ``size`` all are. All other text comes
out once, in order:

* a block starts on a line of its own; paragraphs, headings, lists and tables are set off by an empty line;
* list items get ``- `` or their number, indented by nesting;
* the cells of a table's row stand on one line, columns aligned and parted by `` | ``, with the columns that ``colspan`` and
  the rows that ``rowspan`` take (to the end of its part of the table) left free; a cell wider
  than 80 characters is not padded to, so that layout tables stay small;
* white space collapses except in ``pre``, ``textarea`` and ``xmp``; what looks like a tag within ``xmp`` is text.

The work is one pass over each page inside Arrow tasks; pages are independent, so Spark splits
them freely and nothing is shuffled.

Defined results: null or empty html gives the empty text; unclosed tags, quotes and comments end with
the page; repeated rows give repeated results; an empty table gives an empty result; other
columns pass through unless they bear the name of a result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textnum import slices

SPACE = re.compile(r"[ \t\r\n\f]+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
STYLE_COMMENT = re.compile(r"(?s)/\*.*?(?:\*/|$)")
DECLARATION = re.compile(r"""((?:[^;"'(]|"[^"]*"?|'[^']*'?|\([^)]*\)?)*);?""")
DIGITS = re.compile(r"\s*(\d{1,6})")

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas svg datalist".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
SET_OFF = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre xmp figure hr".split())
BLOCKS = SET_OFF | frozenset(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer form header html legend li main menu nav option section summary tbody tfoot thead tr".split()
)
CLOSES_P = SET_OFF | frozenset("address article aside center details dialog dir div dl fieldset figcaption footer form header main menu nav section summary dt dd li".split())
#: What an opening tag ends first: the elements, and where to stop looking for them.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["table"])),
    "th": (frozenset(["td", "th"]), frozenset(["table"])),
    "tr": (frozenset("td th tr caption".split()), frozenset(["table"])),
    **{t: (frozenset("td th tr thead tbody tfoot caption".split()), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
}
WALLS = frozenset("td th table caption".split())
WIDEST = 80


def attributes_of(attributes: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # the first of a name counts
    return found


def number_in(attributes: str, name: str) -> int | None:
    if name not in attributes.lower():
        return None
    found = DIGITS.match(attributes_of(attributes).get(name, ""))
    return int(found[1]) if found else None


def hides_by(attributes: str) -> tuple[bool, bool | None]:
    """Whether a tag is not displayed (an attribute named hidden, or its style), and whether its style makes text unseen (None: as around it)."""
    low = attributes.lower()
    if not any(word in low for word in ("hidden", "display", "visibility", "&")):
        return False, None
    found = attributes_of(attributes)
    said: dict[str, tuple[bool, str]] = {}
    for m in DECLARATION.finditer(STYLE_COMMENT.sub(" ", entities.unescape(found.get("style", "")))):
        name, _, value = m[1].lower().partition(":")
        value, mark, word = value.partition("!")
        urgent = bool(mark) and word.strip() == "important"
        if not mark or urgent:
            if urgent or not said.get(name.strip(), (False, ""))[0]:
                said[name.strip()] = urgent, value.strip()
    visibility = said.get("visibility", (False, ""))[1]
    unseen = {"hidden": True, "collapse": True, "visible": False}.get(visibility)
    return "hidden" in found or said.get("display", (False, ""))[1] == "none", unseen


class Buffer:
    """Lines under way: collapsed text, with breaks and prefixes put in when the next text comes."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.gap = 0
        self.space = False
        self.depth = 0
        self.marker = ""
        self.columns = self.rows = 1  # those that a cell takes

    def block(self, lines: int) -> None:
        self.gap = max(self.gap, lines)
        self.space = False

    def _begin(self) -> None:
        if self.gap or not self.out:
            if self.out:
                self.out.append("\n" * self.gap)
            indent = "  " * max(0, self.depth - 1)
            self.out.append(indent + (self.marker or ("  " if self.depth else "")))
            self.marker, self.gap, self.space = "", 0, False

    def text(self, text: str) -> None:
        flat = SPACE.sub(" ", text)
        bare = flat.strip(" ")
        if not bare:
            self.space = self.space or bool(flat and self.out and not self.gap)
            return
        self._begin()
        if self.space or (flat[0] == " " and self.out and not self.out[-1].endswith((" ", "\n"))):
            self.out.append(" ")
        self.out.append(bare)
        self.space = flat[-1] == " "

    def verbatim(self, text: str) -> None:
        if text:
            self._begin()
            self.out.append(text)
            self.space = False

    def finished(self) -> str:
        return "".join(self.out).strip("\n")


def aligned(rows: list[list[tuple[int, str]]]) -> str:
    """The rows of a table, cells as (column, text), with their columns padded to one width each; columns without text go."""
    rows = [row for row in rows if any(text for _, text in row)]
    used = {c: i for i, c in enumerate(sorted({c for row in rows for c, text in row if text}))}
    grid = []
    for row in rows:
        cells = {used[c]: text.split("\n") for c, text in row if text}
        grid.append([cells.get(i, [""]) for i in range(max(cells) + 1)])
    widths: Counter[int] = Counter()
    for row in grid:
        for i, cell in enumerate(row):
            widths[i] = max(widths[i], min(WIDEST, max(map(len, cell))))
    lines = []
    for row in grid:
        for k in range(max(map(len, row))):
            lines.append(" | ".join((cell[k] if k < len(cell) else "").ljust(widths[i]) for i, cell in enumerate(row)).rstrip())
    return "\n".join(lines)


class Page:
    """The stack of open elements and the text so far."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # the tag, whether it hides all within, whether text was invisible before it
        self.invisible = False
        self.open: Counter[str] = Counter()
        self.unseen = 0
        self.kept_space = 0
        self.buffers = [Buffer()]
        self.tables: list[list[list[tuple[int, str]]]] = []
        self.columns: list[int] = []  # of each open table, the column where the next cell goes
        self.taken: list[dict[int, int]] = []  # of each, the first row below that a cell of an earlier row leaves free, by column
        self.options: list[tuple[str, list[tuple[bool, str]]]] = []
        self.lists: list[int | None] = []

    def read(self, page: str) -> str:
        at, end = 0, len(page)
        while at < end:
            tag = page.find("<", at)
            if tag < 0:
                tag = end
            if tag > at:
                self.text(page[at:tag])
            if tag == end:
                break
            at = self._markup(page, tag)
        while self.stack:
            self._pop()
        return self.buffers[0].finished()

    def _markup(self, page: str, at: int) -> int:
        """Take in what begins at a ``<``; return where to go on."""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return len(page) if end < 0 else end + 3
        closing = page.startswith("</", at)
        name = NAME.match(page, at + 1 + closing)
        if not name:
            if page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                return len(page) if end < 0 else end + 1
            self.text("<")
            return at + 1
        end = self._tag_end(page, name.end())
        tag = name.group().lower()
        if closing:
            self._close(tag)
            return end
        rest = page[name.end() : end]
        if tag in RAW:
            close = re.compile(rf"(?i)</{tag}(?=[\s/>])").search(page, end)
            return len(page) if close is None else self._tag_end(page, close.end())
        self._start(tag, rest)
        if tag == "xmp":
            close = re.compile(r"(?i)</xmp(?=[\s/>])").search(page, end)
            if not self.unseen and not self.invisible:
                self.buffers[-1].verbatim(page[end : close.start() if close else len(page)])
            self._close(tag)
            return len(page) if close is None else self._tag_end(page, close.end())
        if tag == "textarea" and page.startswith("\n", end):
            return end + 1
        return end

    @staticmethod
    def _tag_end(page: str, at: int) -> int:
        """Just past the ``>`` that ends a tag, not counting those in quoted values."""
        while True:
            end = page.find(">", at)
            if end < 0:
                return len(page)
            quotes = [q for q in (page.find('"', at, end), page.find("'", at, end)) if q >= 0]
            if not quotes or page[min(quotes) - 1] != "=":
                return end + 1
            close = page.find(page[min(quotes)], min(quotes) + 1)
            if close < 0:
                return end + 1
            at = close + 1

    def text(self, raw: str) -> None:
        if self.unseen or self.invisible:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if self.kept_space:
            self.buffers[-1].verbatim(text)
        else:
            self.buffers[-1].text(text)

    def _end_open(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        found = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in stop:
                break
            if self.stack[i][0] in tags:
                found = i
        while found is not None and len(self.stack) > found:
            self._pop()

    def _start(self, tag: str, attributes: str) -> None:
        if self.open["head"] and tag not in IN_HEAD and tag != "head":
            self._end_open(frozenset(["head"]), frozenset())
        if tag in CLOSES_P:
            self._end_open(frozenset(["p"]), WALLS)
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        if tag in ("td", "th") and self.tables and (not self.tables[-1] or self.stack[-1][0] != "tr"):
            self._start("tr", "")
        buffer = self.buffers[-1]
        if tag in VOID:
            if not self.unseen:
                if tag == "br":
                    buffer.block(1)
                elif tag == "hr":
                    buffer.block(2)
            return
        hides, unseen = hides_by(attributes) if attributes else (False, None)
        hides = hides or tag in UNSEEN
        self.stack.append((tag, hides, self.invisible))
        self.open[tag] += 1
        self.invisible = self.invisible if unseen is None else unseen
        self.unseen += hides
        self.kept_space += tag in ("pre", "textarea")
        if tag in BLOCKS and not self.unseen:
            buffer.block(2 if tag in SET_OFF and not (tag in ("ul", "ol") and self.lists) else 1)
        if tag in ("ul", "ol", "menu"):
            start = number_in(attributes, "start")
            self.lists.append(None if tag != "ol" else 1 if start is None else start)
            buffer.depth += 1
        elif tag == "li" and not self.unseen:
            number = self.lists[-1] if self.lists else None
            if number is not None:
                own = number_in(attributes, "value")
                number = number if own is None else own
                self.lists[-1] = number + 1
            buffer.marker = "" if self.invisible else "- " if number is None else f"{number}. "
        elif tag == "select":
            self.options.append((attributes, []))
            self.buffers.append(Buffer())
        elif tag == "option" and self.options:
            self.options[-1][1].append(("selected" in attributes_of(attributes), ""))
            self.buffers.append(Buffer())
        elif tag in ("thead", "tbody", "tfoot") and self.taken:
            self.taken[-1].clear()
        elif tag == "table":
            self.tables.append([])
            self.columns.append(0)
            self.taken.append({})
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
            self.columns[-1] = 0
        elif tag in ("td", "th"):
            self.buffers.append(Buffer())
            rows = number_in(attributes, "rowspan")
            self.buffers[-1].columns = max(1, min(number_in(attributes, "colspan") or 1, 1000))
            self.buffers[-1].rows = 1 if rows is None else rows or 65_534

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._start("br", "")
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                return

    def _pop(self) -> None:
        tag, hides, invisible = self.stack.pop()
        self.open[tag] -= 1
        if tag in ("td", "th"):
            cell = self.buffers.pop()
            if self.tables and self.tables[-1]:
                if not hides:
                    self._place(cell)
            elif not self.unseen:
                self.buffers[-1].verbatim(cell.finished())
        elif tag == "table":
            grid = aligned(self.tables.pop())
            self.columns.pop()
            self.taken.pop()
            if grid and not self.unseen:
                self.buffers[-1].block(2)
                self.buffers[-1].verbatim(grid)
        elif tag == "option" and self.options and self.options[-1][1]:
            own = self.options[-1][1]
            own[-1] = own[-1][0], self.buffers.pop().finished()
        elif tag == "select" and self.options:
            self.buffers.pop()
            seen = shown(*self.options.pop())
            if seen and not self.unseen:
                self.buffers[-1].text(seen)
        elif tag in ("thead", "tbody", "tfoot") and self.taken:
            self.taken[-1].clear()
        buffer = self.buffers[-1]
        if tag in ("ul", "ol", "menu"):
            self.lists.pop()
            buffer.depth -= 1
        if tag in BLOCKS and not self.unseen:
            buffer.block(2 if tag in SET_OFF and not (tag in ("ul", "ol") and self.lists) else 1)
        self.kept_space -= tag in ("pre", "textarea")
        self.unseen -= hides
        self.invisible = invisible

    def _place(self, cell: Buffer) -> None:
        """Put a cell into the first column of its row that no cell of an earlier row takes."""
        table, taken, column = self.tables[-1], self.taken[-1], self.columns[-1]
        row = len(table) - 1
        while taken.get(column, 0) > row:
            column += 1
        table[-1].append((column, cell.finished()))
        self.columns[-1] = column + cell.columns
        if cell.rows > 1:
            taken.update(dict.fromkeys(range(column, column + cell.columns), row + cell.rows))


def shown(attributes: str, options: list[tuple[bool, str]]) -> str:
    """What is seen of a select: the option chosen last, or all if it is a list box."""
    found = attributes_of(attributes)
    if "multiple" in found or (number_in(attributes, "size") or 1) > 1:
        return " ".join(text for _, text in options if text)
    return next((text for chosen, text in reversed(options) if chosen), options[0][1] if options else "")


def rendered(page: str | None) -> str:
    return Page().read(page or "")


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its html, with text."""
    kept = [c for c in pages.columns if c not in (html, "text")]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, html):
                texts = [rendered(p) for p in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], names=schema.names)

    return pages.select(*kept, html).mapInArrow(run, schema)
