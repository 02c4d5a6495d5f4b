"""HTML documents as trees, and the trees as rows.

Parsing is the one step that needs Python: the markup of filings is repaired
by an incremental parser, one document at a time, and leaves as narrow rows
(nodes, table cells, text blocks) on which everything else is relational.
Repair follows the HTML rules for optional end tags; results need not agree
character for character with other parsers on damaged markup.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style head title noscript template ix:header ix:hidden".split())
INLINE = frozenset("a abbr b big cite code em font i img input label mark q s small span strike strong sub sup tt u var".split())
#: What a start tag closes when it is open (and not shielded by a table or list around it).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "thead": {"caption", "tr", "td", "th"}, "option": {"option"}}
SHIELDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}}


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Element | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        """This element and all below it, in document order, without recursion."""
        stack: list[Element] = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def all(self, *tags: str) -> list[Element]:
        return [e for e in self.walk() if e.tag in tags and e is not self]

    def strings(self, skip: frozenset[str] = SKIPPED) -> Iterator[str]:
        stack: list[Element | str] = [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                yield e
            elif e.tag not in skip:
                stack.extend(reversed(e.children))

    def text(self, between: str = "") -> str:
        return fold(between.join(self.strings()))

    def style(self) -> dict[str, str]:
        pairs = (p.split(":", 1) for p in self.attrs.get("style", "").split(";") if ":" in p)
        return {k.strip().lower(): v.strip().lower() for k, v in pairs}


def fold(text: str) -> str:
    """White space, non-breaking too, collapsed and trimmed."""
    return " ".join(text.split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#document")
        self.open = [self.root]
        self.paragraphs = 0  # open p elements

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._close_implied(tag)
        e = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)
            self.paragraphs += tag == "p"

    def _close(self, at: int) -> None:
        """Closes the open elements from ``at`` on."""
        if self.paragraphs:
            self.paragraphs -= sum(e.tag == "p" for e in self.open[at:])
        del self.open[at:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close(i)
                return
            if self.open[i].tag in ("table", "td", "th") and tag in INLINE | {"p", "div"}:
                return  # a stray end tag doesn't leave its cell

    def handle_data(self, data: str) -> None:
        if data:
            self.open[-1].children.append(data)

    def _close_implied(self, tag: str) -> None:
        if tag in BLOCK and self.paragraphs:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == "p":
                    self._close(i)
                    break
                if self.open[i].tag in BLOCK:
                    break
        if closes := CLOSES.get(tag):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in SHIELDS[tag]:
                    break
                if self.open[i].tag in closes:
                    self._close(i)
                    while self.open[-1].tag in closes:
                        self._close(len(self.open) - 1)
                    break


def parse(html: str) -> Element:
    """The document's tree.  An XML declaration is dropped; anything parses."""
    builder = _Builder()
    builder.feed(re.sub(r"^﻿?\s*<\?xml[^>]*\?>", "", html, count=1))
    builder.close()
    return builder.root


# -- tables ---------------------------------------------------------------------------


def tables(root: Element, nested: bool = False) -> list[Element]:
    """The tables of a tree; without nested ones, only outermost."""
    found = []
    stack = [root]
    while stack:
        e = stack.pop()
        if e.tag == "table":
            found.append(e)
            if not nested:
                continue
        stack.extend(c for c in reversed(e.children) if isinstance(c, Element))
    return found


def span(cell: Element, name: str) -> int:
    value = cell.attrs.get(name, "1").strip()
    return min(1000, max(1, int(value))) if value.isdigit() else 1


def rows(table: Element) -> list[tuple[str, list[Element]]]:
    """(section, cells) of each row, nested tables' rows left to them."""
    out = []
    stack: list[tuple[Element, str]] = [(table, "body")]
    while stack:
        e, section = stack.pop()
        if e.tag == "tr":
            out.append((section, [c for c in e.children if isinstance(c, Element) and c.tag in ("td", "th")]))
            continue
        for c in reversed(e.children):
            if isinstance(c, Element) and c.tag != "table":
                stack.append((c, {"thead": "head", "tfoot": "foot", "tbody": "body"}.get(c.tag, section)))
    return out


#: The months by which a cell is known for a date.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def is_figure(text: str) -> bool:
    """Whether a cell holds a grouped number that a sign in a column of its own may precede."""
    digits = sum(c.isdigit() for c in text)
    return "," in text and 2 * digits > len(text) and text[0] != "$" and not any(m in text.lower() for m in MONTHS)


def grid(table: Element) -> list[list[str]]:
    """Cell texts with spans laid out: a cell's text stands at its first place, the others are empty.

    Below two rows of headings a figure over two columns stands in the second,
    in line with figures that have a sign before them.
    """
    laid: list[dict[int, str]] = []
    held: dict[int, tuple[int, int]] = {}
    for place, (_, cells) in enumerate(rows(table)):
        line: dict[int, str] = {}
        at = 0
        taken = {c for c, (left, _) in held.items() if left > 0}
        for cell in cells:
            while at in taken:
                at += 1
            text = cell.text()
            line[at + (place > 1 and span(cell, "colspan") == 2 and is_figure(text))] = text
            for i in range(at, at + span(cell, "colspan")):
                if span(cell, "rowspan") > 1:
                    held[i] = (span(cell, "rowspan"), 0)
            at += span(cell, "colspan")
        width = max([at, *[c + 1 for c in taken]], default=0)
        laid.append({i: line.get(i, "") for i in range(width)})
        held = {c: (left - 1, 0) for c, (left, _) in held.items() if left > 1}
    width = max([len(line) for line in laid], default=0)
    return [[line.get(i, "") for i in range(width)] for line in laid]


PLACEHOLDERS = frozenset(("—", "–", "-", "--", "N/A", "n/a", "NM", "nm"))


def amount(text: str) -> float | None:
    """A cell's number: placeholders are 0, brackets negate; None for text."""
    shown = text.strip()
    if not shown:
        return None
    if shown in PLACEHOLDERS:
        return 0.0
    bare = re.sub(r"^[A-Z]{0,3}\$", "", shown)
    bare = re.sub(r"[$€£¥,%\s]", "", bare).replace("(", "-").replace(")", "")
    try:
        return float(bare) if re.fullmatch(r"-?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?|-?[0-9]+\.", bare) else None
    except ValueError:
        return None


def table_type(lines: list[list[str]], caption: str = "") -> str:
    """What a table holds, by its words and its share of numbers."""
    words = " ".join([caption, *(c for line in lines for c in line)]).lower()
    filled = [c for line in lines for c in line if c.strip()]
    if re.search(r"table of contents", words) or sum(bool(re.match(r"(?i)item\s+\d", c)) for c in filled) >= 4:
        return "TOC"
    if re.search(r"exhibit\s+(?:no\.?|number|index)", words):
        return "EXHIBIT_INDEX"
    numbers = sum(amount(c) is not None for c in filled)
    share = numbers / len(filled) if filled else 0.0
    if share > 0.3 and re.search(r"\$|total|assets|liabilities|revenue|income|cash|equity|shares|earnings|expenses?", words):
        return "FINANCIAL"
    if share > 0.5:
        return "METRICS"
    if re.search(r"incorporated (?:herein )?by reference|see note", words):
        return "REFERENCE"
    return "GENERAL"


MOST_COLUMNS, LEAST_TOTAL, LEAST_MEAN = 8, 5, 0.5
"""A rendered table has so many columns at most, of those whose cells tell enough, in total or a row."""


def telling(cell: str) -> int:
    """How much a cell tells: 3 from three characters on, else one for each letter or digit, and for a dollar sign."""
    bare = cell.strip()
    return 3 if len(bare) >= 3 else len(bare) * (bare.isalnum() or bare == "$")


def telling_columns(lines: list[list[str]]) -> list[int]:
    """The columns that a rendered table shows: those that tell most, in their order."""
    totals = {i: sum(telling(line[i]) for line in lines) for i in range(len(lines[0]) if lines else 0)}
    enough = [i for i, total in totals.items() if total >= LEAST_TOTAL or total >= LEAST_MEAN * len(lines)]
    return sorted(sorted(enough, key=lambda i: -totals[i])[:MOST_COLUMNS])


def shown_columns(cells_: DataFrame) -> DataFrame:
    """(ref, table_id, col, total) of the columns that rendering shows, from cell rows without spans."""
    from pyspark.sql import Window

    bare = F.trim("text")
    worth = F.when(F.length(bare) >= 3, 3).when(bare.rlike("^[\\p{L}\\p{N}]{1,2}$"), F.length(bare)).when(bare == "$", 1).otherwise(0)
    table = ["ref", "table_id"]
    height = F.count_distinct("row").alias("height")
    columns = cells_.groupBy(*table, "col").agg(F.sum(worth).cast("int").alias("total")).join(cells_.groupBy(*table).agg(height), table)
    enough = columns.where((F.col("total") >= LEAST_TOTAL) | (F.col("total") >= LEAST_MEAN * F.col("height")))
    place = F.row_number().over(Window.partitionBy(*table).orderBy(F.desc("total"), "col"))
    return enough.withColumn("place", place).where(F.col("place") <= MOST_COLUMNS).select(*table, "col", "total")


def render_table(lines: list[list[str]]) -> str:
    """Aligned text: the columns that tell most, lone currency signs joined to their number, numbers to the right."""
    merged = []
    width = max([len(line) for line in lines], default=0)
    lines = [line + [""] * (width - len(line)) for line in lines]
    for line in lines:
        out = list(line)
        for i in range(len(out)):
            if i + 1 < len(out) and out[i].strip() in ("$", "€", "£") and out[i + 1].strip():
                out[i + 1], out[i] = out[i].strip() + out[i + 1].strip(), ""
            if i and out[i].strip() in (")", "%", ")%") and out[i - 1].strip():
                out[i - 1], out[i] = out[i - 1].strip() + out[i].strip(), ""
        merged.append(out)
    kept = telling_columns(merged)
    cells = [[line[i].strip() for i in kept] for line in merged]
    cells = [line for line in cells if any(line)]
    if not cells:
        return ""
    widths = [max(len(line[i]) for line in cells) for i in range(len(kept))]
    right = [sum(amount(line[i]) is not None for line in cells[1:]) * 2 > sum(bool(line[i]) for line in cells[1:]) for i in range(len(kept))]
    shown = ["  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(line, widths, right, strict=True)).rstrip() for line in cells]
    rule = "  ".join("-" * w for w in widths)
    return "\n".join([shown[0], rule, *shown[1:]])


# -- text blocks -------------------------------------------------------------------


def blocks(root: Element) -> list[tuple[str, str, bool]]:
    """(kind, text, bold) of the text blocks in document order; kind is text, table, list or heading."""
    out: list[tuple[str, str, bool]] = []
    held: list[str] = []
    strong: list[bool] = []

    def flush(kind: str = "text") -> None:
        text = fold("".join(held))
        if text:
            out.append((kind, text, bool(strong) and all(strong)))
        held.clear()
        strong.clear()

    def visit(e: Element, bold: bool) -> None:
        # explicit stack: ("in", element, bold) and ("out", kind)
        stack: list[tuple] = [("in", e, bold)]
        while stack:
            step = stack.pop()
            if step[0] == "out":
                flush(step[1])
                continue
            if step[0] == "str":
                held.append(step[1])
                if step[1].strip():
                    strong.append(step[2])
                continue
            _, node, heavy = step
            if node.tag in SKIPPED:
                continue
            style = node.style()
            heavy = heavy or node.tag in ("b", "strong", "h1", "h2", "h3", "h4", "h5", "h6") or style.get("font-weight", "") in ("bold", "bolder", "700", "800", "900")
            if node.tag == "table":
                flush()
                text = render_table(grid(node))
                if text:
                    out.append(("table", text, False))
                continue
            if node.tag in ("ul", "ol"):
                flush()
                text = "\n".join(t for t in (li.text(" ") for li in node.children if isinstance(li, Element)) if t)
                if text:
                    out.append(("list", text, False))
                continue
            if node.tag == "br":
                held.append(" ")
                continue
            block = node.tag in BLOCK or style.get("display") == "block"
            if block:
                flush()
                stack.append(("out", "heading" if re.fullmatch("h[1-6]", node.tag) else "text"))
            stack.extend(("in", c, heavy) if isinstance(c, Element) else ("str", c, heavy) for c in reversed(node.children))

    visit(root, False)
    flush()
    return out


# -- rows ------------------------------------------------------------------------------


def per_document(docs: DataFrame, function: Callable[[str], list[tuple]], schema: str, *, ref: str = "ref", content: str = "content") -> DataFrame:
    """Rows (ref and ``schema``) that a Python function makes of each document.

    Documents are taken one by one, so a worker holds one tree at a time.
    Null contents give no rows.
    """
    names = [f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", schema)]
    empty = docs.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in empty.schema.fields]
    source = docs.select(F.col(ref).cast("string").alias("ref"), F.col(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                found = function(text) if text is not None else []
                if found:
                    at = pa.array([batch.column(0)[i].as_py()] * len(found), pa.string())
                    yield pa.RecordBatch.from_arrays([at, *[pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]], ["ref", *names])

    return source.mapInArrow(run, f"ref string, {schema}")


NODE = "node_id int, parent_id int, depth int, type string, level int, text string, bold boolean, href string, anchor string"


def _kind(e: Element) -> tuple[str, int]:
    if re.fullmatch("h[1-6]", e.tag):
        return "heading", int(e.tag[1])
    names = {"p": "paragraph", "table": "table", "ul": "list", "ol": "list", "li": "list_item", "a": "link", "img": "image", "section": "section", "#document": "document"}
    return names.get(e.tag, "container"), 0


def node_rows(html: str) -> list[tuple]:
    out: list[tuple] = []
    stack: list[tuple[Element, int, int, bool]] = [(parse(html), -1, 0, False)]
    while stack:
        e, parent, depth, bold = stack.pop()
        if e.tag in SKIPPED:
            continue
        kind, level = _kind(e)
        heavy = bold or e.tag in ("b", "strong") or kind == "heading" or e.style().get("font-weight") in ("bold", "700")
        own = len(out)
        direct = fold("".join(c for c in e.children if isinstance(c, str)))
        text = e.text() if kind in ("heading", "paragraph", "list_item", "link", "table") else direct
        out.append((own, parent if parent >= 0 else None, depth, kind, level, text, heavy, e.attrs.get("href"), e.attrs.get("id") or e.attrs.get("name")))
        stack.extend((c, own, depth + 1, heavy) for c in reversed(e.children) if isinstance(c, Element))
    return out


def nodes(docs: DataFrame, **columns: str) -> DataFrame:
    """The tree as rows: ref and NODE, in document order by node_id."""
    return per_document(docs, node_rows, NODE, **columns)


CELL = "table_id int, row int, col int, section string, is_header boolean, colspan int, rowspan int, text string, value double"


def cell_rows(html: str, nested: bool = True) -> list[tuple]:
    out = []
    for t, table in enumerate(tables(parse(html), nested=nested)):
        for r, (section, cells) in enumerate(rows(table)):
            at = 0
            for cell in cells:
                text = cell.text()
                out.append((t, r, at, section, cell.tag == "th" or section == "head", span(cell, "colspan"), span(cell, "rowspan"), text, amount(text)))
                at += span(cell, "colspan")
    return out


def cells(docs: DataFrame, *, nested: bool = True, **columns: str) -> DataFrame:
    """Table cells as rows: ref and CELL; without ``nested``, of outermost tables only."""
    return per_document(docs, partial(cell_rows, nested=nested), CELL, **columns)


TABLE = "table_id int, type string, n_rows int, n_cols int, caption string, text string, grid array<array<string>>, indents array<int>"


def indents(table: Element) -> list[int] | None:
    """White space before the first cell's text in each row that has cells; None where no row has any."""
    first = ["".join(cells[0].strings()) for _, cells in rows(table) if cells]
    found = [len(text) - len(text.lstrip()) for text in first]
    return found if any(found) else None


def table_rows(html: str) -> list[tuple]:
    out = []
    for t, table in enumerate(tables(parse(html), nested=True)):
        lines = grid(table)
        caption = " ".join(c.text() for c in table.children if isinstance(c, Element) and c.tag == "caption")
        out.append((t, table_type(lines, caption), len(lines), max([len(x) for x in lines], default=0), caption, render_table(lines), lines, indents(table)))
    return out


def document_tables(docs: DataFrame, **columns: str) -> DataFrame:
    """Tables as rows: ref and TABLE."""
    return per_document(docs, table_rows, TABLE, **columns)


def total_rows(cells_: DataFrame) -> DataFrame:
    """Rows of tables that sum up: their first text says total."""
    first = cells_.where("text <> ''").groupBy("ref", "table_id", "row").agg(F.min_by("text", "col").alias("label"))
    return first.where(F.lower("label").rlike("^(?:sub)?total|\\btotal$"))


BLOCKS = "block int, kind string, text string, bold boolean"


def text_blocks(docs: DataFrame, **columns: str) -> DataFrame:
    """Text blocks as rows: ref and BLOCKS."""
    return per_document(docs, lambda html: [(i, *b) for i, b in enumerate(blocks(parse(html)))], BLOCKS, **columns)


def document_text(docs: DataFrame, *, tables: bool = True, most: int | Column | None = None, **columns: str) -> DataFrame:
    """(ref, text): a document's blocks with blank lines between, navigation lines that repeat left out.

    Without ``tables`` their blocks are left out; ``most`` (a column: of ``ref``) shortens a text at a sentence, line or word.
    """
    from filingloom.functions.text import shortened
    from filingloom.operators.windows import navigation_lines

    found = text_blocks(docs, **columns)
    found = found if tables else found.where("kind <> 'table'")
    lines = navigation_lines(found.withColumn("line", F.lower("text")), by=["ref"], order="block", line="line", least=5, keep=2)
    whole = F.array_join(F.array_sort(F.collect_list(F.struct("block", "text")))["text"], "\n\n")
    return lines.groupBy("ref").agg((whole if most is None else shortened(whole, most)).alias("text"))
