"""Sections of filings.

Four ways to find them: anchors of a linked table of contents, headings that
follow a form's catalogue, item labels carried down over text chunks, and the
page ranges of a cross-reference index.  A document's markup is read once by
Python into marks, chunks or slices; labels, ends, ranks and choices are
window functions and joins.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.functions.names import section_title
from filingloom.operators import forms, windows
from filingloom.operators.html_tree import SKIPPED, Element, blocks, fold, parse, per_document

#: How filings label items, parts and signatures.
ITEM = re.compile(r"(?i)^item\s+(\d{1,2}(?:\.\d{2})?[A-Z]?)\b\.?")
PART = re.compile(r"(?i)^part\s+([IVXLC]+)\b")
SIGNATURES = re.compile(r"^SIGNATURES?\b")

# -- chunks -----------------------------------------------------------------------------

CHUNK = "chunk int, text string, is_table boolean"


def without_page_furniture(root: Element) -> Element:
    """Drops links back to the contents and numbered spans that form a run of page numbers."""
    for a in root.all("a"):
        if re.search(r"Table [Oo]f [cC]ontents", a.text()) and a.parent:
            a.children.clear()
    run: list[Element] = []
    last = None

    def drop() -> None:
        if len(run) > 1:
            for e in run:
                e.children.clear()

    for s in root.all("span"):
        text = "".join(c for c in s.children if isinstance(c, str))
        if not re.fullmatch(r"\d{1,3}", text) or s.all("a"):
            continue
        if last is not None and int(text) != last + 1:
            drop()
            run.clear()
        run.append(s)
        last = int(text)
    drop()
    return root


Blocks = list[tuple[str, str, bool]]


def chunk_rows(html: str) -> list[tuple[int, str, bool]]:
    return chunks_of(blocks(without_page_furniture(parse(html))))


def chunks_of(found: Blocks) -> list[tuple[int, str, bool]]:
    """Runs of blocks: a table or list stands alone, an item or part begins a new run, long text ends one."""
    out: list[tuple[int, str, bool]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            out.append((len(out), "\n".join(held), False))
            held.clear()

    for kind, text, _ in found:
        if kind in ("table", "list"):
            flush()
            out.append((len(out), text, kind == "table"))
        elif PART.match(text) and len(text) < 200:
            flush()
            out.append((len(out), text, False))
        else:
            if ITEM.match(text) or SIGNATURES.match(text):
                flush()
            held.append(text)
            if len(text.split()) > 25:
                flush()
    flush()
    return out


def chunks(docs: DataFrame, **columns: str) -> DataFrame:
    """(ref, chunk, text, is_table) in document order."""
    return per_document(docs, chunk_rows, CHUNK, **columns)


def item_sections(docs: DataFrame, *, item_label: str = windows.ITEM_LABEL, **columns: str) -> DataFrame:
    """(ref, item, place, title, text): items by their labels, carried down over chunks."""
    labelled = windows.chunk_labels(chunks(docs, **columns), item_label=item_label)
    found = windows.sections_of_chunks(labelled)
    return found.select("ref", "item", "place", section_title(F.col("text")).alias("title"), "text")


# -- contents ------------------------------------------------------------------------------

MARK = "place int, label string, item string, part string, anchor string, length int, text string, method string, confidence double"


def _linear(root: Element) -> tuple[list[tuple[Element, int]], str]:
    """Elements with the offset of their text in the document's text, and that text."""
    found: list[tuple[Element, int]] = []
    parts: list[str] = []
    at = 0
    stack: list[Element | str] = [root]
    while stack:
        e = stack.pop()
        if isinstance(e, str):
            parts.append(e)
            at += len(e)
            continue
        if e.tag in SKIPPED:
            continue
        if e.tag not in ("a", "b", "i", "u", "span", "font", "strong", "em", "sup", "sub"):
            parts.append("\n")
            at += 1
        found.append((e, at))
        stack.extend(reversed(e.children))
    return found, "".join(parts)


def _row_label(link: Element) -> str:
    """Text of the table row a link stands in, or its own."""
    e: Element | None = link
    for _ in range(6):
        if e is None:
            break
        if e.tag == "tr":
            return e.text(" ")
        e = e.parent
    return link.text()


def contents(root: Element) -> list[tuple[str, str, str | None, str | None]]:
    """(anchor, label, item, part) of the links that a table of contents gives, in their order."""
    entries: dict[str, list] = {}
    part: str | None = None
    for a in root.all("a"):
        href = a.attrs.get("href", "").strip()
        text = a.text()
        if not href.startswith("#") or len(href) < 2 or not text:
            continue
        row = _row_label(a)
        if (m := PART.match(text)) and not re.search(r"(?i)item\s+\d", text):
            part = m[1].upper()
            continue
        item = next((m[1].upper() for t in (text, row) if (m := ITEM.match(t))), None)
        if item is None and (m := re.search(r"(?i)item[_\s-]*(\d+)([a-z]?)(?![a-z])", href)):
            item = (m[1] + m[2]).upper()
        held = entries.setdefault(href[1:], [text, item, part])
        if held[0] != text:
            held[0] = f"{held[0]} {text}"
        held[1] = held[1] or item
    return [(anchor, label, item, p) for anchor, (label, item, p) in entries.items()]


def mark_rows(html: str) -> list[tuple]:
    return marks_of(parse(html))


def marks_of(root: Element) -> list[tuple]:
    """Sections that a linked table of contents points at, each to the next one's start."""
    linear, text = _linear(root)
    targets = {}
    for e, at in linear:
        for name in ("id", "name"):
            if e.attrs.get(name):
                targets.setdefault(e.attrs[name], at)
    named = [(targets[anchor], label, item, part, anchor) for anchor, label, item, part in contents(root) if anchor in targets]
    items = [n for n in named if n[2]]
    if len(items) < 2:
        return []
    items.sort(key=lambda n: n[0])
    out = []
    for i, (at, label, item, part, anchor) in enumerate(items):
        end = items[i + 1][0] if i + 1 < len(items) else len(text)
        own = "\n".join(t for t in (fold(x) for x in text[at:end].split("\n")) if t)
        out.append((at, label, item, part, anchor, len(own), own, "toc", 0.95))
    return out


def bounds_of(root: Element) -> list[tuple[int, int, int]]:
    """(start, stop, entries) of the linked table of contents in the document's text: from its first link to the end of its last."""
    linear, text = _linear(root)
    targets = {e.attrs[name] for e, _ in linear for name in ("id", "name") if e.attrs.get(name)}
    wanted = {anchor for anchor, _, item, _ in contents(root) if item and anchor in targets}
    links = [(at, at + len("".join(e.strings()))) for e, at in linear if e.tag == "a" and e.attrs.get("href", "").strip()[1:] in wanted and e.text()]
    return [(min(a for a, _ in links), max(b for _, b in links), len(wanted))] if len(wanted) > 1 else []


def contents_bounds(docs: DataFrame, **columns: str) -> DataFrame:
    """(ref, start, stop, entries): where a document's linked table of contents lies in its text."""
    return per_document(docs, lambda html: bounds_of(parse(html)), "start int, stop int, entries int", **columns)


def contents_sections(docs: DataFrame, **columns: str) -> DataFrame:
    """(ref and MARK) of documents with a linked table of contents."""
    return per_document(docs, mark_rows, MARK, **columns)


def pattern_rows(form: str) -> Callable[[str], list[tuple]]:
    """Function from a document to its sections by headings that follow a form's catalogue."""
    by_headings = patterns_of(form)
    return lambda html: by_headings(blocks(without_page_furniture(parse(html))))


def patterns_of(form: str) -> Callable[[Blocks], list[tuple]]:
    """The same from a document's blocks."""
    catalogue = [(p, n, t) for p, own in forms.FORMS.get(form, {}).items() for n, t in own.items()]
    prospectus = form.startswith("424B")

    def title_words(text: str) -> list[str]:
        return re.findall(r"[a-z]+", text.lower())

    def header_of(text: str, strong: bool, part: str | None) -> tuple[str, str | None] | None:
        if prospectus:
            name = next((t for t in forms.PROSPECTUS if text.upper() == t.upper()), None)
            return (name, None) if name else None
        if m := ITEM.match(text):
            number = m[1].upper()
            if any(n == number for _, n, _ in catalogue):
                return number, part
            return None
        if strong and len(text) < 120:
            for p, n, t in catalogue:
                lead = title_words(t)[:2]
                if lead and title_words(text)[: len(lead)] == lead and (part is None or not p or p == part):
                    return n, p or part
        return None

    def rows(shown: Blocks) -> list[tuple]:
        found: list[list] = []
        part: str | None = None
        own: list[str] = []
        for kind, text, bold in shown:
            if kind == "text" and len(text) < 200 and (m := PART.match(text)):
                part = m[1].upper()
            head = header_of(text, bold or kind == "heading", part) if kind in ("text", "heading") and len(text) < 500 else None
            if head is None and SIGNATURES.match(text):
                own = []
                continue
            if head is not None:
                own = [text]
                found.append([head[0], head[1], text, own])
            else:
                own.append(text)
        best: dict[tuple, list] = {}
        for i, (item, p, label, lines) in enumerate(found):
            size = sum(map(len, lines))
            key = (item, p if form == "10-Q" else None)
            if key not in best or size > best[key][0]:  # the entry of a contents list is shorter than the section
                best[key] = [size, i, item, p, label, lines]
        return [(i, label, item, p, None, size, "\n".join(lines), "pattern", 0.7) for size, i, item, p, label, lines in sorted(best.values(), key=lambda b: b[1])]

    return rows


def pattern_sections(docs: DataFrame, form: str = "10-K", **columns: str) -> DataFrame:
    """(ref and MARK) by a form's headings."""
    return per_document(docs, pattern_rows(form), MARK, **columns)


SHORT = 200
"""A section of fewer characters that the contents point at is looked for again among the headings."""
WAY = "place int, label string, given_item string, given_part string, text string, method string, confidence double"


def way_rows(form: str) -> Callable[[str], list[tuple]]:
    """Function from a document to rows of the best way that finds its sections: linked contents, headings, or chunks whose labels are carried down later."""
    by_headings = patterns_of(form)

    def rows(html: str) -> list[tuple]:
        root = parse(html)
        marks = marks_of(root)
        if marks and all(m[5] >= SHORT for m in marks):
            return [(at, label, item, part, text, method, sure) for at, label, item, part, _, _, text, method, sure in marks]
        shown = blocks(without_page_furniture(root))
        headed = [(at, label, item, part, text, method, sure) for at, label, item, part, _, _, text, method, sure in by_headings(shown)]
        if not marks:
            return headed or [(at, None, None, None, text, "chunks", 0.6) for at, text, _ in chunks_of(shown)]
        out = []
        for at, label, item, part, _, size, text, method, sure in marks:
            # the section's own heading is known, so what headings find for it counts as surely as the contents
            longer = max((h for h in headed if h[2] == item and (part is None or h[3] in (None, part))), key=lambda h: len(h[4]), default=None) if size < SHORT else None
            if longer and len(longer[4]) > size:
                text, method = longer[4], longer[5]
            out.append((at, label, item, part, text, method, sure))
        return out

    return rows


def sections(docs: DataFrame, form: str = "10-K", *, least: float = 0.6, **columns: str) -> DataFrame:
    """(ref, item, part, place, title, text, method, confidence): the best sections of each document.

    A linked table of contents is preferred, then headings, then carried-down
    item labels, all tried in one reading of the document; sections below the
    confidence ``least`` are dropped.  Only the sections' text is exchanged, once,
    by document.
    """
    rows = windows.chunk_labels(per_document(docs, way_rows(form), WAY, **columns), order="place")
    carried = F.col("method") == "chunks"
    item = F.when(carried, F.upper(F.regexp_replace("item", "(?i)^item\\s+", ""))).otherwise(F.col("given_item"))
    rows = rows.where(~carried | ((F.col("item") != "") & ~F.col("toc") & (F.trim("text") != "")))
    rows = rows.select("ref", item.alias("item"), "place", "text", "label", "method", "confidence", F.when(~carried, F.col("given_part")).alias("part"), F.when(~carried, F.col("place")).alias("own"))
    # chunks of an item are one section; the others are one already
    whole = rows.groupBy("ref", "item", "part", "method", "confidence", "own").agg(F.min("place").alias("place"), F.max("label").alias("label"), F.array_join(F.array_sort(F.collect_list(F.struct("place", "text")))["text"], "\n").alias("text"))
    named = whole.withColumn("title", F.coalesce(F.left("label", F.lit(100)), section_title(F.col("text"))))
    return best_sections(named).where(F.col("confidence") >= least)


def best_sections(rows: DataFrame) -> DataFrame:
    """Of sections with one item and part in a document the most confident; agreement of several methods raises it by 15 %."""
    grouped = rows.groupBy("ref", "item", "part").agg(F.max_by(F.struct("place", "title", "text", "method", "confidence"), F.struct("confidence", F.length("text"), -F.col("place"))).alias("s"), F.countDistinct("method").alias("methods"))
    raised = F.when(F.col("methods") > 1, F.least(F.col("s.confidence") * 1.15, F.lit(1.0))).otherwise(F.col("s.confidence"))
    return grouped.select("ref", "item", "part", "s.place", "s.title", "s.text", "s.method", raised.alias("confidence"))


def section(docs: DataFrame, key: str, form: str = "10-K", **columns: str) -> DataFrame:
    """(ref, text) of one item, asked for as "Item 7", "7" or by name; cross-referenced pages come before chunks."""
    number = forms.item_number(key)
    if number is None:
        raise ValueError(f"unknown section {key!r}")
    columns = {"ref": "ref", "content": "content"} | columns
    source = docs.select(F.col(columns["ref"]).cast("string").alias("ref"), F.col(columns["content"]).alias("content"))
    found = sections(source, form).where((F.col("item") == number) & (F.trim("text") != ""))
    pages = cross_reference_sections(source).where(F.col("item") == number)
    own = found.select("ref", "text", F.when(F.col("method") == "chunks", 2).otherwise(0).alias("rank"), "place")
    both = own.unionByName(pages.select("ref", "text", F.lit(1).alias("rank"), "place"))
    best = both.groupBy("ref").agg(F.min_by("text", F.struct("rank", "place")).alias("text"))
    return best.select("ref", F.rtrim(F.regexp_replace("text", "(?is)\\n\\s*PART\\s+[IVXLC]+\\b[^\\n]*$", "")).alias("text"))


def items_of(sections_: DataFrame, pattern: str) -> DataFrame:
    """Adds ``label``: the pattern's group at a title's start, else the text before " - ", else the title."""
    start = F.regexp_extract("title", f"^(?:{pattern})", 1)
    before = F.trim(F.substring_index("title", " - ", 1))
    return sections_.withColumn("label", F.when(start != "", start).when(F.contains("title", F.lit(" - ")), before).otherwise(F.col("title")))


# -- cross-reference index ----------------------------------------------------------------------

INDEX = "place int, item string, title string, part string, pages array<struct<start: int, stop: int>>"
#: Title of a cross-reference index and the markup of a page break.
HEADING = re.compile(r"(?i)FORM\s+10-K\s+CROSS[- ]?REFERENCE\s+INDEX")
BREAK = re.compile(r'(?i)<(?:hr|div)\s[^>]*style="[^"]*page-break-after\s*:\s*always[^"]*"[^>]*>')


def ranges_of(text: str) -> list[tuple[int, int]]:
    """Page ranges as in names.page_ranges."""
    out = []
    for part in re.sub("[–—]", "-", text).split(","):
        bare = re.sub(r"\([^)]*\)", "", part).strip()
        if m := re.fullmatch(r"(\d+)\s*(?:-\s*(\d+))?", bare):
            out.append((int(m[1]), int(m[2] or m[1])))
    return out


def index_entries(html: str) -> list[tuple]:
    """(place, item, title, part, pages) of a cross-reference index's table."""
    heads = list(HEADING.finditer(html))
    if not heads:
        return []
    at = heads[-1].start()
    inside = html.rfind("<table", max(0, at - 5000), at)
    if inside < 0 or "</table>" in html[inside:at]:
        inside = html.find("<table", at)
    end = html.find("</table>", inside) if inside >= 0 else -1
    if inside < 0 or end < 0:
        return []
    entries: list[list] = []
    part = None
    for tr in parse(html[inside : end + 8]).all("tr"):
        texts = [t for t in (c.text() for c in tr.all("td", "th")) if t]
        if not texts:
            continue
        if m := re.match(r"(?i)part\s+([IV]+)\b", texts[0]):
            part = m[1].upper()
        elif m := re.fullmatch(r"(?i)(?:item\s+)?(\d+[A-Z]?)\.?", texts[0]):
            entries.append([m[1].upper(), texts[1] if len(texts) > 1 else "", part, ranges_of(texts[2]) if len(texts) > 2 else []])
        elif entries and re.fullmatch(r"[\d,\s.\-–—]+", " ".join(texts)):
            entries[-1][3] += ranges_of(" ".join(texts))
    return [(i, item, title, p, [{"start": a, "stop": b} for a, b in pages]) for i, (item, title, p, pages) in enumerate(entries)]


def cross_reference_index(docs: DataFrame, **columns: str) -> DataFrame:
    """(ref and INDEX) of documents with such an index; other documents aren't parsed."""
    content = columns.get("content", "content")
    return per_document(docs.where(F.col(content).rlike("(?i)FORM\\s+10-K\\s+CROSS[- ]?REFERENCE\\s+INDEX")), index_entries, INDEX, **columns)


def page_rows(html: str) -> list[tuple]:
    """Items whose text lies on the pages that the index names."""
    starts = [0, *sorted(m.end() for m in BREAK.finditer(html))]
    out = []
    for place, item, title, _, pages in index_entries(html):
        parts = []
        for r in pages:
            if 1 <= r["start"] <= r["stop"] <= len(starts):
                stop = starts[r["stop"]] if r["stop"] < len(starts) else len(html)
                parts.append("\n\n".join(t for _, t, _ in blocks(parse(html[starts[r["start"] - 1] : stop]))))
        text = "\n".join(parts)
        if text.strip():
            out.append((place, item, title[:100], text))
    return out


def cross_reference_sections(docs: DataFrame, **columns: str) -> DataFrame:
    """(ref, place, item, title, text) by the page ranges of the index."""
    content = columns.get("content", "content")
    return per_document(docs.where(F.col(content).rlike("(?i)FORM\\s+10-K\\s+CROSS[- ]?REFERENCE\\s+INDEX")), page_rows, "place int, item string, title string, text string", **columns)


# -- named sections -------------------------------------------------------------------------------


def likeness(a: str, b: str) -> float:
    """1 - edit distance / longer length."""
    a, b = a.strip().lower(), b.strip().lower()
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return 1 - before[-1] / max(len(a), len(b))


def score(name: str, label: str) -> float:
    """1 if the label holds the name, else their likeness; hopeless pairs are told by shared letters first."""
    if name.strip().lower() in label.lower():
        return 1.0
    if difflib.SequenceMatcher(None, name.lower(), label.lower()).real_quick_ratio() < 0.6:
        return 0.0
    return likeness(name, label)


def named_sections(html: str, names: list[str], siblings: dict[str, str] | None = None) -> dict[str, str]:
    """Sections by name: boundaries are headings and what the contents link to.

    An item runs to the next boundary that names another item, any other
    section to the next boundary.  A name that only links into a sibling
    document is looked for there; else the plain text is searched.
    """
    root = parse(html)
    linear, text = _linear(root)
    bodies = [e for e in root.all("body")]
    first = next((at for e, at in linear if bodies and e is bodies[0]), 0)
    links: dict[str, str] = {}
    elsewhere: list[tuple[str, str]] = []
    for a in root.all("a"):
        href, label = a.attrs.get("href", ""), a.text()
        if not href or not label:
            continue
        if href.startswith("#"):
            links[href[1:]] = f"{links[href[1:]]} {label}" if href[1:] in links else label
        else:
            elsewhere.append((href, label))
    marks: list[list] = []
    for e, at in linear:
        label = None
        if re.fullmatch("h[1-6]", e.tag):
            label = e.text()
        for key in (e.attrs.get("id"), e.attrs.get("name")):
            if key and key in links:
                label = f"{links[key]} {re.sub('[_-]+', ' ', key)}"
        if label is None or at < first:
            continue
        if marks and not text[marks[-1][0] : at].strip():
            marks[-1][1] = marks[-1][1] or label
        else:
            marks.append([at, label])

    def item(label: str) -> str | None:
        m = re.search(r"(?i)\bitem\s+(\d+[a-z]?)\b", label)
        return m[1].lower() if m else None

    out: dict[str, str] = {}
    for name in names:
        scored = [(score(name, label), -i) for i, (_, label) in enumerate(marks) if label]
        if scored and max(scored)[0] > 0.6:
            i = -max(scored)[1]
            own = item(marks[i][1])
            after = (m for m in marks[i + 1 :] if own is None or item(m[1]) not in (None, own))
            out[name] = fold(text[marks[i][0] : next(after, [len(text)])[0]])
            continue
        outside = [(score(name, label), -i) for i, (_, label) in enumerate(elsewhere)]
        if outside and max(outside)[0] > 0.6 and siblings:
            file = elsewhere[-max(outside)[1]][0].split("#")[0]
            if file in siblings and (found := named_sections(siblings[file], [name])).get(name):
                out[name] = found[name]
                continue
        plain = fold(text[first:])
        if m := re.search(r"\s+".join(re.escape(w) for w in name.split()), plain, re.IGNORECASE) if name.strip() else None:
            out[name] = plain[m.start() :]
    return out


def extract_sections(docs: DataFrame, names: list[str], siblings: DataFrame | None = None, **columns: str) -> DataFrame:
    """(ref, name, text): named sections of each document; ``siblings`` (ref, document, content) resolve links to other files of a filing."""
    columns = {"ref": "ref", "content": "content"} | columns
    if siblings is None:
        return per_document(docs, lambda html: list(named_sections(html, names).items()), "name string, text string", **columns)
    files = siblings.groupBy(F.col("ref").cast("string").alias("ref")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("document", "content")))).alias("files"))
    source = docs.select(F.col(columns["ref"]).cast("string").alias("ref"), F.col(columns["content"]).alias("content")).join(files, "ref", "left")
    packed = source.select("ref", F.to_json(F.struct("content", F.coalesce("files", F.lit("{}")).alias("files"))).alias("content"))

    def find(text: str) -> list[tuple]:
        import json

        both = json.loads(text)
        return list(named_sections(both.get("content", ""), names, json.loads(both["files"])).items())

    return per_document(packed, find, "name string, text string")


# -- annual information forms --------------------------------------------------------------------------


def aif_rows(html: str) -> list[tuple[int, str, str]]:
    """(place, item, text) of a Canadian annual information form.

    Each heading's first occurrence counts that is neither a contents line nor
    a reference and lies behind the front pages; one within 200 characters of
    the last is left out.
    """
    text = _linear(parse(html))[1]
    front = min(max(5000, round(0.03 * len(text))), 10_000)
    found = []
    for pattern in forms.ANNUAL_INFORMATION:
        for m in re.finditer(pattern, text, re.IGNORECASE):
            if m.start() < front:
                continue
            after, before = text[m.end() : m.end() + 300], text[max(0, m.start() - 80) : m.start()]
            listed = re.match(r"[\s.]*\d{1,3}(?:\s|$)", after) or len(re.findall(r"(?m)^\s*\d{1,3}\s*$", after)) >= 2
            line = before.rsplit("\n", 1)[-1]
            cited = re.search(r"[\"“”]\s*$|(?i:\b(?:see|under|in))\s*[\"“]?\s*$|[a-z][,;:]?\s+$", line)
            if not listed and not cited:
                found.append((m.start(), fold(m[0]).title()))
                break
    found.sort()
    kept: list[tuple[int, str]] = []
    for at, name in found:
        if not kept or at - kept[-1][0] >= 200:
            kept.append((at, name))
    ends = [at for at, _ in kept[1:]] + [len(text)]
    return [(at, name, fold(text[at:end])) for (at, name), end in zip(kept, ends, strict=True)]


def aif_sections(docs: DataFrame, **columns: str) -> DataFrame:
    """(ref, place, item, text) of annual information forms."""
    return per_document(docs, aif_rows, "place int, item string, text string", **columns)
