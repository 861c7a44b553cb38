"""Visible text of web pages, laid out by blocks, lists and tables.

A tokenizer and a tree builder with implied tags make a tree of any depth; a renderer walks it, leaves
out what is not displayed, and keeps block spacing, list marks and table columns. The parts of the renderer
are generators that yield the parts inside them, and `run_parts` keeps those on a stack of its own.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# ---- fixed values of the HTML standard ----
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HEAD_ONLY = set("base link meta title style script noscript template".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SPACED = set("p ul ol dl table blockquote pre figure fieldset menu dir hr".split()) | HEADINGS
BLOCK = SPACED | set("address article aside body center details dialog div dd dt figcaption footer form header "
                     "hgroup html legend li main nav optgroup option section summary search caption tr".split())
ENDS_P = (BLOCK - set("body html option optgroup legend tr caption".split())) | {"hr"}
HIDDEN = set("head script style template noscript iframe object audio video canvas svg math datalist "
             "noembed noframes rp param".split())
# An opening tag closes these open elements, up to the nearest element of the second set.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
SCOPE = set("table td th caption button object template html".split())
UNSHIELDED = SCOPE | set("tr tbody thead tfoot body".split())  # their end tags reach through elements of SCOPE

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag = tag
        self.attrs = attrs or {}
        self.children: list[Node | str] = []


def build(source: str) -> Node:
    """Tree of a page; every text of the page is somewhere in it."""
    root = Node("html")
    open_nodes = [root]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements below the root, by tag

    def open_node(node: Node) -> None:
        places[node.tag].append(len(open_nodes))
        open_nodes.append(node)

    def close(upto: int) -> None:
        while len(open_nodes) > max(1, upto):
            places[open_nodes.pop().tag].pop()

    def last(tags: set[str]) -> int:
        """Place of the innermost open element of `tags`, or 0."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close_implied(tags: set[str], stops: set[str]) -> None:
        """Close the outermost of `tags` that no element of `stops` shields."""
        stop = last(stops)
        found = [places[t][bisect_right(places[t], stop)] for t in tags if places.get(t) and places[t][-1] > stop]
        if found:
            close(min(found))

    def add_text(text: str) -> None:
        if not text:
            return
        if open_nodes[-1].tag == "head" and text.strip():
            close(len(open_nodes) - 1)
        open_nodes[-1].children.append(html.unescape(text))

    at = 0
    while at < len(source):
        found = TOKEN.search(source, at)
        if not found:
            add_text(source[at:])
            break
        add_text(source[at:found.start()])
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        if found["end"] or found["end2"]:
            start = last(HEADINGS if tag in HEADINGS else {tag})
            if start and (tag in UNSHIELDED or start > last(SCOPE)):
                close(start)
            continue
        raw = found["attrs"] if found["tag"] else found["attrs2"]
        attrs = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(raw)} if raw else {}
        if places.get("head") and tag not in HEAD_ONLY and tag != "head":
            close(places["head"][0])
        if tag in ("html", "body"):  # the element is there already, or its parts are
            if tag == "body" and not places.get("body"):
                node = Node(tag, attrs)
                open_nodes[-1].children.append(node)
                open_node(node)
            continue
        if tag in IMPLIED_END:
            close_implied(*IMPLIED_END[tag])
        if tag in ENDS_P:
            start = last({"p"})
            if start > last(SCOPE):
                close(start)
        if tag in HEADINGS and open_nodes[-1].tag in HEADINGS:
            close(len(open_nodes) - 1)
        node = Node(tag, attrs)
        open_nodes[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(source, at)
            body = source[at:end.start()] if end else source[at:]
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            at = source.find(">", end.start()) + 1 if end else len(source)
            at = at or len(source)
            continue
        open_node(node)
    return root


def shown(node: Node) -> bool:
    attrs = node.attrs
    return not (node.tag in HIDDEN or "hidden" in attrs or node.tag == "dialog" and "open" not in attrs
                or node.tag == "input" and attrs.get("type", "").lower() == "hidden"
                or "style" in attrs and NOT_SHOWN.search(attrs["style"]))


class Page:
    """Lines of text with collapsed spaces; blank lines between spaced blocks never add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = False
        self.mark, self.indent = "", 0  # the mark stands at the end of the indent of the next line

    def text(self, text: str) -> None:
        words = SPACES.sub(" ", text)
        if words[:1] == " ":
            self.space = True
        inner = words.strip(" ")
        if inner:
            if self.space and self.parts:
                self.parts.append(" ")
            self.parts.append(inner)
            self.space = words[-1] == " "

    def end_line(self, keep_empty: bool = False) -> None:
        if self.parts or keep_empty:
            if self.gap and self.lines and not keep_empty:
                self.lines.append("")
            self.gap = False
            line = "".join(self.parts)
            first = " " * (self.indent - len(self.mark)) + self.mark
            self.lines.append((first + line).rstrip() if line or self.mark else "")
            self.mark = ""
            self.parts = []
        self.space = False

    def add_lines(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            self.parts = [line]
            self.end_line(not line)

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced


def run_parts(part: Iterator) -> None:
    """Run a part of the renderer and all that it yields, at any depth."""
    stack = [part]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def render(node: Node, page: Page) -> Iterator:
    for child in node.children:
        if isinstance(child, str):
            page.text(child)
            continue
        tag = child.tag
        if not shown(child) or tag == "title":
            continue
        if tag == "br":
            page.end_line(not page.parts)
        elif tag == "hr":
            page.block(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            page.block(not page.indent)
            number = int(child.attrs.get("start", "1")) if re.fullmatch(r"-?\d{1,9}", child.attrs.get("start", "1")) else 1
            for item in child.children:
                if isinstance(item, Node) and item.tag == "li" and shown(item):
                    mark = f"{number}. " if tag == "ol" else "- "
                    number += 1
                    page.end_line()
                    before = page.indent
                    page.mark, page.indent = mark, page.indent + len(mark)
                    yield render(item, page)
                    page.end_line()
                    page.mark, page.indent = "", before
                elif isinstance(item, Node):
                    holder = Node("div")
                    holder.children = [item]
                    yield render(holder, page)
                else:
                    page.text(item)
            page.block(not page.indent)
        elif tag == "table":
            page.block(True)
            yield table(child, page)
            page.block(True)
        elif tag in ("pre", "textarea", "xmp", "listing"):
            page.block(True)
            text = plain(child)
            page.add_lines(text.strip("\n").split("\n") if text.strip() else [])
            page.block(True)
        elif tag == "details" and "open" not in child.attrs:
            page.block(False)
            for part in child.children:
                if isinstance(part, Node) and part.tag == "summary" and shown(part):
                    yield render(part, page)
                    page.block(False)
                    break
        elif tag == "input":
            if child.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search"):
                page.text(f" {child.attrs.get('value', '')} ")
        elif tag == "q":
            page.text('"')
            yield render(child, page)
            page.text('"')
        elif tag in BLOCK:
            page.block(tag in SPACED)
            if tag in ("blockquote", "dd"):
                before = page.indent
                page.mark, page.indent = "", page.indent + 2
                yield render(child, page)
                page.end_line()
                page.mark, page.indent = "", before
            else:
                yield render(child, page)
            page.block(tag in SPACED)
        else:
            yield render(child, page)


def plain(node: Node) -> str:
    out = []
    left = node.children[::-1]
    while left:
        child = left.pop()
        if isinstance(child, str):
            out.append(child)
        elif child.tag == "br":
            out.append("\n")
        elif shown(child):
            left.extend(child.children[::-1])
    return "".join(out)


def span(cell: Node) -> int:
    wide = cell.attrs.get("colspan", "1").strip()
    return min(1000, max(1, int(wide))) if wide.isdecimal() and len(wide) < 9 else 1


def row_span(cell: Node) -> int:
    """Rows that a cell takes; 0 is all that are left of its group."""
    tall = cell.attrs.get("rowspan", "1").strip()
    return min(65_534, int(tall)) if tall.isdecimal() and len(tall) < 9 else 1


def table(node: Node, page: Page) -> Iterator:
    """Rows of cells in columns as wide as their widest cell; cells may have several lines.

    A cell takes the first column that no cell of an earlier row of its group reaches into; its text
    stands in its first row, and its columns stay blank in the others.
    """
    rows: list[list[tuple[int, list[str], int]]] = []
    rest: list[Node | str] = []
    busy: dict[int, float] = {}  # first row below the cell that takes a column

    def collect(parent: Node) -> Iterator:
        for child in parent.children:
            if isinstance(child, str):
                if child.strip():
                    rest.append(child)
            elif not shown(child):
                continue
            elif child.tag == "caption":
                yield render(child, page)
                page.end_line()
            elif child.tag in ("thead", "tbody", "tfoot", "colgroup"):
                busy.clear()
                yield collect(child)
                busy.clear()
            elif child.tag == "tr":
                cells, at = [], 0
                for cell in child.children:
                    if isinstance(cell, Node) and cell.tag in ("td", "th") and shown(cell):
                        inner = Page()
                        yield render(cell, inner)
                        inner.end_line()
                        while busy.get(at, 0) > len(rows):
                            at += 1
                        wide, tall = span(cell), row_span(cell)
                        cells.append((at, inner.lines or [""], wide))
                        if tall != 1:
                            end = len(rows) + tall if tall else float("inf")
                            busy.update((i, max(end, busy.get(i, 0))) for i in range(at, at + wide))
                        at += wide
                    elif isinstance(cell, Node) or cell.strip():
                        rest.append(cell)
                rows.append(cells)
            else:
                rest.append(child)

    yield collect(node)
    if rest:  # what is not in a cell stands before the table
        holder = Node("div")
        holder.children = rest
        yield render(holder, page)
        page.end_line()
    widths: list[int] = []
    for cells in rows:
        for at, lines, wide in cells:
            while len(widths) < at + wide:
                widths.append(0)
            if wide == 1:
                widths[at] = max(widths[at], *map(len, lines))
    out = []
    for cells in rows:
        height = max((len(lines) for _, lines, _ in cells), default=0)
        for i in range(height):
            parts, end = [], 0
            for at, lines, wide in cells:
                parts += [" " * x for x in widths[end:at]]
                room = sum(widths[at:at + wide]) + 2 * (wide - 1)
                parts.append((lines[i] if i < len(lines) else "").ljust(room))
                end = at + wide
            out.append("  ".join(parts).rstrip())
    page.add_lines([line for line in out if line])


def visible_text(source: str | None) -> str:
    page = Page()
    run_parts(render(build(source or ""), page))
    page.end_line()
    lines = page.lines
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The id and the visible `text` of every page.

    * A null or empty page has the text "". Pages are any text: tags that are never closed, stray
      ends and broken attributes are read as browsers do, and no shown text is dropped.
    * A null id stays null; rows that repeat are rendered each by itself. An empty table gives an
      empty result. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col):
            texts = [visible_text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
