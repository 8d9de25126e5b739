"""HTML as a tree: elements, tables as grids of cells, and text by structure.

A page is cut into tags, comments and text by one expression that never goes back, and
a stack of open elements follows them: void elements hold nothing, some tags end others
that were left open, end tags without a beginning are passed over, and scripts and
styles are no text. Pages go through this one by one in Arrow batches.

Defined results: null pages have no elements, no tables and a null text; text outside
of any element belongs to node 0, the page; a `<` that begins no tag is text; entities
are put back in texts and attribute values; of attributes that repeat the first counts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
DROPPED = frozenset("script style noscript iframe template svg head".split())
BLOCKS = frozenset("address article aside blockquote dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Open elements that a tag ends, up to (and without) the elements that hold them.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
}
#: An end tag does not reach beyond these, unless it is their own.
WALLS = frozenset("table td th caption".split())
#: A span that a page asks for counts up to this many cells, as browsers have it.
MOST_SPAN = 1000

#: Elements nested deeper hold nothing, as browsers have it.
MOST_DEPTH = 512

# no part of a tag reaches over the next <, so a page is read once whatever it holds
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|</([a-zA-Z][^\s/<>]*+)[^<>]*+>|<([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^<\"]*+\"|'[^<']*+')*+)>|<([a-zA-Z][^\s/<>]*+)([^<>]*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")


@dataclass
class Node:
    number: int
    parent: int | None
    depth: int
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    text: list[str] = field(default_factory=list)


def events(page: str) -> Iterator[tuple[str, Node, str]]:
    """("open", element, ""), ("close", element, "") and ("text", element it is in, text), in order."""
    root = Node(0, None, 0, "")
    stack, count, at = [root], 0, 0
    yield "open", root, ""

    def closed(to: int) -> Iterator[tuple[str, Node, str]]:
        while len(stack) > to:
            yield "close", stack.pop(), ""

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue  # in a script or style
        if m.start() > at:
            yield "text", stack[-1], html.unescape(page[at : m.start()])
        at = m.end()
        end, tag = (m[1] or "").lower(), (m[2] or m[4] or "").lower()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == end:
                    yield from closed(i)
                    break
                if stack[i].tag in WALLS and end not in ("table", "tr", "thead", "tbody", "tfoot"):
                    break
        elif tag:
            ended, walls = ENDS.get(tag, (set(), set()))
            if tag in BLOCKS:
                ended, walls = ended | {"p"}, walls | WALLS | {"button"}
            cut = None
            for i in range(len(stack) - 1, 0, -1) if ended else ():
                if stack[i].tag in ended:
                    cut = i
                    if tag != "tr" and stack[i].tag != "p":
                        break
                if stack[i].tag in walls:
                    break
            if cut is not None:
                yield from closed(cut)
            attributes: dict[str, str] = {}
            for a in _ATTRIBUTE.finditer(m[3] or m[5] or ""):
                attributes.setdefault(a[1].lower(), html.unescape(next((v for v in a.groups()[1:] if v is not None), "")))
            count += 1
            node = Node(count, stack[-1].number, len(stack), tag, attributes)
            yield "open", node, ""
            if tag in VOID or len(stack) > MOST_DEPTH:
                yield "close", node, ""
                continue
            stack.append(node)
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^<>]*>", re.IGNORECASE).search(page, at)
                stop = close.start() if close else len(page)
                if stop > at:
                    yield "text", node, page[at:stop]
                at = close.end() if close else len(page)
                yield from closed(len(stack) - 1)
    if at < len(page):
        yield "text", stack[-1], html.unescape(page[at:])
    yield from closed(0)


def nodes(page: str) -> list[Node]:
    """The page's elements in the order in which they begin, each with the text right in it."""
    out: list[Node] = []
    for what, node, text in events(page):
        if what == "open":
            out.append(node)
        elif what == "text":
            node.text.append(text)
    return out


def _squeezed(pieces: list[str]) -> str:
    return re.sub(r"\s+", " ", "".join(pieces)).strip()


def _span(node: Node, name: str) -> int:
    found = re.match(r"\s*(\d+)", node.attributes.get(name, ""))
    return max(1, min(int(found[1]), MOST_SPAN)) if found else 1


@dataclass
class _Table:
    number: int
    row: int = -1
    next: int = 0
    taken: dict[int, int] = field(default_factory=dict)  # by column: rows, from this one on, that a cell takes


def cells(page: str) -> list[tuple[int, int, int, int, int, bool, str]]:
    """(table, row, column, rows, columns, is it a heading?, text) of every cell, at the place that spans of cells before leave it."""
    out: list[tuple[int, int, int, int, int, bool, str]] = []
    tables: list[_Table] = []
    open_cells: list[tuple[int, list[str]]] = []  # place in out, text
    count = 0
    for what, node, text in events(page):
        if what == "text":
            if node.tag not in RAW:
                for _, pieces in open_cells:  # a cell's text holds that of tables in it
                    pieces.append(text)
        elif node.tag == "table":
            if what == "open":
                tables.append(_Table(count))
                count += 1
            else:
                tables.pop()
        elif tables and node.tag == "tr" and what == "open":
            t = tables[-1]
            t.row, t.next = t.row + 1, 0
            t.taken = {c: n - 1 for c, n in t.taken.items() if n > 1}
        elif node.tag in ("td", "th") and (tables or what == "close" and open_cells):
            t = tables[-1] if tables else None
            if what == "close":
                place, pieces = open_cells.pop()
                out[place] = (*out[place][:6], _squeezed(pieces))
                continue
            t.row = max(t.row, 0)
            rows, columns, at = _span(node, "rowspan"), _span(node, "colspan"), t.next
            while at in t.taken:
                at += 1
            t.next = at + columns
            for c in range(at, t.next):
                t.taken[c] = rows
            open_cells.append((len(out), []))
            out.append((t.number, t.row, at, rows, columns, node.tag == "th", ""))
        elif node.tag == "br" and what == "open":
            for _, pieces in open_cells:
                pieces.append(" ")
    return out


def text_of(page: str) -> str:
    """Text by structure: headings with #, items of lists with a bullet or their number, quotes with >, cells of a row parted by |; blocks stand apart."""
    out: list[str] = []
    dropped = 0
    lists: list[int | None] = []  # numbers given so far, none for a bulleted one
    for what, node, text in events(page):
        tag, opens = node.tag, what == "open"
        if what == "text":
            if not dropped:
                out.append(re.sub(r"\s+", " ", text))
            continue
        if tag in DROPPED:
            dropped += 1 if opens else -1
        if dropped:
            continue
        if tag in ("ul", "ol"):
            if opens:
                lists.append(0 if tag == "ol" else None)
            elif lists:
                lists.pop()
            out.append("\n")
        elif tag == "li":
            if opens and lists and lists[-1] is not None:
                lists[-1] += 1
                out.append(f"\n{lists[-1]}. ")
            elif opens:
                out.append("\n• ")
        elif tag in HEADINGS:
            out.append(f"\n\n{'#' * int(tag[1])} " if opens else "\n\n")
        elif tag == "blockquote":
            out.append("\n> " if opens else "\n")
        elif tag in ("br", "tr", "caption"):
            out.append("\n" if opens or tag == "caption" else "")
        elif tag in ("td", "th"):
            out.append("" if opens else " | ")
        elif tag in BLOCKS:
            out.append("\n\n")
    lines = [re.sub(r" +", " ", line).strip() for line in "".join(out).replace("\u200b", "").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"( \|)+$", "", line) for line in lines)).strip()


def _pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))


def _rows(of: Callable[[str], list[tuple]], kinds: list[tuple[str, pa.DataType]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, page in zip(b.column(0), b.column(1)):
                found = of(page.as_py())
                if found:
                    columns = [pa.array([i.as_py()] * len(found), pa.int64())] + [pa.array(c, k) for c, (_, k) in zip(zip(*found), kinds)]
                    yield pa.record_batch(columns, ["page_id", *[n for n, _ in kinds]])

    return run


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, node (0 is the page, then in the order in which elements begin), parent, depth, tag, attributes, text (right in the element, with single blanks)."""

    def of(page: str) -> list[tuple]:
        return [(n.number, n.parent, n.depth, n.tag, list(n.attributes.items()), _squeezed(n.text)) for n in nodes(page)]

    kinds = [("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())]
    return _pages(pages, id_col, html_col).filter("html is not null").mapInArrow(_rows(of, kinds), "page_id long, node int, parent int, depth int, tag string, attributes map<string,string>, text string")


def table_cells(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, table (from 0, in the order in which they begin), row, column, rows, columns, heading, text of every cell."""
    kinds = [("table", pa.int32()), ("row", pa.int32()), ("column", pa.int32()), ("rows", pa.int32()), ("columns", pa.int32()), ("heading", pa.bool_()), ("text", pa.string())]
    return _pages(pages, id_col, html_col).filter("html is not null").mapInArrow(_rows(cells, kinds), "page_id long, table int, row int, column int, rows int, columns int, heading boolean, text string")


def structured_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text of every page."""

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else text_of(v) for v in column.to_pylist()], pa.string())

    return _pages(pages, id_col, html_col).select("page_id", of("html").alias("text"))
