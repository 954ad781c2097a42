"""Layout-aware text of HTML pages.

A small tree builder follows the parsing rules that bear on text: tags that are implied
(a paragraph ends where a block starts, items, cells, rows and options end one another,
rows and cells get their table), end tags without a start, void and raw-text elements,
character references and cut-off markup. Invisible parts are left out. The tree is then
laid out: blocks start lines, with blank lines where browsers put margins; items carry
bullets or numbers and indentation; the cells of a table stand in aligned columns;
preformatted text keeps its white space.

Null or empty pages give an empty text. Elements deeper than DEPTH are kept as content of
the element at that depth. Pages are taken whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

DEPTH = 200
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title plaintext".split())
HIDDEN = frozenset("head script style template noscript noframes noembed iframe title meta link base datalist object audio video canvas svg math map param rp area".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre listing xmp plaintext search section summary table ul caption".split()
)
#: Blocks with a margin, here one blank line before and after.
SPACED = frozenset("blockquote dl dir figure h1 h2 h3 h4 h5 h6 menu ol p pre listing xmp plaintext ul table hr fieldset".split())
ENDS_P = BLOCKS - frozenset("html body dialog legend option optgroup caption".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
LISTS = frozenset("ul ol menu dir".split())
#: A start tag ends open elements of these names, looked for up to one of the second names.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
#: An end tag does not reach an element outside these.
WALLS = frozenset("table td th caption button template object".split())

_TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)(>|\Z)|[!?/][^>]*(?:>|\Z))""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def parse(page: str) -> Node:
    """The page's tree; its root is `html`."""
    root = Node("html", {})
    stack = [root]
    body: Node | None = None

    def into_body() -> None:
        nonlocal body
        if body is None:
            del stack[1:]
            body = Node("body", {})
            root.children.append(body)
            stack.append(body)

    def close_to(name: str, walls: frozenset[str] | set[str]) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            own = stack[k].name
            if own == name:
                del stack[k:]
                if not stack[1:] and body is not None:
                    stack.append(body)
                return True
            if own in walls:
                return False
        return False

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        if len(stack) < DEPTH:
            stack.append(node)

    def text(data: str) -> None:
        if not data:
            return
        if body is None and (stack[-1].name in ("html", "head")):
            if not data.strip(" \t\n\r\f"):
                return
            into_body()
        stack[-1].children.append(data)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(html.unescape(page[at:]) if "&" in page[at:] else page[at:])
            break
        if m.start() > at:
            part = page[at : m.start()]
            text(html.unescape(part) if "&" in part else part)
        at = m.end()
        name = m.group(2)
        if name is None or m.group(4) == "":
            continue  # a comment, a declaration, or a tag that the end cuts off
        name = name.lower()
        if m.group(1):
            if name in ("html", "body", "head"):
                if name == "head" and body is None:
                    del stack[1:]
            elif name == "br":
                into_body()
                stack[-1].children.append(Node("br", {}))
            elif name == "p" and not close_to("p", WALLS):
                into_body()
                stack[-1].children.append(Node("p", {}))
            elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                        del stack[k:]
                        break
                    if stack[k].name in WALLS:
                        break
            elif name in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
                close_to(name, {"table"} if name != "table" else frozenset())
            else:
                close_to(name, WALLS)
            continue
        attrs = attributes(m.group(3)) if m.group(3).strip() else {}
        if name == "html":
            for k, v in attrs.items():
                root.attrs.setdefault(k, v)
            continue
        if name == "head":
            if body is None and len(stack) == 1:
                push(Node("head", attrs))
            continue
        if name == "body":
            if body is None:
                into_body()
            for k, v in attrs.items():
                body.attrs.setdefault(k, v)
            continue
        if body is None and not (name in HEAD_ONLY and stack[-1].name in ("html", "head")):
            into_body()
        if name in ENDS_P and name != "table":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name in WALLS:
                    break
        if name in CLOSES:
            names, walls = CLOSES[name]
            low = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in walls:
                    break
                if stack[k].name in names:
                    low = k
            if low is not None:
                del stack[low:]
        if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup", "col"):
            inside = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == "table"), None)
            if inside is None:
                continue  # a part of a table outside of one is ignored
            wanted = {"td": ("tr",), "th": ("tr",)}.get(name, ("table", "tbody", "thead", "tfoot") if name == "tr" else ("table",))
            while len(stack) - 1 > inside and stack[-1].name not in wanted:
                stack.pop()
            if name in ("td", "th") and stack[-1].name not in wanted:
                push(Node("tr", {}))
        node = Node(name, attrs)
        if name in VOID:
            stack[-1].children.append(node)
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at) if name != "plaintext" else None
            data = page[at : end.start() if end else n]
            node.children.append(html.unescape(data) if name in ("textarea", "title") else data)
            stack[-1].children.append(node)
            at = end.end() if end else n
        else:
            push(node)
    return root


def seen(node: Node) -> bool:
    if node.name in HIDDEN:
        return False
    a = node.attrs
    if not a:
        return node.name != "dialog"
    if "hidden" in a or (node.name == "dialog" and "open" not in a):
        return False
    return not ("style" in a and _UNSEEN.search(a["style"]))


class Canvas:
    """Lines of a block, filled from the left."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = 0
        self.indent: list[str] = []
        self.mark = ""
        self.space = False

    def words(self, data: str) -> None:
        data = _SPACE.sub(" ", data)
        if data == " ":
            self.space = True
            return
        if not data:
            return
        if data[0] == " " or self.space:
            data = data.lstrip(" ")
            if self.line:
                data = " " + data
        self.space = data[-1] == " "
        self.line += data[:-1] if self.space else data

    def kept(self, data: str) -> None:
        first, *rest = data.replace("\r\n", "\n").expandtabs(8).split("\n")
        self.line += first
        for x in rest:
            self.feed()
            self.line = x

    def feed(self) -> None:
        """End the line, even an empty one."""
        self.space = False
        if self.line or self.mark:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            lead = "".join(self.indent)
            if self.mark:
                lead = lead[: len(lead) - len(self.mark)] + self.mark
                self.mark = ""
            self.lines.append((lead + self.line).rstrip())
        elif self.lines and not self.gap:
            self.lines.append("")
        self.line = ""

    def block(self, gap: int) -> None:
        """Start a block: end a line with text, and leave `gap` blank lines."""
        if self.line:
            self.feed()
        self.space = False
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        if self.line or self.mark:
            self.feed()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def lay_out(node: Node, to: Canvas, keep: bool = False, nested: int = 0) -> None:
    number = 0
    if node.name == "ol":
        try:
            number = int(node.attrs.get("start", "1")) - 1
        except ValueError:
            number = 0
    for child in node.children:
        if isinstance(child, str):
            to.kept(child) if keep else to.words(child)
            continue
        name = child.name
        if name == "br":
            to.feed()
            continue
        if not seen(child):
            continue
        if name == "input":
            kind = child.attrs.get("type", "text").lower()
            if kind in ("submit", "button", "reset"):
                to.words(f" {child.attrs.get('value', '')} ")
            continue
        if name == "table":
            to.block(1)
            table(child, to, nested)
            to.block(1)
            continue
        if name not in BLOCKS:
            lay_out(child, to, keep or name == "textarea", nested)
            continue
        # a list within a list has no margin
        gap = 1 if name in SPACED and not (nested and name in LISTS) else 0
        to.block(gap)
        own_keep = name in ("pre", "listing", "xmp", "plaintext")
        if name == "li":
            number += 1
            if node.name == "ol":
                value = child.attrs.get("value", "")
                number = int(value) if value.isascii() and value.isdigit() and len(value) < 10 else number
            mark = f"{number}. " if node.name == "ol" else "* "
            to.mark = mark
            to.indent.append(" " * len(mark))
            lay_out(child, to, keep, nested + 1)
            if to.line or to.mark:
                to.feed()
            to.indent.pop()
        elif name in ("dd", "blockquote") or (name in LISTS and nested):
            to.indent.append("  ")
            lay_out(child, to, keep, nested)
            if to.line:
                to.feed()
            to.indent.pop()
        else:
            if own_keep and child.children and isinstance(child.children[0], str) and child.children[0][:1] == "\n":
                child.children[0] = child.children[0][1:]
            lay_out(child, to, keep or own_keep, nested)
        to.block(gap)


def rows_of(node: Node) -> Iterator[Node]:
    order = {"thead": 0, "tfoot": 2}
    for part in sorted((c for c in node.children if isinstance(c, Node)), key=lambda c: order.get(c.name, 1)):
        if part.name == "tr" and seen(part):
            yield part
        elif part.name in ("thead", "tbody", "tfoot") and seen(part):
            yield from (c for c in part.children if isinstance(c, Node) and c.name == "tr" and seen(c))


def span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "1").strip()
    return max(1, min(most, int(value))) if value.isascii() and value.isdigit() and len(value) < 10 else 1


def table(node: Node, to: Canvas, nested: int) -> None:
    """Captions and stray content, then rows with every column as wide as its widest cell."""
    for child in node.children:
        if isinstance(child, str):
            to.words(child)
        elif child.name not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col") and seen(child):
            lay_out(Wrap(child), to, False, nested)
    to.block(0)
    grid: list[dict[int, tuple[list[str], int]]] = []
    held: dict[int, int] = {}
    for row in rows_of(node):
        cells: dict[int, tuple[list[str], int]] = {}
        column = 0
        after: dict[int, int] = {c: n - 1 for c, n in held.items() if n > 1}
        for cell in row.children:
            if isinstance(cell, str) or cell.name not in ("td", "th"):
                if isinstance(cell, str) and not cell.strip():
                    continue
                lay_out(Wrap(cell), to, False, nested)
                continue
            while column in held:
                column += 1
            wide, high = span(cell, "colspan", 1000), span(cell, "rowspan", 65534)
            own = Canvas()
            if seen(cell):
                lay_out(cell, own, False, 0)
            cells[column] = (own.done(), wide)
            if high > 1:
                after |= {c: high - 1 for c in range(column, column + wide)}
            column += wide
        held = after
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for c, (lines, wide) in cells.items():
            if wide == 1:
                widths[c] = max(widths.get(c, 0), max(map(len, lines), default=0))
    used = sorted({c for cells in grid for c in cells})
    place, at = {}, 0
    for c in used:
        place[c] = at
        at += widths.get(c, 0) + 2 if widths.get(c, 0) else 0
    for cells in grid:
        high = max((len(lines) for lines, _ in cells.values()), default=0)
        for k in range(high):
            line = ""
            for c in sorted(cells):
                lines = cells[c][0]
                if k < len(lines) and lines[k]:
                    line = line.ljust(place[c])
                    if line and line[-1] != " ":
                        line += "  "
                    line += lines[k]
            to.line = line
            if line:
                to.feed()


class Wrap:
    """A parent for one node."""

    name = ""
    attrs: dict[str, str] = {}

    def __init__(self, child):
        self.children = [child]


def text_of(page: str | None) -> str:
    canvas = Canvas()
    root = parse((page or "").replace("\x00", "�").replace("\r\n", "\n"))
    if seen(root):
        lay_out(root, canvas)
    return "\n".join(canvas.done())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages -> (id_col, text, n_lines), a row for each row of pages. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], names=[id_col, "text", "n_lines"])

    tune(pages.sparkSession)
    return pages.select(id_col, F.col(html_col)).mapInArrow(run, f"`{id_col}` {dict(pages.dtypes)[id_col]}, text string, n_lines long")
