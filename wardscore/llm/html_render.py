"""Layout-aware text of HTML pages: a tree with the tags that authors leave out, rules of visibility, and a text layout.

Blocks stand on lines of their own with blank lines where a browser leaves space, list items have their markers and
indentation, table cells are aligned in columns, preformatted text keeps its lines. All visible text is kept, navigation and
footers too.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscore.llm.text_bytes import small_batches

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "blockquote", "pre", "figure", "fieldset"}
BLOCK = SPACED | {
    "html", "body", "address", "article", "aside", "center", "details", "dialog", "dd", "div", "dt", "figcaption", "footer",
    "form", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "optgroup", "option", "section", "summary",
    "tbody", "td", "tfoot", "th", "thead", "tr", "caption",
}
HIDDEN = {
    "head", "script", "style", "template", "noscript", "title", "meta", "link", "object", "iframe", "audio", "video",
    "canvas", "datalist", "area", "param", "rp", "noframes",
}
# What a head may hold; anything else ends it.
IN_HEAD = {"title", "meta", "link", "style", "script", "base", "template", "noscript", "basefont", "bgsound"}
# Inputs that show no value of their own.
VALUELESS = {"hidden", "checkbox", "radio", "file", "image", "password", "color", "range"}
# What drawings and formulas hold, but do not show.
DRAWN = {"svg", "math"}
UNDRAWN = {
    "desc", "metadata", "defs", "symbol", "clippath", "mask", "pattern", "marker", "annotation", "annotation-xml",
}
# An opening tag closes these elements, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, {"html"}),
}
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
# An end tag does not reach out of these.
SCOPES = {"table", "td", "th", "caption", "html"}
# Deeper elements are set beside the last of this depth.
DEEPEST = 150
GAP = "  "


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


class Tree(HTMLParser):
    """Elements and texts of a page; missing end tags and rows are put in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        # Elements at the last depth that one beside them stands in for.
        self.covered: list[Node] = []

    def _close(self, tags: set[str], within: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                # The outermost of them below the border.
                while i > 1 and self.open[i - 1].tag in tags:
                    i -= 1
                self._end(i)
                return
            if self.open[i].tag in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attrs = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.root.attrs = attrs | self.root.attrs
            return
        if tag in CLOSES_P:
            self._close({"p"}, SCOPES | {"button"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in {"td", "th"} and self.open[-1].tag in {"table", "thead", "tbody", "tfoot"}:
            self._push(Node("tr"))
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self.open.pop()
        node = Node(tag, attrs)
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        if len(self.open) < DEEPEST:
            self.open[-1].children.append(node)
            self.open.append(node)
        else:
            # Beside its parent, which takes its place again when the node ends. What a hidden one holds stays hidden.
            if not is_visible(self.open[-1]):
                node.attrs["hidden"] = ""
            self.covered.append(self.open[-1])
            self._beside(node)

    def _beside(self, node: Node) -> None:
        self.open[-2].children.append(node)
        self.open[-1] = node

    def _end(self, i: int) -> None:
        """Close the open elements from the i-th on."""
        if i == DEEPEST - 1 and self.covered:
            parent = self.covered.pop()
            self._beside(Node(parent.tag, parent.attrs))
            return
        del self.open[i:]
        self.covered.clear()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # A slash closes nothing in HTML, but in drawings and formulas.
        if any(node.tag in DRAWN for node in self.open):
            self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._end(i)
                return
            if self.open[i].tag in SCOPES and tag not in {"table", "tr", "tbody", "thead", "tfoot", "body", "html"}:
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self.open.pop()
        self.open[-1].children.append(data)


def is_visible(node: Node) -> bool:
    style = re.sub(r"\s+", "", node.attrs.get("style", "").lower())
    return not (
        node.tag in HIDDEN
        or "hidden" in node.attrs
        or "display:none" in style
        or (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden")
        or (node.tag == "dialog" and "open" not in node.attrs)
    )


def veil(node: Node, hidden: bool = False) -> bool:
    """Takes out what visibility:hidden hides, but not the children that say visible; whether the node still shows anything."""
    said = re.findall(r"(?:^|;)visibility:(\w+)", re.sub(r"\s+", "", node.attrs.get("style", "").lower()))
    hidden = said[-1] in {"hidden", "collapse"} if said and said[-1] != "inherit" else hidden
    kept, shows = [], not hidden
    for child in node.children:
        if isinstance(child, str):
            kept += [] if hidden else [child]
        elif veil(child, hidden):
            kept.append(child)
            shows = True
    node.children = kept
    return shows


# What begins a tag, and what ends a comment.
TAG, COMMENT_END = re.compile(r"</?[A-Za-z!?]"), re.compile(r"--!?>")


def whole_tags(html: str) -> str:
    """The page without an unfinished tag or comment at its end, which shows nothing and which the parser reads again and again."""
    opened = html.rfind("<!--")
    if opened >= 0 and not COMMENT_END.search(html, opened + 2) and not re.search(r"</(?:script|style)", html[opened:], re.I):
        html = html[:opened]
    unfinished = TAG.search(html, html.rfind(">") + 1)
    return html[: unfinished.start()] if unfinished else html


def width(text: str) -> int:
    """Columns of a line on a terminal: wide signs take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Layout:
    """Lines of text. ``gap`` asks for a line break (1) or a blank line (2) before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = [""]
        self.gap = 0
        self.space = False

    def need(self, gap: int) -> None:
        self.gap = max(self.gap, gap)
        self.space = False

    def put(self, text: str) -> None:
        if self.gap and (len(self.lines) > 1 or self.lines[-1]):
            if self.lines[-1]:
                self.lines.append("")
            if self.gap == 2 and self.lines[-2:-1] != [""]:
                self.lines.append("")
        elif self.space and self.lines[-1] and not self.lines[-1].endswith(" "):
            self.lines[-1] += " "
        self.gap, self.space = 0, False
        self.lines[-1] += text

    def words(self, text: str) -> None:
        """Running text: white space of any length is one space, none at a line's begin."""
        parts = re.split(r"[ \t\n\r\f]+", text)
        for i, part in enumerate(parts):
            if i:
                self.space = True
            if part:
                self.put(part)

    def kept(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.lines.append("")
            if line:
                self.put(line)

    def line_break(self) -> None:
        self.put("")
        self.lines.append("")

    def block(self, lines: list[str], first: str = "", rest: str = "") -> None:
        """Lines as they are, the first one after ``first``, the others indented by ``rest``."""
        for i, line in enumerate(lines):
            self.put((rest if i else first) + line if line or not i else "")
            if i < len(lines) - 1:
                self.lines.append("")
        self.need(1)

    def result(self) -> list[str]:
        lines = [line.rstrip() for line in self.lines]
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def _whole(text: str, least: int, fallback: int) -> int:
    found = re.match(r"\s*(-?\d{1,6})", text or "")
    return max(least, int(found[1])) if found else fallback


def lay_out(node: Node, out: Layout, pre: bool = False) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.kept(child) if pre else out.words(child)
            continue
        tag = child.tag
        if not is_visible(child):
            continue
        if tag == "br":
            out.line_break()
        elif tag == "hr":
            out.need(1)
            out.put("---")
            out.need(1)
        elif tag == "table":
            out.need(2)
            out.block(table_lines(child))
            out.need(2)
        elif tag in {"ul", "ol", "menu"}:
            nested = node.tag in {"li", "ul", "ol", "menu"}
            out.need(1 if nested else 2)
            out.block(list_lines(child))
            out.need(1 if nested else 2)
        elif tag == "select":
            if "multiple" in child.attrs or _whole(child.attrs.get("size", ""), 0, 1) > 1:
                out.need(1)
                lay_out_list_box(child, out)
                out.need(1)
                continue
            options = [o for o in walk(child) if o.tag == "option"]
            chosen = [o for o in options if "selected" in o.attrs] or options[:1]
            out.space = True
            for option in chosen:
                lay_out(option, out)
                out.space = True
        elif tag in DRAWN:
            out.space = out.space or tag == "svg"
            lay_out(drawn(child), out)
            out.space = out.space or tag == "svg"
        elif tag in {"blockquote", "dd"}:
            out.need(2 if tag == "blockquote" else 1)
            inner = Layout()
            lay_out(child, inner, pre)
            out.block(inner.result(), "    ", "    ")
            out.need(2 if tag == "blockquote" else 1)
        elif tag == "details" and "open" not in child.attrs:
            out.need(1)
            for summary in [c for c in child.children if isinstance(c, Node) and c.tag == "summary"][:1]:
                lay_out(summary, out, pre)
            out.need(1)
        elif tag == "input":
            if child.attrs.get("type", "text").lower() not in VALUELESS and child.attrs.get("value"):
                out.words(child.attrs["value"])
        else:
            gap = 2 if tag in SPACED else 1 if tag in BLOCK else 0
            keep = pre or tag in {"pre", "textarea", "listing"}
            if gap:
                out.need(gap)
            lay_out(child, out, keep)
            if gap:
                out.need(gap)


def lay_out_list_box(node: Node, out: Layout) -> None:
    """A list box stands open: every option and the name of every group has a line."""
    for child in node.children:
        if isinstance(child, Node) and is_visible(child):
            out.need(1)
            if child.tag == "option":
                lay_out(child, out)
            else:
                if child.tag == "optgroup":
                    out.words(child.attrs.get("label", ""))
                lay_out_list_box(child, out)


def drawn(node: Node) -> Node:
    """A drawing or formula without the parts that it does not show; its texts stand apart."""
    children: list = []
    for child in node.children:
        if isinstance(child, str):
            children.append(child)
        elif child.tag not in UNDRAWN and child.attrs.get("display") != "none" and child.attrs.get("visibility") != "hidden":
            children += [" ", drawn(child), " "] if child.tag == "text" else [drawn(child)]
    return Node("span" if node.tag in DRAWN else node.tag, node.attrs, children)


def walk(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node):
            yield child
            yield from walk(child)


def list_lines(node: Node) -> list[str]:
    """Items with their bullets or numbers, further lines of an item below its text."""
    out = Layout()
    items = [c for c in node.children if isinstance(c, Node) and c.tag == "li" and is_visible(c)]
    step = -1 if "reversed" in node.attrs else 1
    number = _whole(node.attrs.get("start", ""), -999_999, len(items) if step < 0 else 1)
    for child in node.children:
        if isinstance(child, str) or not is_visible(child):
            if isinstance(child, str):
                out.words(child)
            continue
        out.need(1)
        if child.tag != "li":
            lay_out(Node(node.tag, {}, [child]), out)
            continue
        mark = "* "
        if node.tag == "ol":
            number = _whole(child.attrs.get("value", ""), -999_999, number)
            mark = f"{number}. "
            number += step
        inner = Layout()
        lay_out(child, inner)
        out.block(inner.result() or [""], mark, " " * len(mark))
    return out.result()


def holds(node: Node, tags: set[str]) -> bool:
    """Whether one of these elements is inside, but not in a table or a hidden element of its own."""
    return any(
        isinstance(c, Node) and c.tag not in HIDDEN | {"table"} and (c.tag in tags or holds(c, tags)) for c in node.children
    )


def cells_of(node: Node) -> tuple[list[Node], list]:
    """The cells of a row, also those inside other elements, and what else the row holds."""
    cells, rest = [], []
    for child in node.children:
        if isinstance(child, str):
            rest += [child] if child.strip() else []
        elif child.tag in {"td", "th"}:
            cells += [child] if is_visible(child) else []
        elif child.tag not in HIDDEN | {"table"} and holds(child, {"td", "th"}):
            inside, around = cells_of(child)
            cells += inside
            rest += [Node(child.tag, child.attrs, around)] if around else []
        else:
            rest.append(child)
    return cells, rest


def table_lines(node: Node) -> list[str]:
    """Captions and what stands outside of cells above, then the rows, each column as wide as its widest cell that spans no other."""
    head, rows = [], []

    def collect(at: Node) -> None:
        for child in at.children:
            if isinstance(child, str):
                if child.strip():
                    head.append(child)
            elif child.tag in {"thead", "tbody", "tfoot", "tr"} and not is_visible(child):
                continue
            elif child.tag not in HIDDEN | {"table", "tr", "caption"} and holds(child, {"tr"}):
                collect(child)
            elif child.tag == "tr" or child.tag not in HIDDEN | {"table", "caption"} and holds(child, {"td", "th"}):
                cells, rest = cells_of(child)
                rows.append(cells)
                head.extend(rest)
            elif child.tag not in {"colgroup", "col", "thead", "tbody", "tfoot"}:
                head.append(child)
            elif child.tag not in {"colgroup", "col"}:
                collect(child)

    collect(node)
    out = Layout()
    lay_out(Node("div", {}, head), out)
    grid: list[list[tuple[int, int, list[str]]]] = []
    busy: dict[int, int] = {}
    for row in rows:
        at, placed = 0, []
        taken = {c for c, left in busy.items() if left > 0}
        busy = {c: left - 1 for c, left in busy.items() if left > 1}
        for cell in row:
            while at in taken:
                at += 1
            span = min(_whole(cell.attrs.get("colspan", ""), 1, 1), 1000)
            down = min(_whole(cell.attrs.get("rowspan", ""), 1, 1), 1000)
            inner = Layout()
            lay_out(cell, inner)
            placed.append((at, span, inner.result()))
            if down > 1:
                busy.update({c: down - 1 for c in range(at, at + span)})
            at += span
        grid.append(placed)
    wide: dict[int, int] = {}
    for placed in grid:
        for at, span, lines in placed:
            if span == 1:
                wide[at] = max([wide.get(at, 0), *map(width, lines)])
    for placed in grid:
        for at, span, lines in placed:
            room = sum(wide.get(c, 0) for c in range(at, at + span)) + len(GAP) * (span - 1)
            if lines and span > 1 and (more := max(map(width, lines)) - room) > 0:
                wide[at + span - 1] = wide.get(at + span - 1, 0) + more
    columns = sorted({c for placed in grid for at, span, _ in placed for c in range(at, at + span)})
    begin, x = {}, 0
    for c in columns:
        begin[c] = x
        x += wide.get(c, 0) + len(GAP)
    lines = out.result()
    for placed in grid:
        for i in range(max((len(cell) for _, _, cell in placed), default=0)):
            line = ""
            for at, _, cell in placed:
                if i < len(cell) and cell[i]:
                    line += " " * (begin[at] - width(line)) + cell[i]
            lines.append(line.rstrip())
    return lines


def render(html: str) -> str:
    """The visible text of a page."""
    tree = Tree()
    tree.feed(whole_tags(html))
    tree.close()
    veil(tree.root)
    out = Layout()
    if is_visible(tree.root):
        lay_out(tree.root, out)
    return "\n".join(out.result())


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, text) per row of ``pages``: the visible text of the whole page.

    A null or empty page has an empty text, text without tags is one paragraph. Null and repeated keys each give their row,
    an empty table an empty one; other columns are not read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("page_id"), F.col(html).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(page) if page else "" for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    return rows.mapInArrow(extract, f"page_id {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
