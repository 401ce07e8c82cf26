"""Visible text of web pages, laid out: block spacing, lists, and aligned table cells."""

from __future__ import annotations

import re
import textwrap
import unicodedata
from collections.abc import Generator, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.common import small_batches
from plantpulse.llm.html_tree import HEADINGS, Node, build_tree, visibility

# Blank lines around blocks; other block elements only start a new line.
MARGIN = {"p", "ul", "ol", "menu", "dl", "blockquote", "pre", "table", "figure", "hr", *HEADINGS}
LINES = set(
    "address article aside center details dialog div fieldset figcaption footer form header hgroup"
    " main nav search section summary li dd dt caption legend optgroup option html".split()
)
# Cells wider than this are wrapped, so that one long cell does not spread a whole table.
CELL_WIDTH = 60
MAX_SPAN = 1000

_BLANK = re.compile(r"[ \t\n\r\f]+")


def width(text: str) -> int:
    """Columns a text takes: wide characters two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text
    )


class Page:
    """Lines of a region; inline text collects until a block ends it."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0
        self.space = False

    def text(self, data: str) -> None:
        data = _BLANK.sub(" ", data)
        if data.startswith(" ") and self.inline:
            self.space = True
        words = data.strip(" ")
        if words:
            if self.space:
                self.inline.append(" ")
            self.inline.append(words)
            self.space = data.endswith(" ")

    def flush(self, always: bool = False) -> None:
        if self.inline or always:
            self.put(["".join(self.inline).rstrip(" ")])
            self.inline = []
        self.space = False

    def put(self, lines: list[str]) -> None:
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines += lines

    def block(self, margin: int) -> None:
        self.flush()
        self.gap = max(self.gap, margin)

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


# A step yields the steps of an element inside and is sent their result.
Steps = Generator["Steps", Any, Any]


def run_steps(steps: Steps) -> Any:
    """Result of nested steps on a stack of its own, so that no depth of nesting is too deep."""
    stack, value = [steps], None
    while stack:
        try:
            inner = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(inner)
            value = None
    return value


class Renderer:
    def __init__(self, rules: list):
        self.rules = rules

    def region(self, node: Node, shown: bool, pre: bool = False) -> Steps:
        page = Page()
        yield self.children(node, page, shown, pre)
        return page.done()

    def children(self, node: Node, page: Page, shown: bool, pre: bool) -> Steps:
        closed = node.tag == "details" and "open" not in node.attrs
        for child in node.children:
            if closed and not (isinstance(child, Node) and child.tag == "summary"):
                continue
            if isinstance(child, Node):
                yield self.element(child, page, shown, pre)
                closed = closed and child.tag != "summary" or node.tag == "details" and "open" not in node.attrs
            elif shown:
                self.data(child, page, pre)

    def data(self, data: str, page: Page, pre: bool) -> None:
        if not pre:
            page.text(data)
            return
        head, *rest = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        page.inline.append(head.expandtabs(8))
        for line in rest:
            page.flush(always=True)
            page.inline.append(line.expandtabs(8))

    def element(self, node: Node, page: Page, inherited: bool, pre: bool) -> Steps:
        tag = node.tag
        laid, shown = visibility(node, self.rules, inherited)
        if not laid:
            return
        if tag == "br":
            page.flush(always=True)
        elif tag == "input":
            if shown and node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                page.text(node.attrs.get("value", ""))
        elif tag == "select":
            yield self.select(node, page, shown)
        elif tag == "table":
            self.indented(page, (yield self.table(node, shown)), "", "", 1)
        elif tag in ("ul", "ol", "menu"):
            # A list inside an item follows its text without a blank line.
            self.indented(page, (yield self.items(node, shown, pre)), "", "", 1 if not page.inline or page.lines else 0)
        elif tag in ("dd", "blockquote"):
            pad = "    " if tag == "dd" else "  "
            self.indented(page, (yield self.region(node, shown, pre)), pad, pad, int(tag == "blockquote"))
        elif tag == "pre":
            lines = yield self.region(node, shown, True)
            self.indented(page, lines[1:] if lines and not lines[0] else lines, "", "", 1)
        elif tag in MARGIN or tag in LINES:
            margin = int(tag in MARGIN)
            page.block(margin)
            yield self.children(node, page, shown, pre)
            page.block(margin)
        elif tag == "q":
            page.text('"' if shown else "")
            page.space = False
            yield self.children(node, page, shown, pre)
            page.space = False
            page.text('"' if shown else "")
        else:
            yield self.children(node, page, shown, pre)

    def indented(self, page: Page, lines: list[str], first: str, rest: str, margin: int) -> None:
        if not lines:
            return
        page.block(margin)
        page.put([((first if i == 0 else rest) + line) if line or i == 0 else "" for i, line in enumerate(lines)])
        page.gap = margin

    def items(self, node: Node, shown: bool, pre: bool) -> Steps:
        page, at = Page(), node.attrs.get("start", "")
        number = int(at) if re.fullmatch(r"-?\d{1,9}", at) else 1
        for child in node.children:
            if not isinstance(child, Node) or child.tag != "li":
                if isinstance(child, Node):
                    yield self.element(child, page, shown, pre)
                elif shown:
                    page.text(child)
                continue
            laid, visible = visibility(child, self.rules, shown)
            if not laid:
                continue
            if re.fullmatch(r"-?\d{1,9}", child.attrs.get("value", "")):
                number = int(child.attrs["value"])
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            self.indented(page, (yield self.region(child, visible, pre)), mark, " " * len(mark), 0)
        return page.done()

    def select(self, node: Node, page: Page, shown: bool) -> Steps:
        """The option a closed list shows: the selected one, or the first."""
        options, queue = [], [node]
        while queue:
            for child in queue.pop(0).children:
                if isinstance(child, Node):
                    (options if child.tag == "option" else queue).append(child)
        chosen = [o for o in options if "selected" in o.attrs][-1:] or options[:1]
        for option in chosen:
            yield self.children(option, page, shown, False)

    def table(self, node: Node, shown: bool) -> Steps:
        page, groups, loose = Page(), {"thead": [], "tbody": [], "tfoot": []}, Page()
        yield self.rows(node, shown, "tbody", groups, page, loose)
        grid = _grid([row for part in ("thead", "tbody", "tfoot") for row in groups[part]])
        self.indented(page, _aligned(grid), "", "", 0)
        # Text that is in a table but in no cell is shown before it.
        return [*loose.done(), *page.done()]

    def rows(self, node: Node, shown: bool, part: str, groups: dict, page: Page, loose: Page) -> Steps:
        for child in node.children:
            if not isinstance(child, Node):
                if shown:
                    loose.text(child)
                continue
            laid, visible = visibility(child, self.rules, shown)
            if not laid:
                continue
            if child.tag in groups:
                yield self.rows(child, visible, child.tag, groups, page, loose)
            elif child.tag == "tr":
                row = []
                for cell in child.children:
                    if isinstance(cell, Node) and cell.tag in ("td", "th"):
                        ok, seen = visibility(cell, self.rules, visible)
                        if ok:
                            row.append(((yield self.region(cell, seen)), _span(cell, "colspan"), _span(cell, "rowspan")))
                    elif isinstance(cell, Node):
                        yield self.element(cell, loose, visible, False)
                    elif visible:
                        loose.text(cell)
                groups[part].append(row)
            elif child.tag == "caption":
                self.indented(page, (yield self.region(child, visible)), "", "", 0)
            elif child.tag != "colgroup":
                yield self.element(child, loose, visible, False)


def _span(cell: Node, name: str) -> int:
    value = cell.attrs.get(name, "")
    return min(MAX_SPAN, max(1, int(value))) if re.fullmatch(r"\d{1,6}", value) else 1


def _grid(rows: list) -> list[dict[int, tuple[list[str], int]]]:
    """Per row, column to (lines, columns spanned); cells move right past spans from above."""
    grid, taken = [], {}
    for row in rows:
        placed, at = {}, 0
        for lines, columns, deep in row:
            while taken.get(at, 0) > 0:
                at += 1
            placed[at] = (lines, columns)
            for c in range(at, at + columns):
                taken[c] = max(taken.get(c, 0), deep)
            at += columns
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        grid.append(placed)
    return grid


def _wrapped(lines: list[str]) -> list[str]:
    out = []
    for line in lines:
        if width(line) <= CELL_WIDTH:
            out.append(line)
        else:
            out += textwrap.wrap(
                line, CELL_WIDTH, break_long_words=False, break_on_hyphens=False, replace_whitespace=False,
                drop_whitespace=True,
            )
    return out


def _aligned(grid: list) -> list[str]:
    used = sorted({c for row in grid for c, (lines, _) in row.items() if lines})
    if len(used) < 2:
        # One column is a layout, not a table: its cells are blocks.
        return [line for row in grid for c in sorted(row) for line in row[c][0]]
    grid = [{c: (_wrapped(lines), n) for c, (lines, n) in row.items() if lines} for row in grid]
    size = {c: 0 for c in used}
    for row in grid:
        for c, (lines, n) in row.items():
            if n == 1:
                size[c] = max(size[c], *map(width, lines))
    # A cell over several columns that is wider than they are widens the last of them.
    for row in grid:
        for c, (lines, n) in row.items():
            over = [u for u in used if c <= u < c + n]
            lack = max(map(width, lines), default=0) - sum(size[u] + 2 for u in over) + 2
            if lack > 0:
                size[over[-1]] += lack
    start, at = {}, 0
    for c in used:
        start[c] = at
        at += size[c] + 2
    out = []
    for row in grid:
        for i in range(max((len(lines) for lines, _ in row.values()), default=0)):
            line, filled = "", 0
            for c in sorted(row):
                lines = row[c][0]
                if i < len(lines) and lines[i]:
                    pad = max(start[c] - filled, 2 if line else 0)
                    line += " " * pad + lines[i]
                    filled += pad + width(lines[i])
            out.append(line.rstrip())
    return out


def page_text(html: str | None) -> str:
    """Visible text of a page; null and empty pages have the empty text."""
    if not html:
        return ""
    root, rules = build_tree(html)
    laid, shown = visibility(root, rules, True)
    return "\n".join(run_steps(Renderer(rules).region(root, shown))) if laid else ""


def extract_text(
    pages: DataFrame, page_id: str = "page_id", html: str = "html", out: str = "text"
) -> DataFrame:
    """One row per page: page_id and its visible text, laid out in lines.

    Scripts, styles, head contents, closed details and dialogs, and elements hidden by the
    ``hidden`` attribute, an inline style or a simple style-sheet rule show nothing; an
    element that is visible again inside an invisible one shows.  Null and empty pages give
    the empty text; repeated rows give a row each; null ids stay null.  Broken mark-up is
    read as browsers read it and loses no visible text.  An empty table gives no rows; other
    columns are not read.
    """
    source = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [page_text(body) for body in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", out])

    return source.mapInArrow(run, f"page_id {dict(source.dtypes)['page_id']}, `{out}` string")
