"""Element tree of a web page: implied tags, and which elements are visible."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements that end an open paragraph.
BLOCKS = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary"
    " table ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Start tag: open elements it ends, and those whose contents it cannot reach out of.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "td", "th", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    **{t: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"})
       for t in ("thead", "tbody", "tfoot", "caption", "colgroup")},
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "a": ({"a"}, {"td", "th", "table"}),
    "button": ({"button"}, {"td", "th", "table"}),
}
UNSEEN = set(
    "head title script style template noscript iframe object embed svg canvas audio video datalist"
    " area base link meta param source track noframes rp".split()
)
HEAD_ONLY = {"title", "meta", "link", "base", "style", "script", "noscript", "template"}

# A tag that the page's end cuts off shows nothing.
_CUT_OFF = re.compile(r"</?[a-zA-Z]")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"^([\w-]+|\*)?((?:[.#][\w-]+)*)$")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []


class TreeBuilder(HTMLParser):
    """Tree of a page; missing and misplaced tags are supplied or skipped as browsers do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        # Open elements by tag, so that a deep stack is only searched for what it holds.
        self.held: Counter[str] = Counter()
        self.sheets: list[str] = []

    def _close(self, cut: int) -> None:
        self.held.subtract(node.tag for node in self.open[cut:])
        del self.open[cut:]

    def _pop_to(self, tags: set[str], stop: set[str]) -> None:
        """End the outermost open element of ``tags`` inside the nearest of ``stop``."""
        if not any(self.held[tag] for tag in tags):
            return
        cut = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stop:
                break
            if self.open[i].tag in tags:
                cut = i
        if cut is not None:
            self._close(cut)

    def _push(self, tag: str, attrs: dict[str, str]) -> Node:
        parent = self.open[-1]
        node = Node(tag, attrs)
        parent.children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.held[tag] += 1
        return node

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "body"):
            if tag == "body":
                self._pop_to({"head"}, set())
            self.root.attrs = given | self.root.attrs
            return
        if tag not in HEAD_ONLY and tag != "head":
            self._pop_to({"head"}, set())
        if tag in BLOCKS:
            self._pop_to({"p"}, {"button", "td", "th", "caption", "table", "object"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._close(-1)
        if tag in ENDS:
            self._pop_to(*ENDS[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push("tr", {})
        self._push(tag, given)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self._push("br", {})
        elif tag not in ("html", "body"):
            # A cell's contents cannot end what is open outside it.
            stop = set() if tag in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption") else {"td", "th", "caption"}
            same = HEADINGS if tag in HEADINGS else {tag}
            depth = len(self.open) - 1 if any(self.held[t] for t in same) else 0
            for i in range(depth, 0, -1):
                if self.open[i].tag == tag or tag in HEADINGS and self.open[i].tag in HEADINGS:
                    self._close(i)
                    return
                if self.open[i].tag in stop:
                    break
            if tag == "p":
                self._push("p", {})
                self._close(-1)

    def handle_data(self, data):
        here = self.open[-1]
        if here.tag == "head" and data.strip():
            self._close(-1)
            here = self.open[-1]
        if here.tag == "style":
            self.sheets.append(data)
        here.children.append(data)

    def unknown_decl(self, data):
        pass

    def updatepos(self, i, j):
        # Line and column numbers are not used.
        return j


def build_tree(html: str) -> tuple[Node, list]:
    """The root element and the style sheets' visibility rules."""
    builder = TreeBuilder()
    last = html.rfind("<")
    if last > html.rfind(">") and _CUT_OFF.match(html, last):
        html = html[:last]
    builder.feed(html)
    builder.close()
    return builder.root, visibility_rules("\n".join(builder.sheets))


def declarations(style: str) -> dict[str, str]:
    pairs = (part.partition(":") for part in style.lower().split(";"))
    return {k.strip(): v.replace("!important", "").strip() for k, _, v in pairs}


def visibility_rules(css: str) -> list:
    """(tag, classes, id, declarations) of simple selectors that set display or visibility."""
    css = re.sub(r"/\*.*?(\*/|$)", "", css, flags=re.S)
    css = re.sub(r"@[^{};]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", "", css)
    rules = []
    for selectors, body in _RULE.findall(css):
        found = {k: v for k, v in declarations(body).items() if k in ("display", "visibility")}
        for selector in selectors.split(",") if found else ():
            if m := _SIMPLE.match(selector.strip()):
                marks = re.findall(r"[.#][\w-]+", m[2] or "")
                rules.append((
                    (m[1] or "*").lower(), {x[1:] for x in marks if x[0] == "."},
                    next((x[1:] for x in marks if x[0] == "#"), None), found,
                ))
    # Later rules win among equally specific ones: ids over classes over tags.
    return sorted(rules, key=lambda r: (r[2] is not None, len(r[1]), r[0] != "*"))


def visibility(node: Node, rules: list, inherited: bool) -> tuple[bool, bool]:
    """(whether the element takes part in the layout, whether its own text shows)."""
    attrs, tag = node.attrs, node.tag
    if tag in UNSEEN or "hidden" in attrs or tag == "input" and attrs.get("type", "").lower() == "hidden":
        return False, False
    if tag == "dialog" and "open" not in attrs:
        return False, False
    style: dict[str, str] = {}
    if rules:
        classes = set(attrs.get("class", "").split())
        for name, need, own, found in rules:
            if name in ("*", tag) and need <= classes and (own is None or own == attrs.get("id")):
                style.update(found)
    if "style" in attrs:
        style.update(declarations(attrs["style"]))
    if style.get("display") == "none":
        return False, False
    shown = style.get("visibility")
    return True, inherited if shown in (None, "inherit") else shown == "visible"
