"""Layout-aware rendering of HTML: a tree builder with implied tags, visibility rules, and a text renderer.

All text that a reader would see is kept, with blank lines between paragraphs, markers and indents for lists, and
table cells padded to the width of their columns. Loops are used instead of recursion, so nesting has no limit.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
#: Never shown. The title is, but not on the page.
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title defs metadata desc".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp".split())
#: A blank line stands around these.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table pre blockquote figure fieldset xmp".split())
#: An open p ends where one of these starts.
_ENDS_P = BLOCK - frozenset(["html", "body", "legend", "optgroup", "option"])
#: start tag -> (tags that it ends, tags beyond which it doesn't look)
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
_SCOPE = {"p": {"table", "td", "th", "caption", "button"}}
_CELLS = frozenset(["td", "th"])
_GROUPS = frozenset(["tbody", "thead", "tfoot"])

_TOKEN = re.compile(r"<!--(?:>|->|.*?--!?>|.*\Z)|<!(?!--)[^>]*>?|<\?[^>]*>?|</(?![a-zA-Z])[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*\Z|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_WHITE = re.compile(r"[ \t\n\r\f]+")
_LOOK = re.compile(r"\b(?:hidden|style|type|open|start|value|reversed|colspan|rowspan)\b", re.I)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Stack(list):
    """The open elements; ``count`` tells how many of a tag there are, so that searches in vain are not made."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.count: dict[str, int] = {root.tag: 1}

    def push(self, node: Node) -> None:
        self.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def cut(self, at: int) -> None:
        for node in self[at:]:
            self.count[node.tag] -= 1
        del self[at:]


def parse(source: str) -> Node:
    """The page's tree. Text is a str among the children of a node."""
    root = Node("html", {})
    stack, at, n = Stack(root), 0, len(source)
    match = _TOKEN.match
    while at < n:
        m = match(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                _text(stack, text)
            continue
        tag = tag.lower()
        if m[1]:
            _close(stack, tag)
            continue
        raw = m[3]
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(raw)} if raw and _LOOK.search(raw) else {}
        if tag in ("html", "body", "head") and (tag == "html" or stack.count.get(tag)):
            continue
        _open(stack, tag)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in VOID or (raw.endswith("/") and tag not in BLOCK and tag not in RAW and tag in ("path", "circle", "rect", "line", "use")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            stop = end.start() if end else n
            if tag in ("textarea", "xmp"):
                node.children.append(html.unescape(source[at:stop]) if tag == "textarea" else source[at:stop])
            at = end.end() if end else n
            continue
        stack.push(node)
    return root


def _text(stack: Stack, text: str) -> None:
    top = stack[-1].tag
    if top == "head" and not text.isspace():  # text starts the body
        stack.cut(len(stack) - 1)
    if top in ("table", "tr") or top in _GROUPS:
        if text.isspace():
            return
        for i in range(len(stack) - 1, -1, -1):  # text between cells stands before the table
            if stack[i].tag == "table":
                stack[max(i - 1, 0)].children.insert(max(0, len(stack[max(i - 1, 0)].children) - 1), html.unescape(text) if "&" in text else text)
                return
    stack[-1].children.append(html.unescape(text) if "&" in text else text)


def _end_implied(stack: Stack, ends, stops) -> None:
    if not any(map(stack.count.get, ends)):
        return
    for i in range(len(stack) - 1, 0, -1):
        tag = stack[i].tag
        if tag in stops:
            return
        if tag in ends:
            stack.cut(i)
            return


def _open(stack: Stack, tag: str) -> None:
    """Ends what the tag ends without saying so, and opens what it needs."""
    if stack[-1].tag == "head" and tag not in ("meta", "link", "title", "style", "script", "base", "noscript", "template"):
        stack.cut(len(stack) - 1)
    if tag in _ENDS_P and len(stack) > 1:
        _end_implied(stack, {"p"}, _SCOPE["p"])
    if tag in _IMPLIED:
        ends, stops = _IMPLIED[tag]
        while True:
            before = len(stack)
            _end_implied(stack, ends, stops)
            if len(stack) == before or tag not in ("tr", *_GROUPS):
                break
    top = stack[-1].tag
    if tag in _CELLS:
        if top == "table":
            _push(stack, "tbody")
        if stack[-1].tag in _GROUPS:
            _push(stack, "tr")
    elif tag == "tr" and top == "table":
        _push(stack, "tbody")
    elif tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and top in ("h1", "h2", "h3", "h4", "h5", "h6"):
        stack.cut(len(stack) - 1)


def _push(stack: Stack, tag: str) -> None:
    node = Node(tag, {})
    stack[-1].children.append(node)
    stack.push(node)


def _close(stack: Stack, tag: str) -> None:
    if tag in ("html", "body"):
        return
    if tag == "br":
        stack[-1].children.append(Node("br", {}))
        return
    inner = tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot")
    for i in range(len(stack) - 1 if stack.count.get(tag) else 0, 0, -1):
        if stack[i].tag == tag:
            stack.cut(i)
            return
        if inner and stack[i].tag in ("td", "th", "table"):
            return
    if tag == "p":
        stack[-1].children.append(Node("p", {}))


def _unseen(node: Node) -> bool:
    if node.tag in UNSEEN:
        return True
    a = node.attrs
    return bool(a) and ("hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a) or ("style" in a and _HIDDEN.search(a["style"]) is not None))


class _Out:
    """Lines of text: white space collapses, and blank lines asked for twice come once."""

    def __init__(self):
        self.lines, self.line, self.gap, self.space, self.marker = [], [], 0, False, ""

    def text(self, text: str, indent: str) -> None:
        parts = _WHITE.split(text)
        if parts[0] == "" and self.line:
            self.space = True
        words = [p for p in parts if p]
        if not words:
            return
        if not self.line:
            self.start(indent)
        elif self.space:
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = parts[-1] == ""

    def start(self, indent: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        self.line.append(indent + self.marker)
        self.marker = ""

    def end(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def raw(self, line: str, indent: str) -> None:
        self.end()
        self.start(indent)
        self.line.append(line)
        self.end()

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def _number(value: str, otherwise: int) -> int:
    return int(value) if re.fullmatch(r"[+-]?[0-9]{1,9}", value.strip()) else otherwise


def render(root: Node) -> str:
    """The visible text of a tree."""
    out = _Out()
    #: what is left to do: (node or text, indent, whether spaces stay, list it stands in) or a call
    work: list = [(root, "", False, None)]
    while work:
        item = work.pop()
        if callable(item):
            item()
            continue
        node, indent, pre, lists = item
        if isinstance(node, str):
            if not pre:
                out.text(node, indent)
                continue
            for i, part in enumerate(node.replace("\r\n", "\n").split("\n")):
                if i:
                    if not out.line:
                        out.start(indent)
                    out.end()
                if part:
                    if not out.line:
                        out.start(indent)
                    out.line.append(part)
            continue
        tag = node.tag
        if _unseen(node):
            continue
        if tag == "br":
            if not out.line:
                out.start(indent)
            out.end()
            continue
        if tag == "table":
            out.end()
            out.gap = 1
            for line in table_lines(node):
                out.raw(line, indent)
                out.gap = 0
            out.gap = 1
            continue
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag in BLOCK:
            out.end()
            spaced = tag in SPACED and not (lists is not None and tag in ("ul", "ol", "menu", "dir"))
            if spaced:
                out.gap = 1
            inner = lists
            if tag in ("ul", "menu", "dir"):
                inner, indent = [None], indent if lists is None else indent + "  "
            elif tag == "ol":
                inner, indent = [_number(node.attrs.get("start", "1"), 1)], indent if lists is None else indent + "  "
            elif tag == "li":
                mark = "- "
                if lists and lists[0] is not None:
                    lists[0] = _number(node.attrs.get("value", ""), lists[0])
                    mark, lists[0] = f"{lists[0]}. ", lists[0] + 1
                out.marker = mark
            elif tag in ("dd", "blockquote"):
                indent += "  "

            def after(spaced=spaced):
                out.end()
                out.marker = ""
                if spaced:
                    out.gap = 1

            work.append(after)
            lists = inner
            if tag in ("pre", "xmp"):
                pre = True
                if children and isinstance(children[0], str):
                    children = [children[0].removeprefix("\n"), *children[1:]]
        elif tag == "textarea":
            pre = True
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "text", "svg"):  # cells without a table, labels of a drawing
            out.text(" ", indent)
        work.extend((c, indent, pre, lists) for c in reversed(children))
    return out.result()


def _walk(node: Node, wanted, stop) -> Iterator[Node]:
    """Visible nodes below, in order, of the wanted tags, not looking into them nor into those of stop."""
    work = [c for c in reversed(node.children) if isinstance(c, Node)]
    while work:
        x = work.pop()
        if _unseen(x):
            continue
        if x.tag in wanted:
            yield x
        elif x.tag not in stop:
            work.extend(c for c in reversed(x.children) if isinstance(c, Node))


def _parts(table: Node) -> Iterator[tuple[Node, bool]]:
    """Captions and rows, and whether each is the first of a group or of what follows one."""
    inside = False
    for x in _walk(table, {"caption", "tr"} | _GROUPS, {"table"}):
        if x.tag in _GROUPS:
            inside = True
            yield from ((y, not i) for i, y in enumerate(_walk(x, {"caption", "tr"}, {"table"})))
        else:
            yield x, inside
            inside = False


def table_lines(table: Node) -> list[str]:
    """Rows of cells, each padded to its column; a cell's own lines, and tables in it, come in one line."""
    lines, rows = [], []
    #: column -> rows that a cell from above still covers there; spans end with their group
    down: dict[int, int] = {}
    for part, starts in _parts(table):
        if starts:
            down = {}
        if part.tag == "caption":
            lines += [x for x in _cell(part).split("\n") if x]
            continue
        row: list[str] = []
        below: dict[int, int] = {}
        for cell in _walk(part, _CELLS, {"table", "tr"}):
            while down.get(len(row), 0) > 0:
                row.append("")
            at = len(row)
            row.append(_WHITE.sub(" ", _cell(cell)).strip())
            row += [""] * (min(_number(cell.attrs.get("colspan", "1"), 1), 100) - 1)
            more = _number(cell.attrs.get("rowspan", "1"), 1)
            if more != 1:  # 0: all rows to come
                below.update(dict.fromkeys(range(at, len(row)), more - 1 if more > 0 else 1 << 30))
        down = {i: n - 1 for i, n in down.items() if n > 1} | below
        if row:
            rows.append(row)
    widths: list[int] = []
    for row in rows:
        widths += [0] * (len(row) - len(widths))
        for i, x in enumerate(row):
            widths[i] = max(widths[i], len(x))
    return lines + [" | ".join(x.ljust(w) for x, w in zip(row, widths)).rstrip() for row in rows if any(row)]


def _cell(node: Node) -> str:
    """A cell's text. Tables in it are laid out first, innermost first, so that no call goes deeper than this one."""
    order, work = [], [node]
    while work:
        x = work.pop()
        order.append(x)
        work += [c for c in x.children if isinstance(c, Node)]
    for x in reversed(order):
        if x.tag == "table" and not _unseen(x):
            flat = [[_WHITE.sub(" ", render(_as_div(c))) for c in _walk(r, _CELLS, {"table", "tr"})] for r in _walk(x, {"tr"}, {"table"})]
            caption = [render(_as_div(c)) for c in _walk(x, {"caption"}, {"table", "tr"})]
            x.tag, x.children = "div", ["; ".join([*caption, *(" | ".join(r) for r in flat if r)])]
    return render(_as_div(node))


def _as_div(node: Node) -> Node:
    out = Node("div", {})
    out.children = node.children
    return out


def visible_text(source: str | None) -> str:
    """The visible text of a page; of null or nothing, nothing."""
    return render(parse(source)) if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars): the visible text of each row's page. Null and empty pages have an empty text; ids may be null or repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, text string, n_chars long")
