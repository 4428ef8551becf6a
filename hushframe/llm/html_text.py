"""Visible text of HTML pages by layout: a tree with implied tags, rules of visibility, and rendering in blocks."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import slices, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe object svg canvas audio video datalist noembed noframes select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table ul tr caption tbody thead tfoot".split()
)
#: Blocks with an empty line before and after.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu".split())
#: An opening tag ends an open one of these kinds, if no boundary stands between.
ENDS = {
    **{t: ("p",) for t in BLOCK - {"li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}},
    "li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "option": ("option",),
    "tr": ("tr", "td", "th", "p", "caption", "colgroup"), "td": ("td", "th", "p", "caption", "colgroup"), "th": ("td", "th", "p", "caption", "colgroup"),
    "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th", "p", "caption", "colgroup"), "thead": ("caption", "colgroup"),
    "tfoot": ("thead", "tbody", "tr", "td", "th", "p", "caption", "colgroup"), "colgroup": ("caption", "colgroup"),
    "body": ("head",),
}
BOUNDS = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",)} | dict.fromkeys(("tr", "td", "th", "tbody", "thead", "tfoot", "colgroup"), ("table",))
SCOPE = frozenset("table td th caption button html body template object".split())
#: Tables within cells, this many deep, are aligned; deeper ones are rendered as blocks.
NESTED = 40
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.children = name, attrs, []

    def get(self, key: str) -> str | None:
        """An attribute's value; empty if it has none, None if it is absent."""
        if not self.attrs:
            return None
        for k, a, b, c in _ATTR.findall(self.attrs):
            if k.lower() == key:
                return html.unescape(a or b or c)
        return None


def parse(text: str) -> Node:
    """The tree of a page. Tags that HTML lets authors leave out are implied; stray end tags are passed over."""
    root = Node("#root")
    stack, at, size = [root], 0, len(text)
    add = lambda s: stack[-1].children.append(html.unescape(s) if "&" in s else s)
    while at < size:
        m = _TOKEN.search(text, at)
        if not m:
            add(text[at:])
            break
        if m.start() > at:
            if stack[-1].name == "head" and text[at : m.start()].strip():
                stack.pop()
            add(text[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "p" and not _open(stack, "p", SCOPE):
                stack[-1].children.append(Node("p"))
            elif name == "br":
                stack[-1].children.append(Node("br"))
            elif place := _open(stack, name, _end_bounds(name)):
                del stack[place:]
            continue
        if stack[-1].name == "head" and name not in HIDDEN and name not in ("meta", "link", "base"):
            stack.pop()
        if name in ENDS:
            _implied_ends(stack, ENDS[name], BOUNDS.get(name))
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            _push(stack, Node("tr"))
        attrs = m["attrs"]
        node = Node(name, attrs)
        if name in VOID or attrs.endswith("/") and name in ("path", "circle", "rect", "use"):
            stack[-1].children.append(node)
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(text, at)
            inner = text[at : end.start() if end else size]
            at = end.end() if end else size
            node.children.append(html.unescape(inner) if name in ("title", "textarea") else inner)
            stack[-1].children.append(node)
        else:
            _push(stack, node)
    return root


def _end_bounds(name: str) -> frozenset[str]:
    """What an end tag doesn't reach across."""
    if name in ("html", "body", "table"):
        return frozenset()
    return frozenset({"table"}) if name in BOUNDS and BOUNDS[name] == ("table",) else SCOPE - {name}


def _push(stack: list[Node], node: Node) -> None:
    stack[-1].children.append(node)
    stack.append(node)


def _open(stack: list[Node], name: str, bounds: frozenset[str]) -> int:
    """Where the innermost open element of this name is, 0 if a boundary comes first."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name == name:
            return i
        if stack[i].name in bounds:
            return 0
    return 0


def _implied_ends(stack: list[Node], kinds: tuple[str, ...], bounds: tuple[str, ...] | None) -> None:
    stop = frozenset(bounds) if bounds else SCOPE
    least = 0
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in kinds:
            least = i
        elif stack[i].name in stop:
            break
    if least:
        del stack[least:]


def hidden(node: Node) -> bool:
    if node.name in HIDDEN or node.name == "dialog" and node.get("open") is None:
        return True
    low = node.attrs.lower() if node.attrs else ""
    if not low:
        return False
    if "hidden" in low and (node.get("hidden") is not None or (node.get("aria-hidden") or "").lower() == "true"):
        return True
    if node.name == "input":
        return (node.get("type") or "").lower() == "hidden"
    return "style" in low and bool(_INVISIBLE.search(node.get("style") or ""))


def _width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in s) if not s.isascii() else len(s)


class Writer:
    """Lines of text: white space runs become one space, and blocks ask for breaks of one or two lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.lead = "", 0, ""
        self.indent: list[str] = []

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self._put(first)
            for x in rest:
                self.flush(True)
                self._put(x)
            return
        s = _SPACES.sub(" ", s)
        if not self.line or self.line[-1] == " ":
            s = s.lstrip(" ")
        self._put(s)

    def _put(self, s: str) -> None:
        self.line += s

    def flush(self, even_empty: bool = False) -> None:
        line = self.line.rstrip(" ")
        self.line = ""
        if line.strip() or even_empty:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 1
            self.lines.append(("".join(self.indent) + self.lead + line).rstrip(" "))
            if self.lead:
                self.lead = ""

    def end_block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)


def render(root: Node, depth: int = 0) -> str:
    """All visible text of the tree, without recursion, so that depth has no bound but memory."""
    w = Writer()
    w.gap = 1
    # ("open", node, pre) and ("close", node)
    todo: list[tuple] = [(0, root, False)]
    lists: list[list] = []
    while todo:
        kind, node, pre = todo.pop()
        if isinstance(node, str):
            w.text(node, pre)
            continue
        name = node.name
        if kind == 1:
            _close(w, node, lists)
            continue
        if hidden(node):
            continue
        if name == "br":
            w.flush(True)
            continue
        if name == "img":
            if alt := (node.get("alt") or "").strip():
                w.text(alt, False)
            continue
        if name == "hr":
            w.end_block(1)
            continue
        if name == "table" and depth < NESTED:
            w.end_block(2)
            for line in table_lines(node, depth + 1):
                w.line = line
                w.flush()
            w.end_block(2)
            continue
        if name in BLOCK:
            nested = name in ("ul", "ol", "menu", "dir") and lists
            w.end_block(1 if nested or name not in SPACED else 2)
            if name in ("ul", "ol", "menu", "dir"):
                start = node.get("start") or "1"
                lists.append([name == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                if len(lists) > 1:
                    w.indent.append("  ")
            elif name == "li":
                if lists and lists[-1][0]:
                    w.lead = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    w.lead = "- "
            elif name in ("blockquote", "dd"):
                w.indent.append("  ")
            todo.append((1, node, False))
        elif name in ("td", "th"):
            w.text(" ", False)
        elif name == "q":
            w.text('"', False)
            todo.append((1, node, False))
        inner = pre or name in ("pre", "textarea")
        todo += [(0, c, inner) for c in reversed(node.children)]
    w.flush()
    return "\n".join(w.lines).strip("\n")


def _close(w: Writer, node: Node, lists: list[list]) -> None:
    name = node.name
    if name == "q":
        w.text('"', False)
        return
    if name in ("ul", "ol", "menu", "dir"):
        w.flush()
        lists.pop()
        if lists:
            w.indent.pop()
        w.end_block(1 if lists else 2)
    else:
        w.end_block(2 if name in SPACED else 1)
        if name == "li":
            w.lead = ""
        elif name in ("blockquote", "dd"):
            w.indent.pop()


def table_lines(node: Node, depth: int = 1) -> list[str]:
    """Rows of a table's visible cells, columns aligned by padding with spaces; a caption comes first."""
    rows: list[list[tuple[str, int]]] = []
    out: list[str] = []
    todo: list[Node] = [node]
    while todo:
        x = todo.pop()
        inner: list[Node] = []
        for c in x.children:
            if isinstance(c, str):
                if c.strip():
                    out.append(_SPACES.sub(" ", c).strip())
            elif hidden(c):
                continue
            elif c.name == "tr":
                cells = []
                for d in c.children:
                    if isinstance(d, str):
                        if d.strip():
                            cells.append((_SPACES.sub(" ", d).strip(), 1))
                    elif not hidden(d):
                        span = d.get("colspan") or "1"
                        inner_root = Node("#root")
                        inner_root.children = d.children if d.name in ("td", "th") else [d]
                        cells.append((" ".join(x for x in render(inner_root, depth).split("\n") if x), min(1000, int(span)) if re.fullmatch(r"[1-9]\d{0,5}", span) else 1))
                rows.append(cells)
            elif c.name in ("tbody", "thead", "tfoot", "colgroup"):
                inner.append(c)
            else:
                inner_root = Node("#root")
                inner_root.children = [c]
                out += [s for s in render(inner_root, depth).split("\n") if s]
        todo += reversed(inner)
    widths: dict[int, int] = {}
    for cells in rows:
        at = 0
        for s, span in cells:
            if span == 1:
                widths[at] = max(widths.get(at, 0), _width(s))
            at += span
    for cells in rows:
        line, at = "", 0
        for s, span in cells:
            room = sum(widths.get(i, 0) + 2 for i in range(at, at + span)) - 2
            line += s + " " * max(0, room - _width(s)) + "  "
            at += span
        if line.strip():
            out.append(line.rstrip())
    return out


def html_text(page: str | None) -> str:
    """Visible text of one page; null gives the empty text."""
    return render(parse(page.replace("\x00", ""))) if page else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every page.

    Rows are independent. A null or empty page gives the empty text, malformed markup whatever a reader would see;
    ids may be null or repeat; an empty table gives none; other columns are not read. Pages of any length are parsed
    whole, in memory of some times their size; a nested table is rendered within its cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "h"):
            texts = [html_text(x) for x in batch.column("h").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    kind = dict(pages.dtypes)[id_col]
    plain = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("h"))
    return plain.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages, with its number of lines and its digest."""
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select(
        "page_id", "text", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"), F.sha2("text", 256).alias("text_sha256")
    )
