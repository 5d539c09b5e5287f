"""Layout-aware text of HTML pages.

A tokenizer and a tree builder with implied tags make a tree; what is not visible is taken
out of it; a renderer walks the rest and lays the text out: blocks on lines of their own
with blank lines where margins would be, list items with marks and depth, preformatted
text as it is, and table cells in aligned columns, over row and column spans. Tables in
tables are laid out from the inside, so no depth is treated apart from another, and the
work grows with the page (and the lines of tables in tables).

Visibility: elements that are never shown, the hidden attribute, and display and visibility
from style attributes and from style sheets in the page (selectors of a tag, classes and an
id, by specificity and order; rules within @media and the like are left out). What is
visible in something of hidden visibility is shown. Indents grow to INDENT_MOST columns.

Defined cases: null and empty pages have empty text; unclosed, misnested and unknown
tags never fail; a tag that the page's end cuts off is dropped; of formulas and drawings the text is shown, without titles and notes;
a drop-down shows its chosen option, a list box all; a text area shows its content on
lines of its own; pages of any length are rendered whole and nesting of any depth is
walked without recursion; an empty table gives an empty result; repeated rows give equal
rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from strandloom.llm._shared import slices

# Fixed values of HTML: which elements are void, hidden, raw, blocks, and which end which.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist dialog title area base link meta param source track".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul listing xmp caption tr tbody thead tfoot textarea".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr menu dir fieldset listing xmp".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt listing xmp".split())
#: A start tag of the key ends an open element of the first set, unless one of the second stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "body"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "body"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "body"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "body"}),
    "td": ({"td", "th"}, {"tr", "table", "body"}),
    "th": ({"td", "th"}, {"tr", "table", "body"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table", "body"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table", "body"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table", "body"}),
    "option": ({"option"}, {"select", "body"}),
    "optgroup": ({"option", "optgroup"}, {"select", "body"}),
    "body": ({"head"}, {"body"}),
}
#: What may stand in a head; all else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
#: Of formulas and drawings: what is not shown, what holds HTML again, what stands apart, and the HTML tags that end them.
UNSHOWN = frozenset("title desc metadata defs annotation annotation-xml".split())
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
APART = frozenset("text tspan textpath mtd".split())
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SCOPE = frozenset("table td th caption html body button object template".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_SHOWN = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_CSS_NOTE = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SIMPLE = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z")
_BULLETS = "*-+"
INDENT_MOST = 80


class Node:
    """foreign: an element of a formula or drawing whose content is so too."""

    __slots__ = ("attrs", "children", "foreign", "laid", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, foreign: bool = False):
        self.tag, self.attrs, self.children, self.foreign, self.laid = tag, attrs or {}, [], foreign, None


class _Open:
    """The open elements, and where those of each tag stand among them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.at: dict[str, list[int]] = {}

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        self.at[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The place of the innermost open element of ``tags``, or 0."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def has(self, tag: str) -> bool:
        return bool(self.at.get(tag))

    def close(self, tags, barriers) -> None:
        """Closes the innermost element of ``tags`` above a barrier with all in it, and so on outwards."""
        edge = self.last(barriers)
        while (k := self.last(tags)) > edge:
            while len(self.nodes) > k:
                self.pop()

    def close_one(self, tag: str, barriers) -> None:
        k = self.last((tag,))
        if k > self.last(barriers):
            while len(self.nodes) > k:
                self.pop()


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if source and not source.isspace():
        for name, value in _ATTR.findall(source):
            out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


def build(source: str) -> Node:
    """The tree of a page: start tags imply the end of what cannot hold them; end tags close to their element."""
    root = Node("html")
    stack = _Open(root)

    def text(raw: str) -> None:
        if raw:
            shown = html.unescape(raw) if "&" in raw else raw
            if stack.top.tag == "head" and shown.strip(" \t\n\r\f"):
                stack.pop()  # so does text
            stack.top.children.append(shown)

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        end, tag = m[1], m[2]
        if tag:
            if source[at - 1] != ">":
                break  # the page ends in the tag
            tag = tag.lower()
            if tag == "html" or (tag == "body" and stack.has("body")):
                continue
            foreign = stack.top.foreign
            if foreign and tag in ENDS_FOREIGN:
                while stack.top.foreign:
                    stack.pop()
                foreign = False
            if tag in ("select", "input", "textarea") and not foreign and stack.has("select"):
                stack.close_one("select", ())
                if tag == "select":
                    continue  # it only ends the open one
            if tag in IMPLIED:
                # an outer one may be open as well (a cell in a row)
                tags, barriers = IMPLIED[tag]
                (stack.close if len(tags) > 1 else lambda t, b: stack.close_one(*t, b))(tags, barriers)
            if tag in ENDS_P:
                stack.close_one("p", SCOPE)
            if tag in ("td", "th") and stack.top.tag != "tr" and stack.has("table"):
                row = Node("tr")
                stack.top.children.append(row)
                stack.push(row)
            if stack.top.tag == "head" and tag not in IN_HEAD:
                stack.pop()  # content ends the head
            node = Node(tag, _attributes(m[3]), tag in ("svg", "math") or (foreign and tag not in HOLDS_HTML))
            stack.top.children.append(node)
            if foreign and (tag in UNSHOWN or node.attrs.get("display") == "none" or node.attrs.get("visibility") in ("hidden", "collapse")):
                node.attrs["hidden"] = ""
            if tag in VOID and not foreign:
                continue
            if tag in RAW and not foreign:
                stop = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(source, at)
                inner = source[at : stop.start() if stop else n]
                node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
                at = stop.end() if stop else n
                continue
            if not (foreign or node.foreign) or not m[3].rstrip().endswith("/"):
                stack.push(node)
        elif end:
            end = end.lower()
            if end == "br":
                stack.top.children.append(Node("br"))
            elif end == "p" and not stack.has("p"):
                stack.top.children.append(Node("p"))
            elif end not in ("html", "body"):
                barrier = {"table", "td", "th"} - {end} if end not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") else ({"table"} - {end})
                stack.close_one(end, barrier)
        elif stack.top.foreign and m[0].startswith("<![CDATA["):
            stack.top.children.append(m[0][9:].removesuffix("]]>"))
    return root


def _declared(source: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a declaration list: (important, value), the last of the most important."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value, important in _SHOWN.findall(source):
        name = name.lower()
        if bool(important) >= out.get(name, (False, ""))[0]:
            out[name] = (bool(important), value.lower())
    return out


class Sheets:
    """The rules of a page's style sheets about display and visibility."""

    def __init__(self, root: Node):
        self.by: dict[str, list[tuple[tuple, frozenset, dict]]] = {}
        todo, texts = [root], []
        while todo:
            node = todo.pop()
            if node.tag == "style":
                texts += [x for x in node.children if isinstance(x, str)]
            todo += [x for x in reversed(node.children) if not isinstance(x, str)]
        number = 0
        for source in texts:
            for selector, body in self._blocks(_CSS_NOTE.sub(" ", source)):
                declared = _declared(body)
                for one in selector.split(",") if declared else ():
                    m = _SIMPLE.match(one.strip())
                    if not m or not one.strip():
                        continue
                    number += 1
                    tag = (m[1] or "*").lower()
                    parts = re.findall(r"[.#][\w-]+", m[2])
                    rank = (sum(x[0] == "#" for x in parts), sum(x[0] == "." for x in parts), int(tag != "*"), number)
                    needs = frozenset([*parts, *([tag] if tag != "*" else [])])
                    self.by.setdefault(parts[-1] if parts else tag, []).append((rank, needs, declared))

    @staticmethod
    def _blocks(source: str) -> Iterator[tuple[str, str]]:
        """(selector, declarations) of the rules that stand in no @ block."""
        start, depth, head, at_rule = 0, 0, "", False
        for m in re.finditer(r"[{};]", source):
            mark, here = m[0], m.start()
            if mark == "{":
                if depth == 0:
                    head = source[start:here].strip()
                    at_rule = head.startswith("@")
                    start = here + 1
                depth += 1
            elif mark == "}":
                depth = max(0, depth - 1)
                if depth == 0:
                    if head and not at_rule:
                        yield head, source[start:here]
                    start, head = here + 1, ""
            elif depth == 0:
                start = here + 1  # an @ statement

    def of(self, node: Node) -> dict[str, str]:
        """display and visibility of an element by its rules and its style attribute."""
        found: dict[str, tuple[tuple, str]] = {}
        if self.by:
            names = {f".{x}" for x in node.attrs.get("class", "").split()} | {node.tag}
            if node.attrs.get("id"):
                names.add(f"#{node.attrs['id']}")
            for name in (*names, "*"):
                for rank, needs, declared in self.by.get(name, ()):
                    if needs <= names:
                        for key, (important, value) in declared.items():
                            if key not in found or (important, False, rank) > found[key][0]:
                                found[key] = ((important, False, rank), value)
        if "style" in node.attrs:
            for key, (important, value) in _declared(node.attrs["style"]).items():
                if key not in found or (important, True) >= found[key][0][:2]:
                    found[key] = ((important, True, ()), value)
        return {key: value for key, (_, value) in found.items()}


def shown(root: Node) -> Node:
    """The tree without what is not visible."""
    sheets = Sheets(root)
    todo = [(root, False)]
    while todo:
        node, unseen = todo.pop()
        kept: list = []
        for child in node.children:
            if isinstance(child, str):
                if not unseen:
                    kept.append(child)
                continue
            if child.tag in HIDDEN and not (child.tag == "dialog" and "open" in child.attrs):
                continue
            a = child.attrs
            own = sheets.of(child) if sheets.by or "style" in a else {}
            if own.get("display") == "none" or ("hidden" in a and a["hidden"].lower() != "until-found" and "display" not in own):
                continue
            if child.tag == "input" and a.get("type", "").lower() == "hidden":
                continue
            hides = own["visibility"] in ("hidden", "collapse") if own.get("visibility") in ("hidden", "collapse", "visible") else unseen
            if hides:
                if child.tag in ("img", "input", "hr", "select", "textarea"):
                    continue
                if child.tag in ("li", "q"):
                    child.tag = "div" if child.tag == "li" else "span"  # no mark of its own
            kept.append(child)
            todo.append((child, hides))
        node.children = kept
    return root


class _Lines:
    """Lines of text under construction: collapsed spaces, pending breaks, an indent."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.blank = False
        self.indent = ""
        self.mark = ""

    def words(self, text: str) -> None:
        flat = _SPACE.sub(" ", text)
        if flat.startswith(" "):
            self.space = True
        body = flat.strip(" ")
        if not body:
            return
        if self.now:
            if self.space:
                self.now.append(" ")
        else:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.now.append(self.indent + self.mark)
            self.indent, self.mark = (self.indent + " " * len(self.mark))[:INDENT_MOST], ""
        self.now.append(body)
        self.space = flat.endswith(" ")

    def end(self, spaced: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False
        self.blank |= spaced

    def whole(self, lines: list[str], spaced: bool) -> None:
        """Lines that are already laid out."""
        self.end(spaced)
        if lines:
            if self.blank and self.lines:
                self.lines.append("")
            first = self.indent + self.mark
            self.indent, self.mark = (self.indent + " " * len(self.mark))[:INDENT_MOST], ""
            self.lines += [((first if k == 0 else self.indent) + line).rstrip() for k, line in enumerate(lines)]
            self.blank = spaced


def _rows(table: Node) -> list[tuple[str, Node]]:
    """The table's captions and rows, in order, without those of tables in it."""
    out, todo = [], [iter(table.children)]
    while todo:
        for child in todo[-1]:
            if isinstance(child, str):
                if child.strip():
                    out.append(("stray", Node("span")))
                    out[-1][1].children.append(child)
                continue
            if child.tag in ("col", "colgroup"):
                continue
            if child.tag in ("thead", "tbody", "tfoot"):
                todo.append(iter(child.children))
                break
            out.append((child.tag if child.tag in ("tr", "caption") else "stray", child))
        else:
            todo.pop()
    return out


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "1").strip()
    return min(int(value[:9]), most) if value.isdecimal() and value.isascii() else 1


def table_lines(table: Node) -> list[str]:
    """A table with its columns aligned; cells of several lines keep them; spans take their columns and rows."""
    grid: list[dict[int, list[str]] | list[str]] = []
    below: dict[int, int] = {}  # columns that cells of earlier rows take, and for how many rows more
    for kind, node in _rows(table):
        if kind != "tr":
            grid.append([x for x in render([node]) if x])
            continue
        cells: dict[int, list[str]] = {}
        taken = {c: n - 1 for c, n in below.items() if n > 1}
        column = 0
        for cell in node.children:
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                lines, wide, deep = [_SPACE.sub(" ", cell).strip()], 1, 1
            else:
                lines = render(cell.children if cell.tag in ("td", "th") else [cell])
                wide, deep = max(1, _span(cell, "colspan", 1000)), _span(cell, "rowspan", 65534) or 65534
            while column in below:
                column += 1
            cells[column] = lines
            if deep > 1:
                taken |= dict.fromkeys(range(column, column + wide), deep - 1)
            column += wide
        below = taken
        if any(any(c) for c in cells.values()):
            grid.append(cells)
    width: dict[int, int] = {}
    for row in grid:
        if isinstance(row, dict):
            for c, lines in row.items():
                width[c] = max(width.get(c, 0), max(map(len, lines), default=0))
    columns = sorted(width)
    if len(columns) == 1 and width[columns[0]] > 60:
        width[columns[0]] = 0
    lines: list[str] = []
    for row in grid:
        if isinstance(row, list):
            lines += row
        elif len(columns) == 1:
            lines += [x.rstrip() for x in row[columns[0]]] if columns[0] in row else []
        else:
            used = [c for c in columns if c <= max(row)]
            for k in range(max(map(len, row.values()))):
                lines.append("  ".join((row[c][k] if c in row and k < len(row[c]) else "").ljust(width[c]) for c in used).rstrip())
    return lines


def options(select: Node) -> list:
    """What a select shows: all options and group names of a list box, each on a line; else the chosen option."""
    size = select.attrs.get("size", "1")
    box = "multiple" in select.attrs or (size.isdecimal() and int(size[:9]) > 1)
    lines, chosen, first, todo = [], None, None, [(x, False) for x in reversed(select.children)]
    while todo:
        node, off = todo.pop()
        if isinstance(node, str):
            continue
        off |= "disabled" in node.attrs
        label = node.attrs.get("label")
        if node.tag == "option":
            line = Node("div")
            line.children = [label] if label else node.children
            lines.append(line)
            chosen = line if "selected" in node.attrs else chosen
            first = line if first is None and not off else first
            continue
        if node.tag == "optgroup" and label:
            lines.append(Node("div"))
            lines[-1].children = [label]
        todo += [(x, off) for x in reversed(node.children)]
    if box:
        return lines
    one = chosen or first
    return [" ", *one.children, " "] if one else []


def render(nodes: list) -> list[str]:
    """The lines of nodes in order; tables in them are laid out already."""
    out = _Lines()
    #: (kind, node, what to restore)
    todo: list[tuple] = [("open", x, None) for x in reversed(nodes)]
    lists: list[list] = []
    pre = 0
    while todo:
        kind, node, kept = todo.pop()
        if kind == "close":
            tag = node.tag
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if tag in ("pre", "listing", "xmp", "textarea"):
                pre -= 1
            if tag in BLOCK:
                out.end(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists))
                if kept is not None:
                    out.indent, out.mark = kept, ""
            elif tag in ("td", "th") or (node.foreign and tag in APART):
                out.words(" ")
            continue
        if isinstance(node, str):
            if pre:
                first, *more = node.split("\n")
                if first:
                    out.now.append(first if out.now else out.indent + first)
                for line in more:
                    out.lines.append("".join(out.now).rstrip())
                    out.now = [out.indent + line] if line else []
            else:
                out.words(node)
            continue
        tag = node.tag
        if tag == "br":
            if out.now:
                out.end()
            elif out.lines:
                out.blank = True
            continue
        if tag == "hr":
            out.end(True)
            continue
        if tag == "wbr":
            continue
        if tag == "img":
            if node.attrs.get("alt"):
                out.words(" " + node.attrs["alt"] + " ")
            continue
        if tag == "input":
            if node.attrs.get("type", "text").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
                out.words(" " + node.attrs["value"] + " ")
            continue
        if tag == "select":
            todo += [("open", c, None) for c in reversed(options(node))]
            continue
        if tag == "details" and "open" not in node.attrs:
            title = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo.append(("close", node, None))
            out.end()
            todo += [("open", c, None) for c in reversed(title)]
            continue
        if tag == "table":
            out.whole(node.laid, True)
            continue
        kept = None
        if tag in BLOCK:
            out.end(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists))
            kept = out.indent
        if tag in ("ul", "menu", "dir"):
            lists.append([None])
        elif tag == "ol":
            start = node.attrs.get("start", "1")
            lists.append([int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        elif tag == "li":
            number = lists[-1][0] if lists else None
            if number is None:
                out.mark = _BULLETS[max(0, len(lists) - 1) % 3] + " "
            else:
                out.mark = f"{number}. "
                lists[-1][0] += 1
        elif tag == "dd" or tag == "blockquote":
            out.indent = (out.indent + "  ")[:INDENT_MOST]
        elif tag in ("pre", "listing", "xmp", "textarea"):
            if out.blank and out.lines:
                out.lines.append("")
            out.blank = False
            pre += 1
            if node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
                node.children[0] = node.children[0][1:]
        elif tag == "q":
            out.words('"')
        elif node.foreign and tag in APART:
            out.words(" ")
        todo.append(("close", node, kept))
        todo += [("open", c, None) for c in reversed(node.children)]
    out.end()
    return out.lines


def extract(source: str | None) -> str:
    """The visible text of a page."""
    if not source:
        return ""
    root = shown(build(source))
    tables, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "table":
            tables.append(node)
        todo += [x for x in node.children if not isinstance(x, str)]
    for table in reversed(tables):  # those in others come after them
        table.laid = table_lines(table)
    return "\n".join(render([root])).strip("\n")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                texts = [extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string")
