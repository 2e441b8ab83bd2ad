"""HTML extraction: layout-aware rendering.

A tokenizer and a tree builder with implied tags make a tree of elements, and a
renderer emits all visible text: paragraphs apart by an empty line, other
blocks on lines of their own, lists with markers and indents, preformatted
text as it is, table cells in aligned columns.  One pass, no shuffle.

Visible is what a browser without scripts or style sheets shows: not head,
script, style, template, fallback content of media, attributes `hidden`, inline
display:none, visibility:hidden (which a descendant may lift), closed dialogs,
and closed details but for their summary.

Work is linear in the page but for what is aligned.  As in browsers, no more
than DEPTH elements are open at once: what is nested deeper stands beside what
it is in, with all its text.  Cells of a table are padded to columns unless
that would make it wider than WIDEST characters; then two spaces part them.
Both are parameters of `extract`: a table of n rows and a column of w characters
may become n * w of them, so without a bound a page of 1 MB (half of it one cell,
half of it rows of ten characters) becomes 25 GB.

Defined cases: null and empty pages give an empty text; broken and unclosed
mark-up is read to its end, and a tag that never ends shows as text; repeated
rows are rendered alike; null ids stay, and ids keep their type.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from cloakframe.llm import kit

#: No part gives a character back, so a page is read once: a tag ends at its first > outside quoted values, or with the page.
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]+|<", re.S)
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{8,});?")  # of no character
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style template title iframe noembed noframes audio video canvas object datalist base link meta col colgroup param source track area".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure dl ul ol menu table hr".split())
BLOCK = PARAGRAPH | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main nav search section summary caption tr option optgroup thead tbody tfoot".split())
ENDS_P = (BLOCK - frozenset("body html tr option optgroup caption thead tbody tfoot".split())) | {"li", "dd", "dt"}
CELLS, ROWS, SECTIONS = frozenset(("td", "th")), frozenset(("tr",)), frozenset(("thead", "tbody", "tfoot"))
#: A start tag ends open elements of these names, up to the nearest of those.
IMPLIES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "td", "th", "table"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "td", "th", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "td", "th", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup", "table"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select", "table"))),
    "td": (CELLS | {"caption", "colgroup"}, frozenset(("tr", "table"))),
    "th": (CELLS | {"caption", "colgroup"}, frozenset(("tr", "table"))),
    "tr": (CELLS | ROWS | {"caption", "colgroup"}, frozenset(("table",))),
    **{s: (CELLS | ROWS | SECTIONS | {"caption", "colgroup"}, frozenset(("table",))) for s in ("thead", "tbody", "tfoot", "caption", "colgroup")},
    "body": (frozenset(("head",)), frozenset()),
}
#: Open elements in which only rows, cells and the like may stand, and what else has no place of its own there.
BARE = frozenset(("table", "tr")) | SECTIONS
PARTS = CELLS | BARE | {"caption", "colgroup", "col", "script", "style", "template"}
FENCE = frozenset(("td", "th", "caption", "table", "template", "object"))
#: Fixed value: browsers keep 512 elements open at most.
DEPTH = 512
WIDEST = 2000


def decoded(text: str) -> str:
    """Text with its character references replaced."""
    return unescape(_LONG_REFERENCE.sub("\ufffd", text)) if "&" in text else text


class Node:
    __slots__ = ("name", "attrs", "kids", "up")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.kids, self.up = name, attrs, [], None

    def get(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for m in _ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return decoded(m[2] or m[3] or m[4] or "")
        return None


def parse(page: str, deepest: int = DEPTH) -> Node:
    """The tree of a page; text lies in it as plain strings."""
    root = Node("html")
    stack, at, end = [root], 0, len(page)
    open_ = {"html": [0]}  # places in the stack, by name

    def add(kid):
        """Puts a node or text where it belongs: what stands in a table but in no cell goes before the table."""
        up = stack[-1]
        if up.name in BARE and (kid.name not in PARTS if isinstance(kid, Node) else kid.strip()):
            if open_.get("table"):
                up = stack[open_["table"][-1]].up
                up.kids.insert(len(up.kids) - 1, kid)
            else:
                up.kids.append(kid)
        else:
            up.kids.append(kid)
        if isinstance(kid, Node):
            kid.up = up

    def push(node):
        if len(stack) >= deepest:
            pop_to(deepest - 1)
        add(node)
        open_.setdefault(node.name, []).append(len(stack))
        stack.append(node)

    def pop_to(depth):
        while len(stack) > depth:
            open_[stack.pop().name].pop()

    def nearest(names):
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((open_[x][-1] for x in names if open_.get(x)), default=0)

    def close(names, fences):
        """Ends the outermost open element of these names inside the nearest fence."""
        fence = nearest(fences)
        inside = [open_[x][bisect_right(open_[x], fence)] for x in names if open_.get(x) and open_[x][-1] > fence]
        if inside:
            pop_to(min(inside))

    while at < end:
        m = _TOKEN.match(page, at)
        at, name = m.end(), m[2]
        if name is None:
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                if stack[-1].name == "colgroup" and text.strip():
                    pop_to(len(stack) - 1)
                add(decoded(text))
            continue
        if not m[4]:
            add(decoded(m[0]))
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                add(Node("br"))
            elif open_.get(name) and name not in ("html", "body"):
                if name == "table" or name in ROWS or name in SECTIONS or name in CELLS or open_[name][-1] >= nearest(FENCE):
                    pop_to(open_[name][-1])
            continue
        if name in ("html", "body") and open_.get(name):
            continue
        if name in IMPLIES:
            close(*IMPLIES[name])
        if name in ENDS_P and open_.get("p"):
            close(("p",), FENCE)
        if open_.get("head") and name not in ("base", "link", "meta", "title", "style", "script", "template", "noscript", "head"):
            close(("head",), ())
        if stack[-1].name == "colgroup" and name not in ("col", "template"):
            pop_to(len(stack) - 1)
        if name in PARTS and name not in ("table", "script", "style", "template") and open_.get("table"):
            # They end what was moved out of the table.
            i = nearest(BARE | FENCE)
            if stack[i].name in BARE:
                pop_to(i + 1)
        if stack[-1].name in BARE and open_.get("table"):
            if name == "form":
                continue  # its rows and cells are the table's
            if name == "table":
                pop_to(open_["table"][-1])
        # Cells and rows imply what must be around them.
        if name in CELLS and open_.get("table"):
            if stack[-1].name == "table":
                push(Node("tbody"))
            if stack[-1].name in SECTIONS:
                push(Node("tr"))
        elif name == "tr" and stack[-1].name == "table":
            push(Node("tbody"))
        attrs = m[3]
        if name in VOID:
            add(Node(name, attrs))
        elif name in RAW:
            node = Node(name, attrs)
            add(node)
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?|\Z", re.I).search(page, at)
            if name not in UNSEEN:
                body = page[at : stop.start()]
                node.kids.append(decoded(body) if name == "textarea" else body)
            at = stop.end()
        else:
            push(Node(name, attrs))
    return root


def _shown(node: Node, seen: bool, in_details: bool) -> tuple[bool, bool]:
    """(whether the node takes part in the layout, whether its own text is seen)."""
    if node.name in UNSEEN or in_details and node.name != "summary":
        return False, False
    if node.attrs:
        low = node.attrs.lower()
        if "hidden" in low and node.get("hidden") is not None:
            return False, False
        if "style" in low and (style := node.get("style")):
            style = re.sub(r"\s", "", style.lower())
            if "display:none" in style:
                return False, False
            if "visibility:hidden" in style or "visibility:collapse" in style:
                seen = False
            elif "visibility:visible" in style:
                seen = True
    if node.name == "dialog" and node.get("open") is None:
        return False, False
    return True, seen


class _Lines:
    """Lines so far, with the spacing that is due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # white space is due before more text on this line
        self.gap = 0  # 1: a new line is due, 2: an empty line as well
        self.indent, self.marker = "", None

    def text(self, s: str, pre: bool) -> None:
        if pre:
            parts = s.replace("\r\n", "\n").split("\n")
            for k, part in enumerate(parts):
                if k:
                    self.line()
                if part:
                    self.put(part)
            return
        words = s.split(" ") if s.isalnum() else re.split(r"[ \t\n\r\f]+", s)
        if words[0] == "" and self.now:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            self.put(body)
            self.space = words[-1] == ""

    def put(self, s: str) -> None:
        if not self.now:
            if self.gap == 2 and self.lines and self.lines[-1] != "":
                self.lines.append("")
            self.gap = 0
            if self.marker is not None:
                self.now.append(self.marker)
                self.marker = None
            else:
                self.now.append(self.indent)
        elif self.space:
            self.now.append(" ")
        self.space = False
        self.now.append(s)

    def line(self) -> None:
        """Ends the line, even an empty one (br)."""
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        elif self.lines and not self.gap and self.lines[-1] != "":
            self.lines.append("")
        self.space = False

    def block(self, gap: int) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.block(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _rows(table: Node, seen: bool):
    """Rows of a table's own cells (node, seen), captions apart."""
    captions, rows, todo = [], [], [(table, seen, iter(table.kids))]
    while todo:
        node, seen, kids = todo[-1]
        for kid in kids:
            if isinstance(kid, str):
                continue
            ok, sees = _shown(kid, seen, False)
            if not ok:
                continue
            if kid.name == "caption":
                captions.append((kid, sees))
            elif kid.name == "tr":
                rows.append([(c, s) for c in kid.kids if not isinstance(c, str) for o, s in [_shown(c, sees, False)] if o and c.name in CELLS])
            elif kid.name in SECTIONS:
                todo.append((kid, sees, iter(kid.kids)))
                break
            else:
                rows.append([(kid, sees)])
        else:
            todo.pop()
    return captions, rows


def _span(node: Node, name: str) -> int:
    """Columns or rows that a cell takes; of rows 0 is all that are left of the cell's section."""
    v = node.get(name) or "1"
    if not (v.isascii() and v.isdigit()):
        return 1
    return 0 if name == "rowspan" and int(v) == 0 else min(max(int(v), 1), 1000)


def _section(row: list) -> Node | None:
    """The part of a table that a row's cells stand in."""
    node = row[0][0].up if row else None
    return node.up if node is not None and node.name == "tr" else node


def _table(node: Node, seen: bool, widest: int | None) -> list[str]:
    captions, rows = _rows(node, seen)
    out = [line for c, s in captions for line in _render(c, s, widest)]
    grid, busy, section, ends = [], [], None, []  # busy: (from, to, first row in which it is free) of columns that cells of earlier rows reach into
    for y, row in enumerate(rows):
        cells, x, k, more, lasting = [], 0, 0, [], []
        if row and _section(row) is not section:
            section, ends = _section(row), []
        busy = [b for b in busy if b[2] > y]
        taken = sorted(busy + ends)  # ends: what goes on to the end of the section
        for c, s in row:
            while k < len(taken) and taken[k][0] <= x:
                x, k = max(x, taken[k][1]), k + 1
            wide, tall = _span(c, "colspan"), _span(c, "rowspan")
            cells.append((x, _render(c, s, widest), wide))
            if tall > 1:
                more.append((x, x + wide, y + tall))
            elif tall == 0:
                lasting.append((x, x + wide, 0))
            x += wide
        if more:
            busy = sorted(busy + more)
        ends += lasting
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for x, lines, wide in cells:
            if wide == 1 and lines:
                width[x] = max(width.get(x, 0), *map(len, lines))
    columns = sorted(width)
    place = [0]
    for x in columns:
        place.append(place[-1] + width[x] + 2)
    aligned = widest is None or place[-1] <= widest
    for cells in grid:
        at = [place[bisect_left(columns, x)] if aligned else 0 for x, _, _ in cells]
        for k in range(max((len(lines) for _, lines, _ in cells), default=0)):
            line, size = [], 0
            for (_, lines, _), left in zip(cells, at):
                if k < len(lines) and lines[k]:
                    gap = max(left - size, 2 if size else 0)
                    line += " " * gap, lines[k]
                    size += gap + len(lines[k])
            out.append("".join(line))
    return out


def _render(root: Node, seen: bool = True, widest: int | None = WIDEST) -> list[str]:
    out = _Lines()
    lists: list[list] = []  # [next number or None, indent outside]
    todo = [(root, iter(root.kids), seen, False, None)]
    while todo:
        node, kids, seen, pre, undo = todo[-1]
        kid = next(kids, None)
        if kid is None:
            todo.pop()
            if node.name in BLOCK and todo:
                out.block(2 if node.name in PARAGRAPH and not (node.name in ("ul", "ol", "menu", "dir") and len(lists) > 1) else 1)
            if undo is not None:
                undo()
            continue
        if isinstance(kid, str):
            if seen and not (node.name == "details" and node.get("open") is None):
                out.text(kid, pre)
            continue
        name = kid.name
        ok, sees = _shown(kid, seen, node.name == "details" and node.get("open") is None)
        if not ok:
            continue
        if name == "br":
            out.line()
            continue
        if name == "hr":
            out.block(2)
            continue
        if name == "input" and sees and (kid.get("type") or "text").lower() in ("submit", "button", "reset") and kid.get("value"):
            out.text(kid.get("value"), False)
            continue
        if name == "table":
            out.block(2)
            for line in _table(kid, sees, widest):
                out.put(line) if line else None
                out.block(1)
            out.block(2)
            continue
        undo = None
        if name in BLOCK:
            out.block(2 if name in PARAGRAPH and not (name in ("ul", "ol", "menu", "dir") and lists) else 1)
        if name in ("ul", "ol", "menu", "dir"):
            start = kid.get("start") if name == "ol" else None
            lists.append([int(start) if start and re.fullmatch(r"-?\d{1,9}", start) else 1 if name == "ol" else None])
            undo = lists.pop
        elif name == "li":
            mark = "- "
            if lists and lists[-1][0] is not None:
                value = kid.get("value")
                if value and re.fullmatch(r"-?\d{1,9}", value):
                    lists[-1][0] = int(value)
                mark = f"{lists[-1][0]}. "
                lists[-1][0] += 1
            was = out.indent
            out.marker, out.indent = was + mark, was + " " * len(mark)

            def undo(was=was):
                out.indent, out.marker = was, None

        elif name in ("dd", "blockquote"):
            was = out.indent
            out.indent = was + "    "

            def undo(was=was):
                out.indent = was

        elif name in CELLS:
            out.space = bool(out.now)
        elif name == "q" and sees:
            out.text('"', True)

            def undo():
                out.now.append('"') if out.now else out.put('"')

        todo.append((kid, iter(kid.kids), sees, pre or name in ("pre", "textarea", "xmp", "listing"), undo))
    return out.done()


def render(page: str | None, widest: int | None = WIDEST, deepest: int = DEPTH) -> str:
    """The visible text of a page."""
    return "\n".join(_render(parse(page, deepest), True, widest)) if page else ""


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", widest: int | None = WIDEST, deepest: int = DEPTH) -> DataFrame:
    """key, text, n_lines of every row; widest: characters of a table's columns above which they are not aligned (null: they always are); deepest: elements open at once."""
    from pyspark.sql import types as T

    source = pages.select(pages[f"`{key}`"], pages[f"`{html}`"].cast("string").alias("__html"))

    def run(batches):
        for batch in batches:
            for part in kit.slices(batch, "__html", 4 << 20):
                texts = [render(x, widest, deepest) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64())], names=[key, "text", "n_lines"])

    return source.mapInArrow(kit.trimmed(run), T.StructType([pages.schema[key], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType())]))
