"""Visible text of HTML pages, laid out as a browser would: blocks, lists and aligned tables.

A tolerant tree builder supplies the tags that HTML lets authors leave out; visibility rules drop what is not shown;
rendering keeps the spacing between blocks, marks list items and pads the cells of data tables to columns. Both use
stacks of their own, so pages may nest to any depth.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video "
                   "canvas meta link base param source track col colgroup".split())
#: Drawings and formulas are shown, but for what only describes or defines something in them.
FOREIGN = ("svg", "math")
SVG_HIDDEN = frozenset("title desc defs metadata style script symbol clippath mask marker pattern filter "
                       "lineargradient radialgradient".split())
MATH_HIDDEN = frozenset("annotation annotation-xml mphantom".split())
#: In them HTML begins again.
INTEGRATION = ("foreignobject", "desc", "mi", "mo", "mn", "ms", "mtext", "annotation-xml")
#: HTML elements that end a drawing or a formula left open.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Their children stand above, below or beside each other: they are no single number or word.
APART = frozenset("mfrac mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr mlabeledtr".split())
#: Blocks; those with a margin are set off by an empty line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset menu hr xmp".split())
BLOCKS = SPACED | frozenset(
    "address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup "
    "html legend li main nav option optgroup section select summary caption thead tbody tfoot tr td th".split())
#: A start tag ends an open element of these names, unless one of the scope's names stands between.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "thead": ("thead", "tbody", "tfoot"),
    "tbody": ("thead", "tbody", "tfoot", "caption"), "tfoot": ("thead", "tbody", "tfoot"),
}
SCOPES = {
    "li": frozenset(("ul", "ol", "menu", "dir", "table", "td", "th")), "dt": frozenset(("dl", "table", "td", "th")),
    "dd": frozenset(("dl", "table", "td", "th")), "option": frozenset(("select", "datalist")),
    "optgroup": frozenset(("select", "datalist")),
}
TABLE = frozenset(("table",))
CLOSES_P = BLOCKS - frozenset("html body option optgroup tr td th thead tbody tfoot caption".split())
P_SCOPE = frozenset(("table", "td", "th", "caption", "button", "object"))
#: In a table they tell that it holds data; the others, in a cell, that the table only lays out the page.
DATA_MARKS = frozenset("th caption thead tfoot".split())
LAYOUT_MARKS = frozenset("table article aside footer header main nav section h1".split())
#: A table that holds tables nested this deep lays out the page, whatever its marks.
LAYOUT_NESTING = 8
#: Nested lists and quotes are indented up to this width; deeper ones keep their marks, but move no further.
MAX_INDENT = 400
#: Lines of cells are padded to at most this width; longer ones run on, and the separator follows them.
MAX_CELL = 80
#: A table that padding makes this many times as long as its text, and longer than MAX_PADDED, has one line a row.
PADDED_TIMES, MAX_PADDED = 100, 1_000_000
MAX_COLSPAN = 1000

SPECIAL = re.compile(r"[>\"']")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
BLANKS = re.compile(r"[ \t\n\f\r]+")
#: Declarations that decide whether something is shown, and selectors of one element by name, classes and ids.
SHOWING = re.compile(r"display|visibility", re.IGNORECASE)
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.IGNORECASE)
SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    #: Of a table: whether it shows signs of data or of layout. Of an element of a drawing: whether it has its own line.
    signs: frozenset[str] = frozenset()


# ---- tokens ----------------------------------------------------------------------------------------------------


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """``(kind, name or text, attributes)``; kinds are text, raw, start, empty and end.

    Every character is looked at a few times. An empty element is one that ends itself, in a drawing or a formula.
    """
    lowered = None
    spaces: list[str] = []  # open drawings and formulas, and HTML inside them
    last_quote = {q: html.rfind(q) for q in "\"'"}
    at, n = 0, len(html)
    while at < n:
        tag = html.find("<", at)
        if tag < 0:
            yield "text", html[at:], {}
            return
        if tag > at:
            yield "text", html[at:tag], {}
        following = html[tag + 1:tag + 2]
        if html.startswith("<!--", tag):
            end = html.find("-->", tag + 4)
            at = n if end < 0 else end + 3
            continue
        foreign = bool(spaces) and spaces[-1] in FOREIGN
        if foreign and html.startswith("<![CDATA[", tag):
            end = html.find("]]>", tag)
            yield "raw", html[tag + 9:n if end < 0 else end], {}
            at = n if end < 0 else end + 3
            continue
        if following in ("!", "?"):
            end = html.find(">", tag)
            at = n if end < 0 else end + 1
            continue
        name = NAME.match(html, tag + (2 if following == "/" else 1))
        if not name:
            yield "text", "<", {}
            at = tag + 1
            continue
        end = tag_end(html, name.end(), last_quote)
        tag_name = name[0].lower()
        if following == "/":
            if tag_name in spaces:
                while spaces.pop() != tag_name:
                    pass
            yield "end", tag_name, {}
            at = end + 1
            continue
        inside = html[name.end():end]
        attributes: dict[str, str] = {}
        if inside and not inside.isspace():
            for key, *values in ATTRIBUTE.findall(inside):
                attributes.setdefault(key.lower(), unescape("".join(values)))
        at = end + 1
        if inside.endswith("/") and (tag_name in FOREIGN or (foreign and tag_name not in BREAKOUT)):
            yield "empty", tag_name, attributes
            continue
        if foreign and tag_name in BREAKOUT:
            while spaces and spaces[-1] in FOREIGN:
                spaces.pop()
        elif tag_name in FOREIGN or (foreign and tag_name == "foreignobject"):
            spaces.append(tag_name)
        yield "start", tag_name, attributes
        if tag_name in RAW and at < n:
            lowered = lowered or html.replace("İ", ".").lower()
            close = lowered.find("</" + tag_name, at)
            close = n if close < 0 else close
            if close > at:
                yield "raw", html[at:close], {}
            at = close


def tag_end(html: str, at: int, last_quote: dict[str, int]) -> int:
    """Place of the ``>`` that ends a tag; quoted ones do not. A quote that is never closed is an ordinary character."""
    while found := SPECIAL.search(html, at):
        mark = found[0]
        if mark == ">":
            return found.start()
        at = found.end() if found.start() >= last_quote[mark] else html.find(mark, found.end()) + 1
    return len(html)


# ---- the tree --------------------------------------------------------------------------------------------------


def tree(html: str) -> Node:
    root = Node("html")
    stack = [root]
    #: Where the open elements of each name stand in the stack: no end tag has to search it.
    places: dict[str, list[int]] = defaultdict(list)

    def last(names) -> int:
        return max((places[n][-1] for n in names if n in places and places[n]), default=0)

    def cut(size: int) -> None:
        while len(stack) > size:
            places[stack.pop().tag].pop()

    def close(names: tuple[str, ...], scope: frozenset[str]) -> None:
        at = last(names)
        if at and at >= last(scope):
            cut(at)

    def open_(tag: str, attributes: dict[str, str], empty: bool = False) -> None:
        node = Node(tag, attributes)
        svg, math = last(("svg",)), last(("math",))
        if svg and svg > max(math, last(("foreignobject",))):
            if "visibility" in attributes:
                node.signs |= {"concealed" if attributes["visibility"] in ("hidden", "collapse") else "shown"}
            if tag in SVG_HIDDEN or attributes.get("display") == "none":
                attributes["hidden"] = ""
            elif tag in ("text", "foreignobject") or (tag == "tspan" and not attributes.keys().isdisjoint("xy")):
                node.signs |= {"line"}
        elif math > svg:
            if tag in MATH_HIDDEN:
                attributes["hidden"] = ""
            if stack[-1].tag in APART:
                stack[-1].children.append(" ")
        stack[-1].children.append(node)
        tables = places["table"]
        if tables and tag in DATA_MARKS:
            stack[tables[-1]].signs |= {"data"}
        if tables and tag in LAYOUT_MARKS:
            stack[tables[-1]].signs |= {"layout"}
        if tag == "table" and len(tables) >= LAYOUT_NESTING:
            stack[tables[-LAYOUT_NESTING]].signs |= {"deep"}
        if tag not in VOID and not empty:
            places[tag].append(len(stack))
            stack.append(node)

    for kind, value, attributes in tokens(html):
        if kind == "text":
            stack[-1].children.append(unescape(value))
        elif kind == "raw":
            stack[-1].children.append(unescape(value) if stack[-1].tag == "textarea" else value)
        elif kind == "empty":
            open_(value, attributes, True)
        elif kind == "start":
            if value in BREAKOUT:
                while (at := last(FOREIGN)) and at > last(INTEGRATION):
                    cut(at)
            if value in ("html", "body"):
                # They are there already; a head that was left open ends here.
                if value == "body":
                    close(("head",), frozenset())
                continue
            if value in CLOSES_P:
                close(("p",), P_SCOPE)
            if value in BLOCKS and stack[-1].tag == "head":
                cut(len(stack) - 1)
            if value in ENDS:
                close(ENDS[value], SCOPES.get(value, TABLE))
                if value in ("thead", "tbody", "tfoot"):
                    close(("tr",), TABLE)
                elif value == "tr":
                    close(("caption",), TABLE)
                elif value in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                    open_("tr", {})
            open_(value, attributes)
        elif value == "br":
            stack[-1].children.append(Node("br"))
        elif value not in ("html", "body"):
            scope = TABLE if value in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else (
                frozenset() if value == "table" or value not in BLOCKS else frozenset(("td", "th")))
            close((value,), scope)
    return root


# ---- what is shown ---------------------------------------------------------------------------------------------


def declarations(style: str) -> dict[str, tuple[bool, str]]:
    """``display`` and ``visibility`` as declared: whether important, and the value; the last important one counts."""
    found: dict[str, tuple[bool, str]] = {}
    for name, value, important in DECLARATION.findall(COMMENT.sub(" ", style)):
        entry = (bool(important), value.lower())
        if entry[0] or not found.get(name.lower(), (False, ""))[0]:
            found[name.lower()] = entry
    return found


def rules(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of a style sheet; blocks of at-rules (other media, animations) are passed over."""
    css = COMMENT.sub(" ", css)
    at = 0
    while (brace := css.find("{", at)) >= 0:
        selector = css[at:brace].rpartition(";")[2].strip()
        depth, end = 1, brace + 1
        if selector.startswith("@"):
            for mark in re.finditer("[{}]", css[end:]):
                depth += 1 if mark[0] == "{" else -1
                if not depth:
                    end += mark.end()
                    break
            else:
                return
        else:
            end = css.find("}", brace) + 1 or len(css)
            yield selector, css[brace + 1:end].rstrip("}")
        at = end


class Styles:
    """Rules on ``display`` and ``visibility`` whose selector names one element by tag, classes and ids."""

    def __init__(self, root: Node) -> None:
        self.rules: dict[str, list[tuple]] = defaultdict(list)
        sheets, left, order = [], [root], 0
        while left:
            node = left.pop()
            if node.tag == "style":
                sheets.append("".join(c for c in node.children if isinstance(c, str)))
            else:
                left.extend(c for c in reversed(node.children) if isinstance(c, Node))
        for selectors, body in (rule for sheet in sheets for rule in rules(sheet)):
            for name, (important, value) in declarations(body).items():
                for selector in selectors.split(","):
                    order += 1
                    parts = SELECTOR.fullmatch(selector.strip())
                    if not parts or not selector.strip():
                        continue
                    tag = (parts[1] or "*").lower()
                    marks = re.findall(r"[.#][\w-]+", parts[2])
                    weight = (sum(m[0] == "#" for m in marks), sum(m[0] == "." for m in marks), tag != "*")
                    key = marks[0] if marks else tag
                    self.rules[key].append((tag, frozenset(marks), name, (important, weight, order), value))

    def of(self, node: Node) -> dict[str, str]:
        """What rules and the element's own style say; its own style outweighs rules that aren't important."""
        best: dict[str, tuple] = {}
        if self.rules:
            marks = {f".{c}" for c in node.attributes.get("class", "").split()}
            if "id" in node.attributes:
                marks.add("#" + node.attributes["id"])
            for key in (*marks, node.tag, "*"):
                for tag, wanted, name, weight, value in self.rules.get(key, ()):
                    if tag in ("*", node.tag) and wanted <= marks and (name not in best or best[name][0] < weight):
                        best[name] = (weight, value)
        own = node.attributes.get("style", "")
        if own and SHOWING.search(own):
            for name, (important, value) in declarations(own).items():
                weight = (important, (float("inf"),), 0)
                if name not in best or best[name][0] < weight:
                    best[name] = (weight, value)
        return {name: value for name, (_, value) in best.items()}


def conceal(root: Node) -> None:
    """Mark elements without display, and take the text of invisible ones; visible ones inside them keep theirs."""
    styles = Styles(root)
    left = [(root, False)]
    while left:
        node, concealed = left.pop()
        said = styles.of(node)
        if said.get("display") == "none":
            node.attributes["hidden"] = ""
            continue
        if node.signs:
            concealed = (concealed or "concealed" in node.signs) and "shown" not in node.signs
        seen = said.get("visibility", "inherit")
        if seen in ("hidden", "collapse"):
            concealed = True
            if seen == "collapse" and node.tag in ("tr", "thead", "tbody", "tfoot"):
                node.attributes["hidden"] = ""
        elif seen in ("visible", "initial"):
            concealed = False
        if concealed:
            node.children = [c for c in node.children if isinstance(c, Node) and c.tag != "br"]
            if node.tag == "input":
                node.attributes["hidden"] = ""
        left.extend((c, concealed) for c in node.children if isinstance(c, Node))


# ---- layout ----------------------------------------------------------------------------------------------------


def visible(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attributes:
        return False
    if node.tag == "dialog" and "open" not in node.attributes:
        return False
    if node.tag == "input":
        return node.attributes.get("type", "").lower() in ("submit", "button", "reset")
    return True


@dataclass(slots=True)
class Part:
    """A stretch of lines laid out for itself: what its first line begins with, and how far the others are indented."""

    mark: str = ""
    indent: str = ""
    started: bool = False
    #: Whether an empty line was due where it stands.
    blank_before: bool = False


class Flow:
    """Lines of text so far, the line being written, and whether an empty line stands before the next one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.current: list[str] = []
        self.blank_due = False
        self.space_due = False
        self.parts = [Part()]

    def text(self, value: str) -> None:
        words = BLANKS.sub(" ", value)
        if self.current and (self.space_due or words[:1] == " "):
            self.space_due = True
        core = words.strip(" ")
        if core:
            if self.space_due:
                self.current.append(" ")
            self.current.append(core)
            self.space_due = words[-1:] == " "

    def end_line(self) -> None:
        if self.current:
            self.put(["".join(self.current)])
        self.current, self.space_due = [], False

    def put(self, lines: list[str]) -> None:
        if not lines:
            return
        # Parts that have no line yet are the last ones; their marks stand before this line.
        first = len(self.parts)
        while first and not self.parts[first - 1].started:
            first -= 1
        fresh = self.parts[first:]
        if first and (fresh[0].blank_before if fresh else self.blank_due):
            self.lines.append("")
        begin = (self.parts[first - 1].indent if first else "") + "".join(part.mark for part in fresh)
        for part in fresh:
            part.started = True
        self.blank_due = False
        indent = self.parts[-1].indent
        if not fresh:
            begin = indent if lines[0] else ""
        self.lines.append(begin + lines[0])
        self.lines.extend(indent + line if line else "" for line in lines[1:])

    def gap(self) -> None:
        self.end_line()
        self.blank_due = True

    def enter(self, mark: str = "") -> None:
        """Begin a part; the line before it has ended."""
        indent = (self.parts[-1].indent + " " * len(mark))[:MAX_INDENT]
        self.parts.append(Part(mark, indent, False, self.blank_due))
        self.blank_due = False

    def leave(self) -> None:
        self.end_line()
        part = self.parts.pop()
        self.blank_due = part.blank_before and not part.started

    def line_break(self) -> None:
        if self.current:
            self.end_line()
        elif self.parts[-1].started and self.lines[-1]:
            self.put([""])

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _first_number(parent: Node) -> int:
    start = parent.attributes.get("start", "").strip() if parent.tag == "ol" else ""
    return int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1


def laid_out(children: list, parent: Node) -> list[str]:
    flow = Flow()
    # Elements that have been begun: what is left of them, the block they stand in, its next number, and what ends them.
    begun = [(iter(children), parent, [_first_number(parent)], ())]

    def begin(node: Node, block: Node, number: list[int], *ends) -> None:
        begun.append((iter(node.children), block, number, ends))

    while begun:
        rest, parent, number, ends = begun[-1]
        depth = len(begun)
        closed = parent.tag == "details" and "open" not in parent.attributes
        for child in rest:
            if isinstance(child, str):
                if not closed:
                    flow.text(child)
                continue
            tag = child.tag
            if not visible(child) or (closed and tag != "summary"):
                continue
            if tag == "br":
                flow.line_break()
            elif tag == "input":
                flow.text(f" {child.attributes.get('value', '')} ")
            elif tag in ("pre", "xmp", "textarea"):
                flow.gap()
                lines = _plain(child).replace("\r\n", "\n").split("\n")
                while lines and not lines[0].strip():
                    lines.pop(0)
                while lines and not lines[-1].strip():
                    lines.pop()
                flow.put(lines)
                flow.gap()
            elif tag == "table":
                flow.gap()
                if _is_layout(child):
                    flow.enter()
                    begin(_stacked(child), child, [1], flow.leave, flow.gap)
                else:
                    flow.put(_table(child))
                    flow.gap()
            elif tag == PART:
                flow.enter()
                begin(child, child, [1], flow.leave)
            elif tag == "li":
                flow.end_line()
                mark = "- "
                if parent.tag == "ol":
                    value = child.attributes.get("value", "").strip()
                    if re.fullmatch(r"-?[0-9]{1,9}", value):
                        number[0] = int(value)
                    mark = f"{number[0]}. "
                    number[0] += 1
                flow.enter(mark)
                begin(child, child, [1], flow.leave)
            elif tag in ("blockquote", "dd"):
                end = flow.gap if tag == "blockquote" else flow.end_line
                end()
                flow.enter("  ")
                begin(child, child, [1], flow.leave, end)
            elif tag in ("ul", "ol", "menu", "dir"):
                end = flow.end_line if parent.tag == "li" else flow.gap
                end()
                flow.enter()
                begin(child, child, [_first_number(child)], flow.leave, end)
            elif tag in BLOCKS or "line" in child.signs:
                end = flow.gap if tag in SPACED else flow.end_line
                end()
                begin(child, child, [1], end)
            else:
                begin(child, parent, number)
            if len(begun) > depth:
                break
        else:
            begun.pop()
            for end in ends:
                end()
    return flow.done()


def _plain(node: Node) -> str:
    """Text as it stands, line ends kept."""
    parts = []
    left = node.children[::-1]
    while left:
        child = left.pop()
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append("\n")
        elif visible(child):
            left.extend(reversed(child.children))
    return "".join(parts)


#: What is laid out for itself in a layout table: no tag has this name.
PART = "#part"


def _is_layout(table: Node) -> bool:
    """Told by what the table says of itself and holds; with signs of both, it holds data."""
    if "deep" in table.signs or table.attributes.get("role", "").lower() in ("presentation", "none"):
        return True
    return "layout" in table.signs and "data" not in table.signs


def _gathered(table: Node) -> tuple[list, list[Node], list[list[Node]]]:
    """What stands outside its cells, its captions, and the cells of its rows."""
    loose: list = []
    captions: list[Node] = []
    rows: list[list[Node]] = []

    def gather(node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    loose.append(child)
            elif not visible(child):
                continue
            elif child.tag == "caption":
                captions.append(child)
            elif child.tag in ("thead", "tbody", "tfoot"):
                gather(child)
            elif child.tag == "tr":
                cells = [c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)]
                loose.extend(c for c in child.children if not (isinstance(c, Node) and c.tag in ("td", "th")))
                rows.append(cells)
            else:
                loose.append(child)

    gather(table)
    return loose, captions, rows


def _stacked(table: Node) -> Node:
    """A layout table: its parts one below the other; what stands outside its cells is shown before it."""
    loose, captions, rows = _gathered(table)
    return Node(PART, children=[Node(PART, children=loose), *[
        Node(PART, children=c.children) for c in [*captions, *[c for row in rows for c in row]]]])


def _table(table: Node) -> list[str]:
    loose, captions, rows = _gathered(table)
    # What stands in a table outside its cells is shown before it.
    above = laid_out(loose, Node("div")) + [line for c in captions for line in laid_out(c.children, c)]
    grid = _grid(rows)
    texts = [[(laid_out(c.children, c) if c else []) for c in row] for row in grid]
    return above + _aligned(texts)


def _aligned(texts: list[list[list[str]]]) -> list[str]:
    """Rows of cells, each a list of lines: the lines of a cell stand below each other in its column."""
    widths = [0] * max(map(len, texts), default=0)
    for row in texts:
        for i, cell in enumerate(row):
            widths[i] = max([widths[i], *[len(line) for line in cell if len(line) <= MAX_CELL]])
    upto = [0, *accumulate(w + 3 for w in widths)]
    padded = sum(max(map(len, row), default=0) * upto[len(row)] for row in texts)
    if padded > MAX_PADDED + PADDED_TIMES * sum(len(line) for row in texts for cell in row for line in cell):
        texts = [[[" ".join(filter(None, cell))] if cell else [] for cell in row] for row in texts]
        widths = [0] * len(widths)
    lines = []
    for row in texts:
        for k in range(max(map(len, row), default=0)):
            cells = [cell[k] if k < len(cell) else "" for cell in row]
            while cells and not cells[-1].strip():
                cells.pop()
            line = " | ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip(" ")
            if line or (k and len(row) == 1):  # an empty line would part a row of several cells
                lines.append(line)
    return lines


def _grid(rows: list[list[Node]]) -> list[list[Node | None]]:
    """Cells in their columns; columns a cell spans are empty but for its first."""
    grid: list[list[Node | None]] = []
    taken: dict[int, int] = {}
    for row in rows:
        line: list[Node | None] = []
        below: dict[int, int] = {i: left - 1 for i, left in taken.items() if left > 1}
        for cell in row:
            while len(line) in taken:
                line.append(None)
            wide = min(_span(cell, "colspan"), MAX_COLSPAN)
            high = _span(cell, "rowspan")
            for i in range(len(line), len(line) + wide):
                if high > 1:
                    below[i] = high - 1
            line.extend([cell, *[None] * (wide - 1)])
        grid.append(line)
        taken = below
    return grid


def _span(cell: Node, name: str) -> int:
    value = cell.attributes.get(name, "").strip()
    return max(1, int(value)) if re.fullmatch(r"[0-9]{1,5}", value) else 1


def visible_text(html: str | None) -> str:
    root = tree(html or "")
    if html and SHOWING.search(html):
        conceal(root)
    return "\n".join(line.rstrip() for line in laid_out(root.children, root)).strip("\n")


def extracted(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the visible text of each page in ``text``.

    Null and empty pages have an empty text. Rows keep all columns but a former one of that name, whatever their
    ids; an empty table gives no rows. Nothing is shuffled. Of style sheets, the page's own rules on ``display`` and
    ``visibility`` count whose selector is one element's name, classes and ids, without combinators or at-rules.
    """
    @F.arrow_udf("string")
    def render(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([visible_text(page.as_py()) for page in batch], pa.string())

    return pages.withColumn(text, render(F.col(html)))
