"""HTML to text by layout: a tree with implied tags, visibility rules, and block layout.

A page is read into a tree as browsers do: void elements, raw text elements, optional end tags, end
tags without a start; a head ends where something stands that may not be in it, cells get the row they lack, and what
stands in a table outside its cells comes before the table. Everything that would be shown is emitted, nothing is judged by content:
navigation and footers stay, and so do texts of drawings and formulas. Not shown are head, script, style, template, noscript and the like, the
hidden attribute, display:none, visibility:hidden (a descendant may be visible again), hidden
inputs, and closed details and dialogs. Blocks stand on lines of their own, paragraph-like ones between
blank lines; list items get a bullet or number and an indent; cells of a table are aligned in columns
of up to ALIGN characters, and those of several lines stand one below the other where their lines are longer; white space collapses outside pre, textarea and what a style attribute keeps; character references are decoded. Rules of style
elements and files are not applied.

Defined results: null gives an empty text; broken markup never fails; text without tags is one block; an
empty table gives an empty result. Time and memory are in proportion to the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.llm.common import type_of, unused

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist area title desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
#: Elements of drawings whose own text isn't drawn; that of text elements in them is.
SHAPES = frozenset("svg g path rect circle ellipse line polyline polygon use image switch".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset".split())
#: Types of inputs that show no text of their value.
SILENT = frozenset("hidden checkbox radio file image range color password".split())
BLOCKS = PARAGRAPHS | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main menu nav optgroup option search section summary caption tr thead tbody tfoot xmp".split())
#: A start tag ends the open elements named here, looking no further up than the scope.
CLOSES = {
    **{t: (("p",), ("table", "td", "th", "button")) for t in PARAGRAPHS | frozenset("address article aside center details dialog dir div figcaption footer form header hgroup main menu nav search section summary".split())},
    "li": (("li", "p"), ("ul", "ol", "menu", "table", "td", "th")),
    "dt": (("dt", "dd", "p"), ("dl", "table", "td", "th")),
    "dd": (("dt", "dd", "p"), ("dl", "table", "td", "th")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "caption", "colgroup"), ("table",)),
    **{t: (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)) for t in ("thead", "tbody", "tfoot")},
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("optgroup", "option"), ("select",)),
    **{t: (("rt", "rp"), ("ruby",)) for t in ("rt", "rp")},
    "body": (("head",), ("table",)),
}
#: What may stand in a head; any other start tag, and text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
SECTIONS = ("thead", "tbody", "tfoot")
#: Parts of a table: their start tags end what is open in it. In those of TABLE nothing else may stand.
PARTS = frozenset((*SECTIONS, "caption", "colgroup", "col", "tr", "td", "th"))
TABLE = frozenset(("table", *SECTIONS, "colgroup", "tr"))
#: Elements open at once, but for a table's parts; what opens below that depth is laid beside instead of inside, as browsers do.
MAX_DEPTH = 512
#: Columns up to this width are padded; beyond it padding would cost more than the text.
ALIGN = 40
#: Lines of cells stand side by side if that takes so many times the characters of the row at most.
PADDING = 8

_name = re.compile(r"[a-zA-Z][^\s/>]*")
_rest = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_attribute = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Attributes that count without a value.
_flag = re.compile("hidden|open|reversed", re.I)
_space = re.compile(r"[ \t\n\r\f]+")
_spaces = re.compile(r"(?i)white-space\s*:\s*([a-z-]+)")
_comment_end = re.compile("--!?>")
_hides = re.compile(r"display\s*:\s*none", re.I)
_veils = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _attribute.findall(source):
        found.setdefault(name.lower(), entities.unescape(value[1:-1] if value[:1] in ('"', "'") else value))
    return found


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root", {})
    stack = [root]
    at, size = 0, len(page)
    quotes_end = True  # quotes were closed so far; once one isn't, tags end at the next >

    def add(node: Node | str) -> None:
        outside = stack[-1].tag in TABLE and (not blank(node) if isinstance(node, str) else node.tag not in PARTS)
        if outside and (table := nearest(("table",))):
            above = stack[table - 1].children
            above.insert(len(above) - 1, node)  # the open table is the last of its parent
        else:
            stack[-1].children.append(node)

    def add_text(text: str) -> None:
        if text:
            if "&" in text:
                text = entities.unescape(text)
            if stack[-1].tag == "head" and not blank(text):
                stack.pop()
            add(text)

    def blank(text: str) -> bool:
        return not text.strip(" \t\n\r\f")

    def nearest(tags: tuple[str, ...]) -> int:
        """Place in the stack of the innermost open element of tags; 0 if there is none."""
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in tags), 0)

    def open_part(tag: str, table: int) -> None:
        """Ends what a part of a table can't stand in, and opens the row that a cell lacks."""
        keep = table + 1
        if tag in ("tr", "td", "th") and keep < len(stack) and stack[keep].tag in SECTIONS:
            keep += 1
        row = keep < len(stack) and stack[keep].tag == "tr"
        if tag in ("td", "th") and row:
            keep += 1
        del stack[keep:]
        if tag in ("td", "th") and not row:
            stack[-1].children.append(Node("tr", {}))
            stack.append(stack[-1].children[-1])

    def close_until(tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                if tags[0] in ("p", "td", "option"):
                    return
                return close_until(tags, scope)
            if stack[i].tag in scope:
                return

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add_text(page[at:])
            break
        after = page[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            add_text(page[at:lt])
            comment = page.startswith("<!--", lt)
            if comment:
                done = _comment_end.search(page, lt + 2)  # <!--> is a whole comment
                if done and done[0] == "--!>" and done.start() < lt + 4:
                    done = _comment_end.search(page, lt + 4)
                at = done.end() if done else size
            else:
                end = page.find(">", lt + 2)
                at = size if end < 0 else end + 1
            continue
        closing = after == "/"
        named = _name.match(page, lt + 1 + closing)
        if not named:
            if closing and (end := page.find(">", lt)) >= 0:  # a bogus end tag is a comment
                add_text(page[at:lt])
                at = end + 1
            else:
                add_text(page[at : lt + 1])
                at = lt + 1
            continue
        add_text(page[at:lt])
        tag = named[0].lower()
        whole = _rest.match(page, named.end()) if quotes_end else None
        if whole is None:
            quotes_end = False
            gt = page.find(">", named.end())
            if gt < 0:
                break  # an unended tag at the end is dropped, as browsers do
            end = gt + 1
        else:
            end = whole.end()
        at = end
        if closing:
            if tag == "br":
                if stack[-1].tag == "head":
                    stack.pop()
                add(Node("br", {}))
            elif tag == "p" and not any(n.tag == "p" for n in stack):
                add(Node("p", {}))
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "body", "html"):
                        break
            continue
        inside = page[named.end() : end - 1]
        if tag == "html" and len(stack) > 1 or tag == "head" and stack[-1].tag not in ("#root", "html"):
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        table = nearest(("table",)) if tag in PARTS else 0
        if table:
            open_part(tag, table)
        elif tag == "table" and (outer := nearest(("table", "td", "th", "caption"))) and stack[outer].tag == "table":
            del stack[outer:]  # a table straight in a table ends it
        elif tag in CLOSES:
            close_until(*CLOSES[tag])
        node = Node(tag, attributes_of(inside) if "=" in inside or _flag.search(inside) else {})
        alone = tag == "form" and stack[-1].tag in TABLE  # is empty, and cells stand beside it
        add(node)
        if tag in VOID or alone:
            continue
        if tag in RAW:
            lower_end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            text = page[at : lower_end.start() if lower_end else size]
            if tag in ("textarea", "title"):
                text = entities.unescape(text)
            node.children.append(text)
            gt = page.find(">", lower_end.end()) if lower_end else -1
            at = gt + 1 if gt >= 0 else size
            continue
        if tag == "plaintext":
            node.children.append(page[at:])
            break
        if len(stack) < MAX_DEPTH or table:
            stack.append(node)
    return root


class Flow:
    """Lines of text under construction: collapsed white space, line breaks and margins."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.margin = 0  # line ends owed before the next text
        self.space = False  # a collapsed space is owed
        self.indent: list[str] = []
        self.marker = ""

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.margin = max(self.margin, gap)

    def _begin(self) -> None:
        if not self.line:
            if self.lines and self.margin > 1 and self.lines[-1] != "":
                self.lines.append("")
            self.margin = 0
            self.line.append("".join(self.indent[:-1] + [self.marker.ljust(len(self.indent[-1]))] if self.marker and self.indent else self.indent))
            self.marker = ""

    def text(self, data: str) -> None:
        words = _space.split(data)
        if len(words) == 1 and not words[0]:
            return
        for i, word in enumerate(words):
            if i:
                self.space = bool(self.line)
            if word:
                fresh = not self.line
                self._begin()
                if self.space and not fresh:
                    self.line.append(" ")
                self.space = False
                self.line.append(word)

    def preformatted(self, data: str) -> None:
        for i, line in enumerate(data.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.newline()
            if line:
                self._begin()
                self.line.append(line)

    def newline(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines:
            self.lines.append("")

    def done(self) -> str:
        self.end_line()
        return "\n".join(self.lines).replace("\u00a0", " ").strip("\n")


def shown(node: Node, parent: Node | None) -> bool:
    """Whether node makes boxes at all; visibility is a matter of inheritance and handled apart."""
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a or _hides.search(a.get("style", "")):
        return False
    if node.tag == "input":
        return a.get("type", "").strip().lower() not in SILENT and "value" in a
    if node.tag == "dialog" and "open" not in a:
        return False
    return not (parent is not None and parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary")


def _sees(node: Node, visible: bool) -> bool:
    """Whether text in node is visible, if it is around node or not."""
    veil = _veils.search(node.attributes.get("style", ""))
    return veil[1].lower() == "visible" if veil else visible


def _rows(table: Node, visible: bool) -> Iterator[tuple[list[Node], bool]]:
    """(cells, visible) of the rows of a table, in sections or not."""
    for child in table.children:
        if isinstance(child, str) or not shown(child, table):
            continue
        if child.tag == "tr":
            yield [c for c in child.children if not isinstance(c, str) and c.tag in ("td", "th") and shown(c, child)], _sees(child, visible)
        elif child.tag in SECTIONS:
            yield from _rows(child, _sees(child, visible))


def _number(value: str) -> int:
    """A span: 1 to 1000, 1 for anything else."""
    return max(1, min(1000, int(value))) if value.isascii() and value.isdigit() else 1


def _gridded(cells: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int]]]:
    """Rows of (text, columns, rows) as rows of (text, columns), with empty cells under those that go on from rows above.

    The empty cells are at most PADDING times the cells there are; beyond that columns may shift, no text is lost."""
    room, out = PADDING * sum(map(len, cells)), []
    below: dict[int, int] = {}  # rows in which a column is still taken
    for row in cells:
        taken, below = below, {c: n - 1 for c, n in below.items() if n > 1}
        own: list[tuple[str, int]] = []
        at = 0

        def fill(own: list, at: int, taken: dict[int, int] = taken) -> int:
            nonlocal room
            while at in taken and room > 0:
                own.append(("", 1))
                at, room = at + 1, room - 1
            return at

        for text, columns, rows in row:
            at = fill(own, at)
            own.append((text, columns))
            if rows > 1 and columns * rows <= room:
                below |= {c: rows - 1 for c in range(at, at + columns)}
            at += columns
        out.append(own)
    return out


def _table_lines(cells: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of (text, columns, rows) as lines with aligned columns."""
    parts = [[([x.rstrip() for x in text.split("\n")], span) for text, span in row] for row in _gridded(cells)]
    width: dict[int, int] = {}
    for row in parts:
        at = 0
        for own, span in row:
            if span == 1 and max(map(len, own)) <= ALIGN:
                width[at] = max(width.get(at, 0), *map(len, own))
            at += span
    lines = []
    for row in parts:
        if not any(x for own, _ in row for x in own):
            continue
        at, rooms = 0, []
        for _, span in row:
            rooms.append(sum(width.get(k, 0) for k in range(at, at + span)) + 2 * (span - 1))
            at += span
        height = max(len(own) for own, _ in row)
        longest = max(len(x) for own, _ in row for x in own)
        if height > 1 and (longest > ALIGN or height * sum(r + 2 for r in rooms) > PADDING * sum(len(x) + 1 for own, _ in row for x in own)):
            lines += [x for own, _ in row if any(own) for x in own]
        else:
            lines += ["  ".join((own[k] if k < len(own) else "").ljust(room) for (own, _), room in zip(row, rooms, strict=True)).rstrip() for k in range(height)]
    return lines


def render(root: Node) -> str:
    """The visible text of a tree. Walks with a stack of its own: no depth is too deep."""
    out = Flow()
    flows: list[Flow] = [out]
    # entries: (kind, node, parent, visible, preformatted)
    work: list[tuple] = [("open", root, None, True, False)]
    counters: list[list] = []  # of open lists: [ordered, next number]
    tables: list[list[list[tuple[str, int, int]]]] = []
    while work:
        kind, node, parent, visible, pre = work.pop()
        flow = flows[-1]
        if kind == "text":
            if visible and not (parent is not None and (parent.tag == "details" and "open" not in parent.attributes or parent.tag in SHAPES)):
                flow.preformatted(node) if pre else flow.text(node)
            continue
        if kind == "close":
            if node.tag in ("ul", "ol", "menu", "dir"):
                counters.pop()
                if flow.indent:
                    flow.indent.pop()
            elif node.tag in ("dd", "blockquote"):
                flow.indent.pop()
            elif node.tag == "li":
                flow.marker = ""
            flow.block(2 if node.tag in PARAGRAPHS and not (node.tag in ("ul", "ol") and counters) else 1)
            continue
        if kind == "row":
            tables[-1].append([])
            continue
        if kind == "cell":
            flows.append(Flow())
            continue
        if kind == "cell end":
            tables[-1][-1].append((flows.pop().done(), *(_number(node.attributes.get(k, "1").strip()) for k in ("colspan", "rowspan"))))
            continue
        if kind == "table end":
            for line in _table_lines(tables.pop()):
                flow.block(1)
                flow._begin()
                flow.line.append(line)
            flow.block(2)
            continue
        if parent is not None and not shown(node, parent):
            continue
        visible, tag = _sees(node, visible), node.tag
        if tag == "br":
            flow.newline() if visible else None
            continue
        if tag == "input":
            flow.text(node.attributes["value"]) if visible else None
            continue
        if tag == "table":
            flow.block(2)
            tables.append([])
            steps: list[tuple] = []
            for child in node.children:  # captions, and what stands in a table against the rules, come before it
                if not isinstance(child, str) and child.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col"):
                    steps.append(("open", child, node, visible, pre))
                elif isinstance(child, str) and child.strip():
                    steps.append(("text", child, node, visible, pre))
            for row, seen in _rows(node, visible):
                steps.append(("row", None, None, seen, pre))
                for cell in row:
                    steps += [("cell", cell, None, seen, pre), ("open", cell, None, seen, pre), ("cell end", cell, None, seen, pre)]
            work.append(("table end", node, None, visible, pre))
            work += reversed(steps)
            continue
        if tag in BLOCKS:
            if tag in ("ul", "ol", "menu", "dir"):
                flow.block(1 if counters else 2)
                start, down = node.attributes.get("start", ""), "reversed" in node.attributes
                first = sum(not isinstance(c, str) and c.tag == "li" for c in node.children) if down else 1
                counters.append([tag == "ol", int(start) if start.lstrip("-").isascii() and start.lstrip("-").isdigit() else first, -1 if down else 1])
                flow.indent.append("   " if tag == "ol" else "  ")
            else:
                flow.block(2 if tag in PARAGRAPHS else 1)
            if tag == "li" and counters:
                value = node.attributes.get("value", "")
                if counters[-1][0]:
                    if value.isascii() and value.isdigit():
                        counters[-1][1] = int(value)
                    flow.marker = f"{counters[-1][1]}. "
                    counters[-1][1] += counters[-1][2]
                else:
                    flow.marker = "- "
            elif tag in ("dd", "blockquote"):
                flow.indent.append("  ")
            work.append(("close", node, None, visible, pre))
        spaces = _spaces.search(node.attributes.get("style", ""))
        pre = spaces[1].lower() in ("pre", "pre-wrap", "break-spaces") if spaces else pre or tag in ("pre", "textarea", "xmp", "plaintext")
        work += [("text", c, node, visible, pre) if isinstance(c, str) else ("open", c, node, visible, pre) for c in reversed(node.children)]
    return out.done()


def visible_text(page: str | None) -> str:
    return render(parse(page or ""))


def rendered(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """df with out_col, the visible text of html_col (a column of that name is replaced)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([visible_text(x.as_py()) for x in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], names=[*b.schema.names[:-1], out_col])

    rest = df.drop(out_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{out_col}` string"])
    page = F.col(html_col).cast("string").alias(unused(df, "__page"))
    return df.select(*[F.col(f"`{c}`") for c in rest.columns], page).mapInArrow(run, schema)


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_lines, n_chars of every page."""
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return rendered(slim).select("page_id", "text", (F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")).alias("n_lines"), F.length("text").cast("long").alias("n_chars"))
