"""HTML, SVG and Markdown on columns. Markup has no expression on the JVM: Arrow-batched helpers, one text at a time."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Generator, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li tr blockquote pre".split())
#: A start tag ends an open element of these names.
ENDS = {"li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}} | {t: {"p"} for t in "p div h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table section article".split()}
DROPPED = frozenset("script iframe object embed form".split())
DROPPED_SVG = frozenset("script foreignobject iframe object embed".split())


class Node(list):
    """An element: its children, and tag and attributes."""

    def __init__(self, tag: str, attributes: list[tuple[str, str | None]]):
        super().__init__()
        self.tag, self.attributes = tag, attributes


class Tree(HTMLParser):
    """The elements of a page, head and body together, nested as deep as they are."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", [])
        self.open = [self.root]
        self.named: Counter[str] = Counter()  # of the open ones, so that an end tag without a start isn't looked for
        self.feed(source)
        self.close()

    def _end(self) -> str:
        tag = self.open.pop().tag
        self.named[tag] -= 1
        return tag

    def handle_starttag(self, tag, attrs):
        if tag in ENDS and self.open[-1].tag in ENDS[tag]:
            self._end()
        node = Node(tag, attrs)
        self.open[-1].append(node)
        if tag not in VOID:
            self.open.append(node)
            self.named[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and tag not in VOID and tag not in BLOCKS:
            self._end()

    def handle_endtag(self, tag):
        while self.named[tag] and self._end() != tag:
            pass

    def handle_data(self, data):
        self.open[-1].append(data)


def _deep(step: Generator):
    """The value of a generator that yields generators for the values it needs: recursion of any depth, without the interpreter's stack."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def body_of(source: str) -> Node:
    """The children of the body; without one, of the page without its head."""

    def find(node: Node | None, tag: str) -> Node | None:
        while node is not None and node.tag != tag:
            node = next((c for c in node if isinstance(c, Node) and c.tag in (tag, "html")), None)
        return node

    root = Tree(source).root
    if (body := find(root, "body")) is not None:
        return body
    out = Node("", [])
    for child in root:
        inner = child if isinstance(child, Node) and child.tag == "html" else [child]
        out += [x for x in inner if not (isinstance(x, Node) and x.tag in ("head", "title", "meta", "link", "style", "base"))]
    return out


def _safe(attributes: list[tuple[str, str | None]]) -> list[tuple[str, str | None]]:
    return [(k, v) for k, v in attributes if not k.lower().startswith("on") and "javascript:" not in (v or "").lower()]


def _is_dropped(node: Node) -> bool:
    names = {k for k, _ in node.attributes}
    return node.tag in DROPPED or (node.tag == "meta" and "http-equiv" in names) or (node.tag == "link" and ("rel", "import") in node.attributes)


def serialised(node: Node) -> str:
    return _deep(_serialised(node))


def _serialised(node: Node) -> Generator:
    out = []
    for child in node:
        if isinstance(child, str):
            out.append(child if node.tag in ("script", "style") else html.escape(child, quote=False).replace("\xa0", "&nbsp;"))
            continue
        tags = "".join(f' {k}="{html.escape(v or "").replace("&#x27;", chr(39)).replace("&lt;", "<").replace("&gt;", ">")}"' for k, v in child.attributes)
        out.append(f"<{child.tag}{tags}>" + ("" if child.tag in VOID else f"{(yield _serialised(child))}</{child.tag}>"))
    return "".join(out)


def sanitise(source: str) -> str:
    """The body without active elements and attributes."""

    def clean(node: Node) -> Generator:
        out = Node(node.tag, _safe(node.attributes))
        for c in node:
            if isinstance(c, str) or not _is_dropped(c):
                out.append(c if isinstance(c, str) else (yield clean(c)))
        return out

    return serialised(_deep(clean(body_of(source))))


def sanitise_svg(source: str) -> str:
    """SVG without scripts, foreign content, event attributes and links to elsewhere."""

    def clean(node: Node) -> Generator:
        out = Node(node.tag, [(k, v) for k, v in _safe(node.attributes) if not (k in ("href", "xlink:href") and not (v or "").startswith(("#", "data:")))])
        for c in node:
            if isinstance(c, str) or c.tag not in DROPPED_SVG:
                out.append(c if isinstance(c, str) else (yield clean(c)))
        return out

    return serialised(_deep(clean(Tree(source).root)))


def plain(source: str) -> str:
    """Text of the body: line ends for br and after blocks, no trailing blanks, no more than one blank line."""

    def text(node: Node) -> Generator:
        out = []
        for c in node:
            out.append(c if isinstance(c, str) else "\n" if c.tag == "br" else (yield text(c)))
        return "".join(out) + ("\n" if node.tag in BLOCKS else "")

    found = _deep(text(body_of(source))).replace("\xa0", " ")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", found)).strip()


_ESCAPED = re.compile(r"([\\*_`\[\]])|^(#{1,6} |[-+>] |\d+(?=\. ))", re.M)


def to_markdown(source: str) -> str:
    """Markdown of the body: # headings, - bullets, fenced code, [text](link), ![alt](image), **, _, `, > and ---."""

    def inline(node: Node, raw: bool) -> Generator:
        out = []
        for c in node:
            out.append((c if raw else _ESCAPED.sub(lambda m: "\\" + m[0], re.sub(r"\s+", " ", c))) if isinstance(c, str) else (yield element(c, raw)))
        return "".join(out)

    def wrapped(mark: str, text: str) -> str:
        bare = text.strip()
        return text if not bare else text[: len(text) - len(text.lstrip())] + mark + bare + mark + text[len(text.rstrip()) :]

    def element(node: Node, raw: bool) -> Generator:
        tag, attr = node.tag, dict(node.attributes)
        if tag in ("script", "style", "title", "head"):
            return ""
        if tag == "br":
            return "  \n"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag == "img":
            return f"![{attr.get('alt') or ''}]({attr['src']})" if attr.get("src") else ""
        if tag == "pre":
            inner = (yield inline(node, True)).strip("\n")
            fence = "`" * max(3, 1 + max((len(m) for m in re.findall("`+", inner)), default=0))
            return f"\n\n{fence}\n{inner}\n{fence}\n\n"
        if tag == "code":
            inner = (yield inline(node, True)).replace("\n", " ")
            mark = "`" * (1 + max((len(m) for m in re.findall("`+", inner)), default=0))
            return f"{mark}{inner}{mark}" if inner else ""
        if tag in ("ul", "ol"):
            items, n = [], int(attr.get("start") or 1) if (attr.get("start") or "1").isdigit() else 1
            for item in (c for c in node if isinstance(c, Node)):
                mark = "-   " if tag == "ul" else f"{n}.  "
                items.append(mark + re.sub(r"\n(?=.)", "\n    ", re.sub(r"\n{3,}", "\n\n", (yield inline(item, raw))).strip()))
                n += 1
            nested = "\n" + "\n".join(items) + "\n"
            return nested if raw else "\n" + nested + "\n"
        text = yield inline(node, raw)
        if tag in ("b", "strong"):
            return wrapped("**", text)
        if tag in ("i", "em"):
            return wrapped("_", text)
        if tag == "a" and attr.get("href"):
            return f"[{text.strip()}]({attr['href']})"
        if re.fullmatch("h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {text.strip()}\n\n"
        if tag == "blockquote":
            return "\n\n" + re.sub("^", "> ", re.sub(r"\n{3,}", "\n\n", text).strip(), flags=re.M) + "\n\n"
        return f"\n\n{text.strip()}\n\n" if tag in BLOCKS or tag in ("section", "article", "table", "nav", "footer", "header", "main", "tr", "td", "th", "caption") else text

    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n(?!\S)", "\n", _deep(inline(body_of(source), False)))).strip()


#: Runs of marks: (mark, element), longer marks first.
_MARKS = {"**": "strong", "__": "strong", "~~": "del", "*": "em", "_": "em"}


def _emphasised(text: str) -> str:
    """text with its runs of marks paired in one pass: a run may open before a word and close behind one; _ not inside a word.

    The marks that wait for their end are kept by kind, so time is in proportion to the text."""
    parts = re.split(r"(\*+|_+|~~)", text)
    waiting: dict[str, list[tuple[int, int]]] = {mark: [] for mark in _MARKS}  # (part, place in order)
    made: dict[int, list[str]] = {}
    order = 0
    for i in range(1, len(parts), 2):
        run, before, after = parts[i], parts[i - 1][-1:], parts[i + 1][:1]
        opens, closes = bool(after.strip()), bool(before.strip())
        if run[0] == "_":
            opens, closes = opens and not before.isalnum(), closes and not after.isalnum()
        out: list[str] = []
        while run:
            fitting = [m for m in _MARKS if run.startswith(m)] or [run[0]]
            ends = [m for m in fitting if closes and waiting.get(m)]
            mark = max(ends, key=lambda m: waiting[m][-1][1]) if ends else fitting[0]  # what was opened last is closed first
            if ends:
                element = _MARKS[mark]
                at, since = waiting[mark].pop()
                made[at][made[at].index(mark)] = f"<{element}>"
                out.append(f"</{element}>")
                for others in waiting.values():  # what was opened in between stays as it is
                    while others and others[-1][1] > since:
                        others.pop()
            else:
                out.append(mark)
                if opens:
                    order += 1
                    waiting[mark].append((i, order))
            run = run[len(mark) :]
        made[i] = out
    return "".join("".join(made[i]) if i in made else part for i, part in enumerate(parts))


#: Quotes and lists in each other beyond so many levels are read as paragraphs.
_LEVELS = 40


def from_markdown(source: str, level: int = 0) -> str:
    """HTML of the usual Markdown with GFM tables, strikes and task boxes; raw HTML passes."""

    def spans(text: str) -> str:
        kept: list[str] = []

        def keep(made: str) -> str:
            kept.append(made)
            return f"\0{len(kept) - 1}\0"

        text = re.sub(r"(`+)(.+?)\1(?!`)", lambda m: keep(f"<code>{html.escape(m[2].strip(), False)}</code>"), text)
        text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(html.escape(m[1], False)), text)
        text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", lambda m: keep(f'<img src="{html.escape(m[2])}" alt="{html.escape(m[1])}">'), text)
        text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", lambda m: keep(f'<a href="{html.escape(m[2])}">') + m[1] + keep("</a>"), text)
        text = re.sub(r"</?[a-zA-Z][^>]*>", lambda m: keep(m[0]), text)
        text = re.sub(r"&(?!#?\w+;)", "&amp;", text).replace("<", "&lt;").replace(">", "&gt;")
        text = _emphasised(text)
        text = re.sub(r" {2,}\n", "<br>\n", text)
        while "\0" in text:
            text = re.sub(r"\0(\d+)\0", lambda m: kept[int(m[1])], text)
        return text

    out, lines, i = [], source.replace("\0", "�").replace("\r\n", "\n").split("\n"), 0
    starts = re.compile(r"\s*(#{1,6}\s|```|~~~|>|[-*+]\s|\d+[.)]\s|([-*_]\s*){3,}$)")
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := re.match(r"\s{0,3}(`{3,}|~{3,})\s*(\S*)", line):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(m[1])), len(lines))
            lang = f' class="language-{html.escape(m[2])}"' if m[2] else ""
            out.append(f"<pre><code{lang}>{html.escape(chr(10).join(lines[i + 1 : end]), False)}\n</code></pre>")
            i = end + 1
        elif m := re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*$", line):
            out.append(f"<h{len(m[1])}>{spans(m[2])}</h{len(m[1])}>")
            i += 1
        elif re.match(r"\s{0,3}([-*_]\s*){3,}$", line):
            out.append("<hr>")
            i += 1
        elif level < _LEVELS and line.lstrip().startswith(">"):
            end = next((j for j in range(i, len(lines)) if not lines[j].lstrip().startswith(">")), len(lines))
            out.append(f"<blockquote>\n{from_markdown(chr(10).join(re.sub(r'^\s*> ?', '', x) for x in lines[i:end]), level + 1)}</blockquote>")
            i = end
        elif level < _LEVELS and (m := re.match(r"(\s*)([-*+]|\d+[.)])\s+", line)):
            ordered, items = m[2][0].isdigit(), []
            while i < len(lines) and (n := re.match(r"(\s*)([-*+]|\d+[.)])\s+(.*)", lines[i])) and n[2][0].isdigit() == ordered:
                width, end = len(n[1]) + 2, i + 1
                while end < len(lines) and (lines[end].startswith(" " * width) or (not lines[end].strip() and end + 1 < len(lines) and lines[end + 1].startswith(" " * width))):
                    end += 1
                more = "\n".join(x[width:] for x in lines[i + 1 : end]).strip("\n")
                first = re.sub(r"^\[([ xX])\] ", lambda b: f'<input disabled="" type="checkbox"{" checked=" + chr(34) * 2 if b[1] != " " else ""}> ', n[3])
                items.append(f"<li>{spans(first)}{chr(10) + from_markdown(more, level + 1) if more else ''}</li>")
                i = end
                while i + 1 < len(lines) and not lines[i].strip() and re.match(r"\s*([-*+]|\d+[.)])\s", lines[i + 1]):
                    i += 1
            tag = "ol" if ordered else "ul"
            out.append(f"<{tag}>\n{chr(10).join(items)}\n</{tag}>")
        elif "|" in line and i + 1 < len(lines) and re.fullmatch(r"\s*\|?(\s*:?-+:?\s*\|)*\s*:?-+:?\s*\|?\s*", lines[i + 1]):
            cells = lambda x: [spans(c.strip()) for c in re.split(r"(?<!\\)\|", x.strip().strip("|"))]
            end = next((j for j in range(i + 2, len(lines)) if "|" not in lines[j]), len(lines))
            body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in cells(x)) + "</tr>\n" for x in lines[i + 2 : end])
            out.append("<table>\n<thead>\n<tr>" + "".join(f"<th>{c}</th>" for c in cells(line)) + f"</tr>\n</thead>\n<tbody>{body}</tbody>\n</table>")
            i = end
        else:
            end = next((j for j in range(i + 1, len(lines)) if not lines[j].strip() or starts.match(lines[j])), len(lines))
            text = "\n".join(x.lstrip() for x in lines[i:end])
            out.append(text if re.match(r"<(?!a\b|b\b|i\b|em|strong|code|span|img)/?[a-zA-Z!]", text) else f"<p>{spans(text)}</p>")
            i = end
    return "\n".join(out) + ("\n" if out else "")


#: A slide is full beyond so many characters or lines of its body.
SLIDE_CHARS, SLIDE_LINES = 650, 12


def slides(text: str, title: str) -> list[dict[str, str]]:
    """Title and body of each slide: # to ### headings begin one, a full slide is followed by the next line as title."""
    done: list[dict[str, str]] = []
    head, body, size = "", [], 0

    def end() -> None:
        if head or any(body):
            done.append({"title": head, "body": "\n".join(body).strip()})

    for line in (x.rstrip() for x in text.replace("\r", "").split("\n")):
        heading = re.match(r"#{1,3}\s+(.+)", line)
        bullet = re.sub(r"^[-*]\s+", "", line)
        if heading and (head or any(body)):
            end()
            head, body, size = heading[1].strip(), [], 0
        elif line.strip() and (size + len(body) - 1 > SLIDE_CHARS or len(body) >= SLIDE_LINES):
            end()
            head, body, size = bullet.strip(), [], 0
        elif not head and line.strip():
            head = (heading[1] if heading else line).strip()
        else:
            body.append(line if bullet == line else f"• {bullet}")
            size += len(body[-1].encode("utf-16-le")) // 2
    end()
    return done or [{"title": title, "body": ""}]


#: Characters of texts after which a batch goes out, so that a task holds few texts and results besides the batch that came in.
_BATCH = 1 << 20


def _batched(f: Callable[..., object], of: pa.DataType, columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """f of the values of each row, as arrays that hold few rows each, in order."""
    for arrays in columns:
        made, size = [], 0
        for values in zip(*arrays, strict=True):
            row = [v.as_py() for v in values]
            made.append(f(*row))
            size += sum(len(x or "") for x in row)
            if size >= _BATCH:
                yield pa.array(made, of)
                made, size = [], 0
        if made or not len(arrays[0]):
            yield pa.array(made, of)


def _column(f: Callable[[str], str]) -> Callable[[Column], Column]:
    def column(x: Column) -> Column:
        @F.arrow_udf("string")
        def each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return _batched(lambda t: None if t is None else f(t), pa.string(), ((t,) for t in texts))

        return each(x)

    return column


html_to_text = _column(plain)
sanitise_html = _column(sanitise)
sanitise_svg_text = _column(sanitise_svg)
html_to_markdown = _column(to_markdown)
markdown_to_html = _column(lambda source: from_markdown(source))
unescape_html = _column(html.unescape)
SLIDE, _SLIDE = "array<struct<title:string,body:string>>", pa.list_(pa.struct([("title", pa.string()), ("body", pa.string())]))


def slides_of(text: Column, title: Column) -> Column:
    @F.arrow_udf(SLIDE)
    def each(both: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _batched(lambda t, n: slides(t or "", n or ""), _SLIDE, both)

    return each(text, title)
