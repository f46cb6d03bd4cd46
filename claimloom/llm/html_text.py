"""Layout-aware text of HTML pages.

A tree builder with implied end tags makes a tree of each page; a renderer walks it, leaves out what a browser doesn't show,
and lays the rest out as text: white space collapses as on screen, blocks start lines of their own, paragraphs and headings
stand apart by an empty line, list items get a bullet or number and are indented by nesting, and the cells of a table line up
in columns.

Hidden are: comments, head, script, style, template and other content that isn't rendered; elements with ``hidden`` or
``display:none``; closed details but for their summary; closed dialogs; the fallback of an object that names data. Visibility is
inherited by itself, so that a visible element in one of ``visibility:hidden`` is shown.

Of svg, the text elements and foreign objects are shown, of math all but annotations, the parts of fractions, scripts and
matrices apart by spaces. Text that svg draws only by ``use`` isn't.

Defined results: null or empty html gives empty text; rows are read each by itself; elements may be
nested to any depth, of which lines show at most ``INDENT`` spaces; an empty table gives an empty result; columns of the input stay, and the text
goes to a column whose name is made distinct from theirs.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from claimloom.llm.shared import fresh, slices

#: Spaces before a line that nesting makes, at most; all text is shown at any depth.
INDENT = 600

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
UNSEEN = frozenset("head script style template title iframe audio video canvas noembed noframes datalist".split())
#: What svg and math don't draw.
UNDRAWN = {
    "svg": frozenset("title desc metadata style script defs symbol clippath mask marker pattern filter lineargradient radialgradient".split()),
    "math": frozenset("annotation annotation-xml style script".split()),
}
FOREIGN = frozenset(("svg", "math"))
#: Elements of svg and math with HTML in them, and HTML tags that end svg and math elsewhere.
INTEGRATION = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Elements of math whose children stand beside or above each other.
LAYOUTS = frozenset("mfrac mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr mlabeledtr mtd".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu dir".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main nav option optgroup search section summary tr caption thead tbody tfoot".split()
)
#: What a start tag ends, and where the search for it stops.
CLOSES = (
    {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"})}
    | dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"}))
    | dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"}))
    | {"tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"})}
    | dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}))
    | {"body": ({"head"}, set())}
)
#: Content that can't lie in a head ends it.
HEAD_TAGS = frozenset("base link meta noscript script style template title head html".split())
SCOPES = frozenset("table td th caption button object template html".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<(?P<close>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<loose>/?[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.S)
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!|;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|initial|hidden|collapse|inherit|unset|revert)\s*(!\s*important)?\s*(?=;|$)", re.I)
_WHITE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(text)} if text.strip(" /\n\t") else {}


def build(source: str) -> Node:
    """The tree of a page; text is kept as it is written, entities decoded."""
    root = Node("#root", {})
    stack, places = [root], {}  # open elements, and where in the stack those of each tag are

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags, stop) -> None:
        while (i := last(tags)) and i >= last(stop):
            cut(i)

    def foreign() -> bool:
        return (i := last(FOREIGN)) > 0 and i > last(INTEGRATION)

    def open_(tag: str, attrs: dict[str, str], empty: bool = False) -> None:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag not in VOID and not empty:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)

    def text(data: str) -> None:
        if data:
            if data.strip() and stack[-1].tag == "head":
                cut(len(stack) - 1)
            stack[-1].children.append(entities.unescape(data) if "&" in data else data)

    at = 0
    while at < len(source):
        found = _TOKEN.search(source, at)
        if not found:
            text(source[at:])
            break
        text(source[at : found.start()])
        at = found.end()
        if source.startswith("<![CDATA[", found.start()) and foreign():
            end = source.find("]]>", found.start())
            stack[-1].children.append(source[found.start() + 9 : end if end >= 0 else len(source)])
            at = end + 3 if end >= 0 else len(source)
            continue
        tag = found["tag"] or (found["loose"] or "").lstrip("/")
        if not tag:
            continue
        tag = tag.lower()
        if found["close"] or (found["loose"] or "").startswith("/"):
            if tag == "br":
                open_("br", {})
            elif tag == "p" and not places.get("p"):
                open_("p", {}, True)
            elif tag not in ("body", "html"):
                stop = SCOPES - {tag} if tag not in ("tr", "tbody", "thead", "tfoot", "table") else {"table"} - {tag}
                if (i := last((tag,))) and i >= last(stop):
                    cut(i)
            continue
        attrs = attributes(found["attrs"] or "")
        if tag in ("html", "body") and places.get(tag):
            continue
        if stack[-1].tag == "head" and tag not in HEAD_TAGS:
            cut(len(stack) - 1)
        while tag in BREAKOUT and foreign():
            cut(last(FOREIGN))
        if foreign() or tag in FOREIGN:
            written = found["attrs"] or ""
            empty = written.endswith("/") and not re.search(r"=[^\s\"'=]+/\Z", written)
            open_(tag, attrs, empty)
            if empty or tag not in RAW and tag not in ESCAPABLE:
                continue
        elif tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            open_("tr", {})
        if tag in BLOCKS and tag not in ("li", "dt", "dd", "option") and places.get("p") and last(("p",)) >= max(last(SCOPES), last(BLOCKS)):
            cut(last(("p",)))
        if stack[-1].attrs is not attrs:
            open_(tag, attrs)
        if tag in RAW or tag in ESCAPABLE:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            inner = source[at : end.start() if end else len(source)]
            if stack[-1].tag == tag:
                stack[-1].children.append(entities.unescape(inner) if tag in ESCAPABLE else inner)
                cut(len(stack) - 1)
            at = (source.find(">", end.start()) + 1 or len(source)) if end else len(source)
    return root


def visibility(node: Node, mode: str = "") -> str:
    """The element's own value, that of its style before that of its attribute in svg; else empty."""
    found = _VISIBILITY.findall(node.attrs.get("style", ""))
    if found:
        return ([x for x in found if x[1]] or found)[-1][0].lower()
    return node.attrs.get("visibility", "").lower() if mode[:3] == "svg" else "hidden" if mode == "math" and node.tag == "mphantom" else ""


def visible(node: Node, shown: bool, mode: str = "") -> bool:
    """Whether the element's text is seen, within one whose text is or isn't."""
    value = visibility(node, mode)
    return True if value in ("visible", "initial") else False if value in ("hidden", "collapse") else shown


def hidden(node: Node, mode: str = "") -> bool:
    """Not rendered, nor anything in it."""
    if node.tag in UNSEEN or node.tag in UNDRAWN.get(mode[:3] if mode[:3] == "svg" else mode, ()):
        return True
    attrs = node.attrs
    if not attrs:
        return node.tag == "dialog"
    return (
        ("hidden" in attrs and attrs["hidden"].lower() != "until-found")
        or ("style" in attrs and bool(_HIDING.search(attrs["style"])))
        or (node.tag == "input")
        or (node.tag == "dialog" and "open" not in attrs)
        or (node.tag == "object" and "data" in attrs)
        or (mode[:3] == "svg" and attrs.get("display") == "none")
        or (node.tag in ("tr", "thead", "tbody", "tfoot") and visibility(node) == "collapse")
    )


class Page:
    """Lines under construction: text flows into the last one; ``gap`` is the number of line ends that are due."""

    def __init__(self):
        self.lines, self.flow, self.gap, self.space = [], [], 0, False

    def say(self, data: str) -> None:
        words = _WHITE.split(data)
        if words[0] == "" and len(words) > 1:
            self.space = True
        for i, word in enumerate(words):
            if i:
                self.space = True
            if word:
                if self.gap:
                    self._break()
                if self.space and self.flow:
                    self.flow.append(" ")
                self.flow.append(word)
                self.space = False

    def verbatim(self, data: str) -> None:
        parts = data.replace("\r\n", "\n").expandtabs(8).split("\n")
        for i, part in enumerate(parts):
            if i:
                self.end_line()
            if part:
                if self.gap:
                    self._break()
                self.flow.append(part)

    def _break(self) -> None:
        gap, self.gap = self.gap, 0
        if self.lines and gap > 1 and self.lines[-1] != "":
            self.lines.append("")

    def end_line(self) -> None:
        """A line end that the page asks for."""
        if self.gap and not self.flow:
            self._break()
        self.lines.append("".join(self.flow))
        self.flow, self.space = [], False

    def apart(self, gap: int) -> None:
        """What follows begins a line, after an empty one if ``gap`` is 2."""
        if self.flow:
            self.lines.append("".join(self.flow))
            self.flow = []
        self.space = False
        self.gap = max(self.gap, gap)

    def insert(self, lines: list[str | Block]) -> None:
        if lines:
            self.apart(1)
            self._break()
            self.lines += lines

    def done(self) -> list[str | Block]:
        self.apart(1)
        lines = [x.rstrip(" ") if isinstance(x, str) else x for x in self.lines]
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


class Block:
    """Lines that stand behind a mark, or so many spaces from the second on. There is a first line, and it isn't blank."""

    def __init__(self, mark: str, lines: list):
        self.mark, self.lines = mark, lines


def flat(lines: list[str | Block]) -> list[str]:
    """Lines as they are shown; each is put together once, however deep it lies."""
    out, marks, within = [], [], [(iter(lines), 0)]
    while within:
        rest, indent = within[-1]
        line = next(rest, None)
        if line is None:
            within.pop()
        elif isinstance(line, Block):
            marks = marks or [" " * min(indent, INDENT)]
            marks.append(line.mark)
            within.append((iter(line.lines), indent + len(line.mark)))
        elif marks:
            out.append(("".join(marks) + line).rstrip(" "))
            if len(out[-1]) > INDENT and out[-1][:INDENT].isspace():
                out[-1] = " " * INDENT + out[-1].lstrip(" ")
            marks = []
        else:
            out.append(" " * (0 if len(line) > INDENT and line[:INDENT].isspace() else min(indent, INDENT)) + line if line else "")
    return out


def _run(task):
    """The result of a generator that yields the generators it waits for; they are kept in a list, so depth has no limit."""
    waiting, value = [task], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as end:
            waiting.pop()
            value = end.value
    return value


def _inside(node: Node, shown: bool):
    page = Page()
    yield _walk(node, page, False, shown)
    return page.done()


def _walk(node: Node, page: Page, pre: bool, shown: bool, mode: str = ""):
    number = None
    if node.tag == "ol":
        start = node.attrs.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if shown and not closed and mode != "svg":
                page.say(child.strip(" \t\n\r\f")) if mode == "math" else page.verbatim(child) if pre else page.say(child)
            continue
        if hidden(child, mode) or closed and child.tag != "summary":
            continue
        tag, seen = child.tag, visible(child, shown, mode)
        if tag in FOREIGN or mode and tag != "foreignobject":
            inner = tag if tag in FOREIGN else "svg text" if mode == "svg" and tag == "text" else mode
            apart = inner != mode and tag == "text" or mode == "math" and node.tag in LAYOUTS
            block = tag == "math" and child.attrs.get("display") == "block"
            page.apart(1) if block else None
            page.space = page.space or apart
            yield _walk(child, page, pre and inner != "math", seen, inner)
            page.space = page.space or apart
            page.apart(1) if block else None
        elif tag == "foreignobject" and mode:
            page.apart(1)
            yield _walk(child, page, False, seen)
            page.apart(1)
        elif tag == "br":
            page.end_line() if seen else page.apart(1)
        elif tag == "li":
            mark = "- "
            if number is not None:
                value = child.attrs.get("value", "")
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
                mark, number = f"{number}. ", number + 1
            lines = yield _inside(child, seen)
            if seen or lines:
                page.insert([Block(mark if seen else " " * len(mark), lines or [""])])
            page.apart(1)
        elif tag in ("dd", "blockquote"):
            page.apart(1 if tag == "dd" else 2)
            lines = yield _inside(child, seen)
            page.insert([Block("  ", lines)] if lines else [])
            page.apart(1 if tag == "dd" else 2)
        elif tag == "table":
            page.apart(2)
            page.insert((yield _table(child, seen)))
            page.apart(2)
        elif tag == "hr":
            page.apart(2)
        elif tag in ("td", "th"):  # outside any table
            page.space = True
            yield _walk(child, page, pre, seen)
            page.space = True
        elif tag in ("ul", "ol", "menu", "dir") and node.tag == "li":  # a list within an item needs no empty lines
            page.apart(1)
            yield _walk(child, page, False, seen)
            page.apart(1)
        elif tag in BLOCKS:
            gap = 2 if tag in PARAGRAPHS else 1
            page.apart(gap)
            yield _walk(child, page, pre or tag == "pre", seen)
            page.apart(gap)
        else:
            yield _walk(child, page, pre or tag in ("textarea", "listing"), seen)


def _span(cell: Node, name: str) -> int:
    """As the standard has it: columns up to 1000, rows up to 65534; no rows means all that are left."""
    most = 1000 if name == "colspan" else 65534
    found = re.match(r"[ \t\n\f\r]*\+?(\d+)", cell.attrs.get(name, "1"))
    n = min(int(found[1][-9:] if len(found[1].lstrip("0")) < 9 else most), most) if found else 1
    return n or (1 if name == "colspan" else most)


def _rows(node: Node, rows: list, captions: list, shown: bool) -> None:
    """Rows of (cell, whether it is seen), and other content with the same."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                captions.append((child, shown))
        elif hidden(child):
            continue
        elif child.tag == "tr":
            seen = visible(child, shown)
            rows.append([(c, visible(c, seen)) for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and not hidden(c)])
            captions += [(c, seen) for c in child.children if (c.strip() if isinstance(c, str) else c.tag not in ("td", "th") and not hidden(c))]
        elif child.tag in ("thead", "tbody", "tfoot"):
            _rows(child, rows, captions, visible(child, shown))
        elif child.tag not in ("colgroup", "col"):
            captions.append((child, shown))


def _table(node: Node, shown: bool):
    """Caption and other content, then rows; the columns of a row line up, two spaces apart."""
    rows, loose = [], []
    _rows(node, rows, loose, shown)
    page = Page()
    holder = Node("div", {})
    for child, seen in loose:
        if seen != shown:
            within = Node("span", {"style": f"visibility:{'visible' if seen else 'hidden'}"})
            within.children.append(child)
            child = within
        holder.children.append(child)
    yield _walk(holder, page, False, shown)
    out = page.done()
    grid, taken = [], {}  # (column, columns, lines) of each cell by row; rows that a cell above still fills, by column
    for cells in rows:
        placed, column = [], 0
        for cell, seen in cells:
            while taken.get(column, 0) > 0:
                column += 1
            width, height = _span(cell, "colspan"), _span(cell, "rowspan")
            placed.append((column, width, flat((yield _inside(cell, seen)))))
            for c in range(column, column + width):
                taken[c] = height
            column += width
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        grid.append(placed)
    wide: dict[int, int] = {}
    for placed in grid:
        for column, width, lines in placed:
            if width == 1:
                wide[column] = max([wide.get(column, 0), *map(len, lines)])
    last = max((c + w for placed in grid for c, w, _ in placed), default=0)
    begins = [0]
    for c in range(last):
        begins.append(begins[-1] + (wide[c] + 2 if wide.get(c) else 0))
    for placed in grid:
        for i in range(max((len(lines) for _, _, lines in placed), default=0)):
            line = ""
            for column, _, lines in placed:
                if i < len(lines) and lines[i]:
                    line = line.ljust(begins[column])
                    if line and not line.endswith(" "):
                        line += "  "
                    line += lines[i]
            out.append(line.rstrip(" "))
    return out


def render(source: str) -> str:
    """The visible text of a page."""
    return "\n".join(flat(_run(_inside(build(source), True))))


def extract(pages: DataFrame, column: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with the text of ``column``; the name of the text's column."""
    name = fresh(pages.columns, "text")
    clean = pages.withColumn(column, F.coalesce(column, F.lit("")))
    schema = StructType([*clean.schema.fields, StructField(name, StringType())])

    def read(batches):
        for batch in slices(batches, column):
            texts = pa.array([render(x) for x in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, name])

    return clean.mapInArrow(read, schema), name
