"""Operator 10, HTML extraction: all visible text, laid out as a page would be."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object video audio canvas svg datalist annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp textarea select".split())
#: Blocks with a blank line before and after.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul".split())
#: A start tag closes open elements of the second set, up to but not beyond one of the third.
IMPLIED = {
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt", "p"}, {"dl"}),
    "dt": ({"dd", "dt", "p"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "p", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "p"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "p"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "p"}, {"table"}),
    "body": ({"head"}, set()),
}
P_CLOSERS = BLOCK - frozenset("body html caption dd dt li option optgroup tbody td tfoot th thead tr select textarea legend summary".split())
#: An end tag doesn't reach out of these.
SCOPE = frozenset("table td th caption html".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript head".split())
TOKEN = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)(?:>|\Z)|</[^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
#: Elements without a box of their own, whose end tag may come after blocks that began inside them.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: One element's part of a selector: a tag or *, then classes, ids and attributes.
COMPOUND = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\])*)", re.I)
SIMPLE = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]")
SHOWN, UNPAINTED, REMOVED = range(3)
#: Columns and rows that a cell may span at most, as browsers take it.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: A page's width: a table's column that would begin beyond it begins there.
WIDEST = 2500
CSS_PART = re.compile(r"([^{}]*)([{}])")
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Box:
    """Lines of one block container: the page, a list item, a table cell."""

    __slots__ = ("lines", "line", "gap", "tag", "number", "counts", "rows", "span")

    def __init__(self, tag: str):
        self.tag, self.lines, self.line, self.gap, self.number, self.counts, self.rows, self.span = tag, [], [], 0, None, [], [], (1, 1)

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *more = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            if first:
                self.put(first)
            for x in more:
                self.newline(True)
                if x:
                    self.put(x)
            return
        s = BLANKS.sub(" ", s)
        if s[:1] == " " and (not self.line or self.line[-1][-1:] == " "):
            s = s[1:]
        if s:
            self.put(s)

    def put(self, s: str) -> None:
        if self.gap and self.lines:
            self.lines.extend([""] * (self.gap - 1))
        self.gap = 0
        self.line.append(s)

    def newline(self, always: bool = False) -> None:
        """End the line; if it is empty and ``always``, keep it."""
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif always:
            self.lines.append("")

    def edge(self, blank: bool) -> None:
        self.newline()
        if self.lines:
            self.gap = max(self.gap, 2 if blank else 1)

    def block(self, lines: list[str], blank: bool = False) -> None:
        self.edge(blank)
        for x in lines:
            if self.gap and self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.gap = 0
            self.lines.append(x)
        self.edge(blank)

    def done(self) -> list[str]:
        self.newline()
        lines = [x.rstrip() for x in self.lines]
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def width(s: str) -> int:
    """Columns of a fixed-width font: wide characters take two, marks and format characters none."""
    return len(s) if s.isascii() else sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns, rows that it spans): each column as wide as its widest line, two spaces between columns.

    A cell stands in the first columns that no cell from a row above spans. One that spans several columns widens the last of them only by what
    it needs beyond them all; one that spans rows stands in the first. A column begins beyond those that it shares a row with; so where all that stands left of it is spanned from rows above in
    each of its rows, it needs no room for that. No column begins beyond ``WIDEST``, however large or small the table: a line has at most so many blanks before a cell, or two.
    """
    taken: dict[int, int] = {}  # column -> rows that it is still spanned for
    placed: list[list[tuple[int, int, list[str]]]] = []
    for r in rows:
        at, out, spans = 0, [], []
        for lines, columns, down in r:
            while taken.get(at):
                at += 1
            out.append((at, columns, lines))
            spans += [(at + i, down) for i in range(columns)] if down > 1 else []
            at += columns
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        taken.update((c, n - 1) for c, n in spans)
        if any(lines for _, _, lines in out):
            placed.append(out)
    if all(len(r) < 2 and not any(at for at, _, _ in r) for r in placed):
        return [x for r in placed for _, _, lines in r for x in lines]
    wide: dict[int, int] = {}
    for n in sorted({columns for r in placed for _, columns, _ in r}):
        for at, columns, lines in (x for r in placed for x in r if x[1] == n):
            need = max(map(width, lines), default=0)
            if n == 1:
                wide[at] = max(wide.get(at, 0), need)
            else:
                known = [c for c in range(at, at + columns) if c in wide]
                last = known[-1] if known else at
                wide[last] = max(wide.get(last, 0), need - sum(wide[c] + 2 for c in known if c != last))
    columns = sorted(wide)
    rank = lambda at: bisect.bisect_left(columns, at)
    beside: dict[int, set[int]] = {}  # column -> those left of it in some row, with none between
    for r in placed:
        last = None
        for at, n, _ in r:
            for c in columns[rank(at) : rank(at + n)]:
                if last is not None:
                    beside.setdefault(c, set()).add(last)
                last = c
    starts, x = {}, 0
    for c in columns:
        x = max([x, *(starts[b] + (wide[b] + 2 if wide[b] else 0) for b in beside.get(c, ()))])
        starts[c] = x
    end_of = max((starts[c] + (wide[c] + 2 if wide[c] else 0) for c in columns), default=0)
    place = lambda at: min(WIDEST, starts[columns[i]] if (i := rank(at)) < len(columns) else end_of)
    out = []
    for r in placed:
        for k in range(max((len(lines) for _, _, lines in r), default=0)):
            line, end = [], 0
            for at, _, lines in r:
                if k < len(lines) and lines[k]:
                    start = place(at)
                    gap = start - end if start >= end else 2 if line else 0
                    line.append(" " * gap + lines[k])
                    end += gap + width(lines[k])
            out.append("".join(line).rstrip())
    return out


def number(value: str | None, default: int) -> int:
    """The integer that an attribute starts with."""
    found = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return int(found[1]) if found else default


def on_screens(media: str) -> bool:
    """Whether a list of media queries holds for screens of any width."""
    return any(x.strip().lower().removeprefix("only ").strip() in ("", "all", "screen") for x in media.split(","))


def always(block: str) -> bool:
    """Whether the rules in a conditional block hold for every screen."""
    name, of = re.fullmatch(r"(@?[\w-]*)(.*)", block, re.S).groups()
    name = name.lower()
    return name == "@layer" or name == "@media" and on_screens(of) or name == "@supports" and not re.search(r"\bnot\b", of, re.I)


def declared(style: str) -> dict[str, tuple[bool, str]]:
    """display and visibility as declarations give them: (important, value), the last of equals."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value, important in DECLARATION.findall(style):
        name, now = name.lower(), (bool(important), value.lower())
        if name == "display" or now[1] in ("hidden", "collapse", "visible", "inherit"):
            if name not in out or now[0] >= out[name][0]:
                out[name] = now
    return out


class Selector:
    """A chain of compounds that are ancestors (or, after >, parents) of one another. Others, such as those with pseudo-classes or siblings, raise ``ValueError``."""

    __slots__ = ("chain", "weight")

    def __init__(self, text: str):
        self.chain, ids, classes, tags = [], 0, 0, 0
        direct = False
        for part in re.sub(r"\s*>\s*", " > ", text.strip()).split():
            if part == ">":
                if direct or not self.chain:
                    raise ValueError(text)
                direct = True
                continue
            found = COMPOUND.fullmatch(part)
            if not found or not part:
                raise ValueError(text)
            tag, more = (found[1] or "*").lower(), []
            for kind, name, attribute, *values in SIMPLE.findall(found[2]):
                more.append((kind, name.lower(), None) if kind else ("[", attribute.lower(), next((v for v in values if v), None)))
                ids, classes = ids + (kind == "#"), classes + (kind != "#")
            tags += tag != "*"
            self.chain.append((direct, tag, more))
            direct = False
        if direct or not self.chain:
            raise ValueError(text)
        self.weight = (ids, classes, tags)

    @property
    def key(self) -> str:
        """What an element must have for the last compound to fit: a class, id or tag; else *."""
        _, tag, more = self.chain[-1]
        return next((k + n for k, n, _ in more if k in ".#"), tag)

    def fits(self, path: list) -> bool:
        """Whether it selects the last of a path of elements (tag, attributes, classes)."""
        return self._from(len(self.chain) - 1, path, len(path) - 1)

    def _from(self, i: int, path: list, at: int) -> bool:
        direct, tag, more = self.chain[i]
        name, of, classes = path[at]
        if tag != "*" and tag != name:
            return False
        for kind, x, value in more:
            if not (x in classes if kind == "." else of.get("id", "").lower() == x if kind == "#" else x in of and value in (None, of[x])):
                return False
        if not i:
            return True
        above = range(at - 1, max(-1, at - 2), -1) if direct else range(at - 1, -1, -1)
        return any(self._from(i - 1, path, k) for k in above)


def attributes(rest: str) -> dict[str, str]:
    """The first value of each attribute, by its lower-case name."""
    return {k.lower(): unescape(a or b or c) for k, a, b, c in reversed(ATTRIBUTE.findall(rest))} if rest else {}


class Page:
    """Reads tags and text in order; keeps the stack of open elements as the tree's current path."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool, tuple]] = []  # tag, how it is hidden, pre, (tag, attributes, classes)
        self.boxes = [Box("page")]
        self.rules: dict[str, list[tuple]] = {}  # by the selector's key: selector, order, declarations
        self.n_rules = 0
        self.open: Counter[str] = Counter()

    @property
    def hidden(self) -> int:
        return self.stack[-1][1] if self.stack else SHOWN

    def styled(self, css: str) -> None:
        """Rules that declare display or visibility. Those in a block that doesn't hold for every screen, and selectors that ``Selector`` doesn't know, are left out."""
        open_: list[str] = []  # what stands before each open brace
        for part, brace in CSS_PART.findall(re.sub(r"/\*.*?\*/", "", css, flags=re.S)):
            if brace == "{":
                open_.append(part.rsplit(";", 1)[-1].strip())
            elif open_:
                selectors, said = open_.pop(), declared(part)
                if said and not selectors.startswith("@") and all(map(always, open_)):
                    for x in selectors.split(","):
                        try:
                            selector = Selector(x)
                        except ValueError:
                            continue
                        self.n_rules += 1
                        self.rules.setdefault(selector.key, []).append((selector, self.n_rules, said))

    def hides(self, element: tuple) -> int:
        """SHOWN, UNPAINTED (its text isn't seen, what it holds may be) or REMOVED with all it holds.

        Of what is declared for a property what is important counts, then what stands in the element's own style, then the most specific selector, then the last rule;
        without any, the hidden attribute and closed dialogs remove, and visibility is that of the element around.
        """
        tag, of, classes = element
        outer = self.hidden
        if tag in UNSEEN or outer == REMOVED:
            return REMOVED
        said: dict[str, tuple] = {}
        if self.rules:
            path = None
            for key in (tag, "*", *(f".{x}" for x in classes), *([f"#{of['id'].lower()}"] if of.get("id") else [])):
                for selector, order, what in self.rules.get(key, ()):
                    path = path or [*(x[3] for x in self.stack), element]
                    if selector.fits(path):
                        for name, (important, value) in what.items():
                            said[name] = max(said.get(name, ((False,), "")), ((important, False, selector.weight, order), value))
        for name, (important, value) in declared(of.get("style", "")).items():
            said[name] = max(said.get(name, ((False,), "")), ((important, True), value))
        if "display" in said:
            if said["display"][1] == "none":
                return REMOVED
        elif "hidden" in of and of["hidden"].lower() != "until-found" or tag == "dialog" and "open" not in of:
            return REMOVED
        seen = said["visibility"][1] if "visibility" in said else "inherit"
        return outer if seen == "inherit" else SHOWN if seen == "visible" else UNPAINTED

    def pop(self) -> None:
        tag, hidden, _, _ = self.stack.pop()
        self.open[tag] -= 1
        if hidden == REMOVED:
            return
        box = self.boxes[-1]
        if tag in ("li", "dd", "td", "th", "table", "blockquote") and box.tag == tag and len(self.boxes) > 1:
            self.boxes.pop()
            lines, outer = box.done(), self.boxes[-1]
            if tag in ("td", "th"):
                if outer.tag == "table":
                    if not outer.rows:
                        outer.rows.append([])
                    outer.rows[-1].append((lines, *box.span))
                else:
                    outer.block(lines)
            elif tag == "table":
                outer.block(lines + table_lines(box.rows), True)
            elif tag == "li":
                mark = f"{box.number}. " if box.number is not None else "- "
                outer.block([(mark if not i else " " * len(mark)) + x if x or not i else "" for i, x in enumerate(lines)])
            else:
                outer.block([f"  {x}" if x else "" for x in lines], tag == "blockquote")
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dl") and self.open["li"] + self.open["dd"] > 0
            box.edge(tag in SPACED and not nested)
            if tag == "ol" and box.counts:
                box.counts.pop()

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.pop()

    def start(self, tag: str, rest: str) -> None:
        if tag == "html" and self.stack:
            return
        if self.stack and self.stack[-1][0] == "head" and tag not in HEAD_ONLY:
            self.pop()
        ends, bounds = IMPLIED.get(tag, (None, None))
        if ends is None and tag in P_CLOSERS:
            ends, bounds = {"p"}, SCOPE
        if ends and any(self.open[t] for t in ends):
            at = None
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in bounds:
                    break
                if self.stack[i][0] in ends:
                    at = i
            if at is not None:
                self.close_to(at)
        if tag[0] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6") and self.stack and re.fullmatch("h[1-6]", self.stack[-1][0]):
            self.pop()
        if tag in ("td", "th") and self.open["table"] and not self.open["tr"]:
            self.start("tr", "")
        of = attributes(rest)
        element = (tag, of, frozenset(of["class"].lower().split()) if of.get("class") else frozenset())
        hidden = self.hides(element)
        box = self.boxes[-1]
        if tag in VOID:
            if hidden == SHOWN:
                if tag == "br":
                    box.newline(True)
                elif tag == "hr":
                    box.block(["---"])
            return
        parent_pre = bool(self.stack) and self.stack[-1][2]
        self.open[tag] += 1
        self.stack.append((tag, hidden, parent_pre or tag in ("pre", "textarea", "xmp"), element))
        if hidden == REMOVED:
            return
        if tag == "tr" and box.tag == "table":
            box.rows.append([])
        elif tag in ("li", "dd", "td", "th", "table", "blockquote"):
            if tag not in ("td", "th") or box.tag != "table":
                box.edge(tag in SPACED)
            inner = Box(tag)
            if tag == "li" and box.counts and next((x[0] for x in reversed(self.stack[:-1]) if x[0] in ("ul", "ol", "menu")), "") == "ol":
                box.counts[-1] = number(of.get("value"), box.counts[-1] + 1)
                inner.number = box.counts[-1]
            elif tag in ("td", "th"):
                down = number(of.get("rowspan"), 1)
                inner.span = min(MOST_COLUMNS, max(1, number(of.get("colspan"), 1))), min(MOST_ROWS, down if down > 0 else MOST_ROWS if down == 0 else 1)
            self.boxes.append(inner)
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dl") and self.open["li"] + self.open["dd"] > 0
            box.edge(tag in SPACED and not nested)
            if tag == "ol":
                box.counts.append(number(of.get("start"), 1) - 1)

    def end(self, tag: str) -> None:
        if tag == "p" and not self.open["p"]:
            self.start("p", "")
        if tag == "br":
            return self.start("br", "")
        for i in range(len(self.stack) - 1, -1, -1) if self.open[tag] else ():
            if self.stack[i][0] == tag:
                if tag in FORMATTING:  # it alone ends: blocks and other formatting inside it go on
                    del self.stack[i]
                    self.open[tag] -= 1
                    return None
                return self.close_to(i)
            if self.stack[i][0] in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
                return None
        return None

    def text(self, s: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and s.strip(" \t\n\r\f"):
            self.pop()
        if self.hidden == SHOWN:
            box = self.boxes[-1]
            pre = bool(self.stack) and self.stack[-1][2]
            if box.tag == "table" and not s.strip(" \t\n\r\f"):
                return
            box.text(unescape(s), pre)

    def feed(self, html: str) -> str:
        at, n = 0, len(html)
        while at < n:
            m = TOKEN.search(html, at)
            if m is None:
                self.text(html[at:])
                break
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            if m["cdata"] is not None:
                self.text(m["cdata"].replace("&", "&amp;"))
            elif m["tag"]:
                tag = m["tag"].lower()
                if m["end"]:
                    self.end(tag)
                    continue
                self.start(tag, m["rest"])
                if tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                    body = html[at : close.start() if close else n]
                    at = close.end() if close else n
                    if tag == "style":
                        if on_screens(attributes(m["rest"]).get("media", "")):
                            self.styled(body)
                    elif self.hidden == SHOWN:
                        self.text(body if tag in ("textarea", "title") else body.replace("&", "&amp;"))
                    self.end(tag)
        self.close_to(0)
        while len(self.boxes) > 1:
            inner = self.boxes.pop()
            self.boxes[-1].block(inner.done())
        return "\n".join(self.boxes[0].done())


def render(html: str | None) -> str:
    """The visible text of a page. Blocks stand on lines of their own, paragraphs, headings, lists and tables between blank lines; list items are marked and indented."""
    return Page().feed(html.replace("\0", "�")) if html else ""


def render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(x.as_py()) for x in part.column(1)], pa.string())], ["page_id", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, text.

    Builds the path of open elements with implied start and end tags (the end of a formatting element leaves blocks inside it open), leaves out what isn't visible (head,
    scripts, styles, templates, embedded objects, svg, annotations of formulas, and what the hidden attribute, styles and style rules for every screen hide, by the cascade: see
    ``Page.hides``; selectors are tags, classes, ids and attributes, below or right below one another) and emits all other text once, that of math too. Tables are aligned by
    the width of characters. A null or empty html gives an
    empty text; malformed markup gives the text that it has. Only page_id and html are read.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(render_batches, "page_id bigint, text string")
