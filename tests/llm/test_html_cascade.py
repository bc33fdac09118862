"""What styles hide, against a tree and a cascade that are worked out another way; widths; tables of many spans."""

import itertools
import random
from html.parser import HTMLParser

import pytest

from siltworks.llm.html_text import render, width


@pytest.mark.parametrize(
    "html,text",
    [
        ("<style>.h{display:none}</style><p class=h style='display:block'>shown</p>", "shown"),
        ("<style>.h{display:none}.h{display:block}</style><p class=h>shown</p>", "shown"),
        ("<style>.h{display:none!important}.h{display:block}</style><p class=h style='display:block'>x</p>y", "y"),
        ("<style>#a{display:block}.h{display:none}</style><p id=a class=h>shown</p>", "shown"),
        ("<style>.a .b{display:none}</style><div class=a><p><span class=b>x</span>y</p></div><span class=b>z</span>", "y\n\nz"),
        ("<style>div.c{display:none}</style><div class=c>x</div><p class=c>y</p>", "y"),
        ("<style>.d>p{display:none}</style><div class=d><p>x</p><div><p>y</p></div></div>", "y"),
        ("<style>[data-x='1'],a:hover,b+i{display:none}</style><p data-x=1>x</p><p data-x=2>y</p>", "y"),
        ("<style>.h{display:none}</style><p hidden style='display:block'>x</p><p hidden>y</p><p class=h>z</p>", "x"),
        ("<div style='visibility:hidden'>x<p style='visibility:visible'>y</p><p style='visibility:inherit'>z</p></div>", "y"),
        ("<b>1<p>2</b>3</p>4", "1\n\n23\n\n4"),
        ("<p><b><i>1</b>2</i>3</p>", "123"),
    ],
)
def test_cases(html, text):
    assert render(html) == text


class Tree(HTMLParser):
    """Elements (tag, attributes, parent) and the words with the element that holds them, of markup in which every tag is closed."""

    def __init__(self):
        super().__init__()
        self.nodes, self.at, self.words = [("root", {}, None)], 0, []

    def handle_starttag(self, tag, attrs):
        self.nodes.append((tag, dict(attrs), self.at))
        self.at = len(self.nodes) - 1

    def handle_endtag(self, tag):
        self.at = self.nodes[self.at][2]

    def handle_data(self, data):
        if self.nodes[self.at][0] != "style":
            self.words += [(w, self.at) for w in data.split()]


def made(rng):
    """(markup, rules as data): a random page whose words are all different."""
    count = itertools.count()
    compound = lambda: (rng.choice(["", "", "div", "span", "section"]), rng.sample(["c0", "c1", "c2"], rng.randint(0, 2)), rng.choice(["", "", "", "i0", "i1"]))
    declaration = lambda: (rng.choice(["display", "display", "visibility"]), rng.random() < 0.15)
    value = lambda name: rng.choice({"display": ["none", "block"], "visibility": ["hidden", "visible", "inherit"]}[name])
    rules = []
    for _ in range(rng.randint(0, 6)):
        chain = [compound() for _ in range(rng.randint(1, 3))]
        if any(c == ("", [], "") for c in chain):
            continue
        name, important = declaration()
        rules.append((chain, [rng.choice(" >") for _ in chain[1:]], name, value(name), important))
    written = lambda c: c[0] + "".join("." + x for x in c[1]) + ("#" + c[2] if c[2] else "")
    css = "".join(written(chain[0]) + "".join(f" {j} {written(c)}" for j, c in zip(joins, chain[1:])) + "{" + f"{name}:{v}{' !important' if important else ''}" + "}" for chain, joins, name, v, important in rules)

    def element(depth):
        attributes = ""
        if rng.random() < 0.6:
            attributes += f' class="{" ".join(rng.sample(["c0", "c1", "c2"], rng.randint(1, 2)))}"'
        if rng.random() < 0.2:
            attributes += f' id="i{rng.randint(0, 1)}"'
        if rng.random() < 0.2:
            name, important = declaration()
            attributes += f' style="{name}:{value(name)}{"!important" if important else ""}"'
        if rng.random() < 0.1:
            attributes += ' hidden=""'
        tag = rng.choice(["div", "span", "section"])
        inside = "".join(element(depth - 1) if depth and rng.random() < 0.6 else f" w{next(count)} " for _ in range(rng.randint(1, 3)))
        return f"<{tag}{attributes}>{inside}</{tag}>"

    return f"<style>{css}</style>" + "".join(element(4) for _ in range(3)), rules


def visible(markup, rules):
    tree = Tree()
    tree.feed(markup)

    def one(c, node):
        tag, of, _ = tree.nodes[node]
        return c[0] in ("", tag) and set(c[1]) <= set((of.get("class") or "").split()) and (not c[2] or of.get("id") == c[2])

    def chains(node, n, joins):
        """All ways up from a node that a selector of n compounds may take, as lists from the top."""
        if n == 1:
            yield [node]
            return
        up, steps = tree.nodes[node][2], 0
        while up is not None:
            if joins[-1] == " " or steps == 0:
                for rest in chains(up, n - 1, joins[:-1]):
                    yield [*rest, node]
            up, steps = tree.nodes[up][2], steps + 1

    def value(node, name):
        said = []
        for order, (chain, joins, what, v, important) in enumerate(rules):
            if what == name and any(all(one(c, x) for c, x in zip(chain, way)) for way in chains(node, len(chain), joins)):
                said.append(((important, 0, sum(c[2] != "" for c in chain), sum(len(c[1]) for c in chain), sum(c[0] != "" for c in chain), order), v))
        style = tree.nodes[node][1].get("style") or ""
        if style.startswith(name):
            said.append((("!important" in style, 1, 0, 0, 0, 0), style.split(":")[1].split("!")[0]))
        return max(said)[1] if said else None

    def shown(node):
        seen, at = None, node
        while at:
            display = value(at, "display")
            if display == "none" or display is None and "hidden" in tree.nodes[at][1]:
                return False
            if seen in (None, "inherit"):
                seen = value(at, "visibility") or "inherit"
            at = tree.nodes[at][2]
        return seen in (None, "inherit", "visible")

    return [w for w, node in tree.words if shown(node)]


@pytest.mark.parametrize("seed", range(4))
def test_cascade_as_by_definition(seed):
    rng, hidden = random.Random(seed), 0
    for _ in range(150):
        markup, rules = made(rng)
        want = visible(markup, rules)
        hidden += "w0" not in want
        assert render(markup).split() == want, markup
    assert hidden > 10


def test_columns_of_wide_characters():
    assert [width(x) for x in ("abc", "漢字", "é", "é", "")] == [3, 4, 1, 1, 0]
    lines = render("<table><tr><td>漢字</td><td>b</td></tr><tr><td>abcdef</td><td>c</td></tr></table>").split("\n")
    assert [width(x[: x.rindex(y)]) for x, y in zip(lines, "bc")] == [8, 8]


def test_overlapping_spans_stay_in_bounds():
    html = "<table>" + "".join(f"<tr><td rowspan=65000>c{i}</td></tr>" for i in range(3000)) + "</table>"
    text = render(html)
    assert text.split() == [f"c{i}" for i in range(3000)]
    assert len(text) < 20 * len(html)
    wide = "<table><tr>" + "".join(f"<td>{i}</td>" for i in range(500)) + "</tr><tr><td colspan=499>a</td><td>b</td></tr></table>"
    one, two = render(wide).split("\n")
    assert one.split() == [str(i) for i in range(500)] and two.index("b") == one.index("499")


def test_rows_stand_alike_in_tables_of_any_size():
    """Rows that are the same to look at come out the same, however many follow: before, blanks were left out of the whole table where it had many."""
    head = "<tr>" + "".join(f"<td rowspan=65000>{'x' * 40}</td>" for _ in range(30)) + "<td>a</td><td>b</td></tr>"
    small, large = (render(f"<table>{head}{'<tr><td>c</td><td>d</td></tr>' * n}</table>").split("\n") for n in (3, 2000))
    assert small == large[: len(small)] and set(small[1:]) == set(large[1:])
    assert small[0].index("a") == small[1].index("c") and small[0].index("b") == small[1].index("d")
    debit = render("<table><tr><td>aaaa</td><td></td></tr><tr><td></td><td>b</td></tr></table>").split("\n")
    assert debit[1].index("b") == 6
    far = render(f"<table><tr><td>{'y' * 9000}</td><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td><td>e</td></tr></table>").split("\n")
    assert far[0].endswith("y  a  b") and far[1].index("d") == 2500 and far[1].endswith("d  e")
