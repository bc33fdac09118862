import pytest

from siltworks.llm.html_text import render

PAGE = "<style{}>{}</style><p class=nav>menu</p><p>x</p>"


@pytest.mark.parametrize(
    ("css", "shown"),
    [
        ("@media print { .nav { display:none } }", True),
        ("@media(max-width:600px){.nav{display:none}}", True),
        ("@media screen and (max-width:600px) { p.a, b { color: red } .nav { visibility: hidden } }", True),
        ("@layer x { @media print { .nav { display:none } } } .other{display:none}", True),
        ("@container (width < 9px) { .nav { display: none } }", True),
        ("@supports not (display: grid) { .nav { display: none } }", True),
        ("@media screen { .nav { display:none } }", False),
        ("@media\nprint, all{ .nav { display:none } }", False),
        ("@media print { .a { color: red } } .nav { display:none }", False),
        ("@layer x { @supports (display: grid) { .nav { display:none } } }", False),
        ("@import url(a.css); .nav { display:none }", False),
        ("@media print { .nav { display:none } } .nav { display:none }", False),
    ],
)
def test_rules_hide_only_where_every_screen_has_them(css, shown):
    assert render(PAGE.format("", css)) == ("menu\n\nx" if shown else "x")


@pytest.mark.parametrize(("media", "shown"), [("print", True), ("'(max-width: 9px)'", True), ("screen", False), ("all", False), ("''", False)])
def test_media_of_a_style_element(media, shown):
    assert render(PAGE.format(f" media={media}", ".nav{display:none}")) == ("menu\n\nx" if shown else "x")


def test_formulas_are_text():
    assert render("so <math><mi>a</mi><mo>=</mo><mn>1</mn><annotation>a=1</annotation></math> holds") == "so a=1 holds"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p title=it's>Hello</p><p>don't go</p><p>end</p>", "Hello\n\ndon't go\n\nend"),
        ("<p class=a'b\"c x = 'q>r' y=\"s>t\">one</p>two", "one\n\ntwo"),
        ("<a href=\"foo>link</a>", ""),
        ("<b 'x>bold</b> text", "bold text"),
        ("<div style='visibility:hidden'>a<p style='visibility: visible'>b</p>c</div>d", "b\n\nd"),
        ("<style>.h{visibility:hidden}.v{visibility:visible}</style><div class=h>a<i class=v>b</i></div>", "b"),
        ("<div style='display:none'>a<p style='visibility:visible'>b</p></div>c", "c"),
        ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
        ("<ol start=0><li>a<ol><li>x</ol><li>b</ol>", "0. a\n   1. x\n1. b"),
        ("<table><tr><th colspan=2>a long heading over two<th>z<tr><td>k<td>v<td>w</table>", "a long heading over two  z\nk  v                     w"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td colspan=0>a<td colspan=x>b<tr><td rowspan=-1>cc<td>d</table>", "a   b\ncc  d"),
    ],
)
def test_attributes_visibility_numbers_and_spans(html, text):
    assert render(html) == text


def test_large_spans_and_one_very_long_table():
    assert render("<table><tr><td colspan=99999999 rowspan=99999999>a<td>b<tr><td>c</table>").split() == ["a", "b", "c"]
    page = "<table>" + "<tr><td>cell<td>wide cell" * 20000 + "</table>"
    assert render(page).count("cell  wide cell") == 20000
