import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltworks.llm.html_text import extract_text, render

CASES = [
    (None, ""),
    ("", ""),
    ("plain", "plain"),
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<title>t</title><body>x <b>y</b>\n z", "x y z"),
    ("<html><head><meta charset=x><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body>x</body></html>", "x"),
    ("x<!-- a > b -->y<!-- open", "xy"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol><li>a</li><li>b</li></ol>after", "1. a\n2. b\n\nafter"),
    ("<table><tr><th>n</th><th>value</th></tr><tr><td>long name</td><td>1</td></tr></table>", "n          value\nlong name  1"),
    ("<table><td>a<td>b<tr><td>c<td>dd</table>", "a  b\nc  dd"),
    ("<p hidden>a</p><p style='display: none'>b</p><p>c</p>", "c"),
    ("<style>.ad, #x{display:none} p .y{display:none}</style><p class='big AD'>a</p><p id=x>b</p><p class=y>c</p>", "c"),
    ("&amp;lt; &copy; &#x41; &nosuch; a&nbsp;b", "&lt; © A &nosuch; a\xa0b"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
    ("<h1>T</h1>text<h2>U</h2>", "T\n\ntext\n\nU"),
    ("a < b and <3 c", "a < b and <3 c"),
    ("</p>a</div>b", "ab"),
    ("<a href='>'>x</a><a title=\"a>b\">y</a>", "xy"),
    ("<textarea> <b>x</b></textarea>", " <b>x</b>".rstrip()),
    ("<blockquote>q</blockquote>x", "  q\n\nx"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<template>x</template><svg><text>y</text></svg>z", "z"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_render(html, text):
    assert render(html) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "</table>", "<td>", "<tr>", "<div>", "</div>", "<b>", "</b>", "<h1>", "</h1>", "<", ">", "\"", "<blockquote>", "</td>"]), max_size=25))
def test_all_visible_words_come_out_in_any_markup(tags):
    words = [f"w{i}" for i in range(len(tags) + 1)]
    html = words[0] + "".join(f"{t} {w} " for t, w in zip(tags, words[1:]))
    if "\"" in tags or "<" in tags or ">" in tags:
        render(html)
    else:
        assert sorted(x for x in render(html).split() if x.startswith("w")) == sorted(words)


def test_deep_and_long():
    assert render("<div>" * 20000 + "x") == "x"
    assert len(render("<p>word </p>" * 20000).split()) == 20000
    assert render("<a " + "x" * 100000) == ""


def test_table(spark):
    rows = [(i, h) for i, (h, _) in enumerate(CASES)]
    got = extract_text(spark.createDataFrame(rows + rows[:2], "page_id bigint, html string").selectExpr("*", "1 AS text")).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted([(i, t) for i, (_, t) in enumerate(CASES)] + [(0, ""), (1, "")])
    assert extract_text(spark.createDataFrame([], "page_id bigint, html string")).count() == 0
