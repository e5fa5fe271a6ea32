"""The kernel: blocks, inlines and renderers against expected output and invariants."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.kernel.blocks import BlockParser
from quillspark.kernel.model import PLUGINS, Options, ParseError
from quillspark.kernel.render import HtmlRenderer, cut_at_sentence, cut_at_word, llm_text, plain_text, slugify
from quillspark.kernel.table import arrow_rows, flatten, from_json, parse, to_json, trees_of, unflatten, url_scheme


def h(source, *plugins):
    options = Options.of(*plugins)
    return HtmlRenderer(options).render(BlockParser(options).parse(source))


# fmt: off
PLAIN = [("# A b",'<h1 id="a-b">A b</h1>\n'),("T\n===",'<h1 id="t">T</h1>\n'),("a\nb","<p>a\nb</p>\n"),("a  \nb","<p>a<br />\nb</p>\n"),("a\\\nb","<p>a<br />\nb</p>\n"),
("**x** *y*","<p><strong>x</strong> <em>y</em></p>\n"),("- a\n- b","<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n"),("- a\n\n- b","<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>\n"),
("3. a",'<ol start="3">\n<li>a</li>\n</ol>\n'),("- [x] a",'<ul class="contains-task-list">\n<li class="task-list-item"><input type="checkbox" disabled checked /> a</li>\n</ul>\n'),
("> a","<blockquote>\n<p>a</p>\n</blockquote>\n"),("```json\nx\n```",'<pre><code class="language-json">x\n</code></pre>\n'),("---","<hr />\n"),
('[x](u "t")','<p><a href="u" title="t">x</a></p>\n'),("![x](u)",'<p><img src="u" alt="x" /></p>\n'),("<https://e.org>",'<p><a href="https://e.org">https://e.org</a></p>\n'),
("{kbd}`A+B`","<p><kbd>A</kbd>+<kbd>B</kbd></p>\n"),("{doc}`x.md`",'<p><a class="reference internal" href="x.html">x.md</a></p>\n'),
(":::{note}\nx\n:::",'<div class="admonition note">\n  <p class="admonition-title">Note</p>\n<p>x</p>\n</div>\n'),
(":::{dropdown} T\nx\n:::",'<details class="dropdown">\n  <summary><span class="dropdown-header"><span class="dropdown-title">T</span></span></summary>\n  <div class="dropdown-content">\n<p>x</p>\n  </div>\n</details>\n'),
(":::{zzz} T\nx\n:::",'<div class="directive directive-zzz">\n<p class="directive-title">T</p>\n<p>x</p>\n</div>\n'),
# spec-like
("\tfoo\tbaz\t\tbim","<pre><code>foo\tbaz\t\tbim\n</code></pre>\n"),("  - foo\n\n\tbar","<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n"),("- foo\n\n\t\tbar","<ul>\n<li>\n<p>foo</p>\n<pre><code>  bar\n</code></pre>\n</li>\n</ul>\n"),
(">\t\tfoo","<blockquote>\n<pre><code>  foo\n</code></pre>\n</blockquote>\n"),("-\t\tfoo","<ul>\n<li>\n<pre><code>  foo\n</code></pre>\n</li>\n</ul>\n"),
(" - foo\n   - bar\n\t - baz","<ul>\n<li>foo\n<ul>\n<li>bar\n<ul>\n<li>baz</li>\n</ul>\n</li>\n</ul>\n</li>\n</ul>\n"),
("*foo*bar","<p><em>foo</em>bar</p>\n"),("***foo***","<p><em><strong>foo</strong></em></p>\n"),("*foo**bar*","<p><em>foo**bar</em></p>\n"),("**foo*","<p>*<em>foo</em></p>\n"),("foo***bar***baz","<p>foo<em><strong>bar</strong></em>baz</p>\n"),
("*foo [bar*](u)","<p>*foo <a href=\"u\">bar*</a></p>\n"),("[a [b](c) d](e)",'<p>[a <a href="c">b</a> d](e)</p>\n'),("[foo]: /url 'the\ntitle'\n\n[foo]",'<p><a href="/url" title="the\ntitle">foo</a></p>\n'),
("[foo]\n\n[foo]: <my url>",'<p><a href="my%20url">foo</a></p>\n'),("&copy; &#35; &amp; &xx;","<p>© # &amp; &amp;xx;</p>\n"),("`` a`b ``","<p><code>a`b</code></p>\n"),
("> a\nb","<blockquote>\n<p>a\nb</p>\n</blockquote>\n"),("> - a\nb","<blockquote>\n<ul>\n<li>a\nb</li>\n</ul>\n</blockquote>\n"),("- a\n\n  b\n- c","<ul>\n<li>\n<p>a</p>\n<p>b</p>\n</li>\n<li>\n<p>c</p>\n</li>\n</ul>\n"),
("- a\n  - b\n\n    c\n- d","<ul>\n<li>a\n<ul>\n<li>\n<p>b</p>\n<p>c</p>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n"),("The number\n14. x","<p>The number\n14. x</p>\n"),("1. a\n2. b","<ol>\n<li>a</li>\n<li>b</li>\n</ol>\n"),
("<div>\n*a*\n\n*b*","<div>\n*a*\n<p><em>b</em></p>\n"),("a <b>x</b>","<p>a <b>x</b></p>\n"),("-\n  foo\n-","<ul>\n<li>foo</li>\n<li></li>\n</ul>\n"),("-\n\n  foo","<ul>\n<li></li>\n</ul>\n<p>foo</p>\n"),
("- a\n-\n- c","<ul>\n<li>a</li>\n<li></li>\n<li>c</li>\n</ul>\n"),("* a\n*\n\n* c","<ul>\n<li>\n<p>a</p>\n</li>\n<li></li>\n<li>\n<p>c</p>\n</li>\n</ul>\n"),
("- # Foo\n- Bar\n  ---\n  baz",'<ul>\n<li>\n<h1 id="foo">Foo</h1>\n</li>\n<li>\n<h2 id="bar">Bar</h2>\nbaz</li>\n</ul>\n'),("foo_bar_baz _x_","<p>foo_bar_baz <em>x</em></p>\n"),("## a {#my-id}",'<h2 id="my-id">a</h2>\n'),("# a\n# a",'<h1 id="a">a</h1>\n<h1 id="a-1">a</h1>\n'),
("```\naaa","<pre><code>aaa\n</code></pre>\n"),("    a\n\n    b","<pre><code>a\n\nb\n</code></pre>\n"),("a\n    b","<p>a\nb</p>\n"),("![foo *bar*](t.jpg)",'<p><img src="t.jpg" alt="foo bar" /></p>\n'),("[](./t)",'<p><a href="./t"></a></p>\n'),("[l](/u(a)b)",'<p><a href="/u(a)b">l</a></p>\n'),
("* * *\n***","<hr />\n<hr />\n"),("- foo\n***\n- bar","<ul>\n<li>foo</li>\n</ul>\n<hr />\n<ul>\n<li>bar</li>\n</ul>\n"),("`a","<p>`a</p>\n"),("\\*a\\*","<p>*a*</p>\n"),("1) a\n1. b","<ol>\n<li>a</li>\n</ol>\n<ol>\n<li>b</li>\n</ol>\n"),
("> ```\na","<blockquote>\n<pre><code></code></pre>\n</blockquote>\n<p>a</p>\n"),("",""),("*a `*`*","<p><em>a <code>*</code></em></p>\n"),("**a**b**c**","<p><strong>a</strong>b<strong>c</strong></p>\n"),("*a **b** c*","<p><em>a <strong>b</strong> c</em></p>\n"),
]

WITH_PLUGINS = [("~~z~~","<p><del>z</del></p>\n"),("~z~","<p>~z~</p>\n"),("|A|B|\n|-|-:|\n|1|2|",'<table>\n<thead>\n<tr>\n<th>A</th>\n<th style="text-align: right">B</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td style="text-align: right">2</td>\n</tr>\n</tbody>\n</table>\n'),
("www.e.org",'<p><a href="http://www.e.org">www.e.org</a></p>\n'),("see http://a.org/x(y). b@c.de!",'<p>see <a href="http://a.org/x(y)">http://a.org/x(y)</a>. <a href="mailto:b@c.de">b@c.de</a>!</p>\n'),("$x$",'<p><span class="math">x</span></p>\n'),
("a[^1]\n\n[^1]: n",'<p>a<sup><a href="#fn-1" id="fnref-1-1">1</a></sup></p>\n<section class="footnotes">\n<ol>\n<li id="fn-1">\n<p>n</p>\n<a href="#fnref-1-1">↩</a>\n</li>\n</ol>\n</section>\n'),
]
# fmt: on


@pytest.mark.parametrize("source, expected", PLAIN)
def test_plain(source, expected):
    assert h(source) == expected


@pytest.mark.parametrize("source, expected", WITH_PLUGINS)
def test_plugins(source, expected):
    assert h(source, "all") == expected


def test_plugins_are_off_by_default():
    assert h("~~a~~ $x$ www.e.org") == "<p>~~a~~ $x$ www.e.org</p>\n"
    assert "<table>" not in h("|a|\n|-|\n|b|")


def test_unknown_plugin():
    with pytest.raises(ValueError):
        Options.of("nope")


def test_options_ignore_unknown_keys():
    assert Options.from_dict({"table": True, "zzz": 1}) == Options.of("table")


def test_footnote_body_on_the_next_line():
    assert "<p>note</p>" in h("a[^1]\n\n[^1]:\nnote\n", "footnotes")


def test_footnote_definitions_vanish_without_the_plugin():
    assert h("a\n\n[^1]: n") == "<p>a</p>\n"


def test_first_definition_wins_and_labels_fold_case():
    assert h("[ẞ]\n\n[SS]: /a\n[ss]: /b") == '<p><a href="/a">ẞ</a></p>\n'


def test_directive_options_and_named_closer():
    html = h("::::{note} T\n:class: x\n\na\n:::{tip}\nb\n:::{/note}\nc")
    assert html.count("</div>") == 2 and html.endswith("<p>c</p>\n") and "note x" in html


def test_no_html_or_code_blocks_inside_directives():
    assert h(":::{container} c\n    a\n:::") == '<div class="c">\n<p>a</p>\n</div>\n'


def test_tabs_choose_the_first_when_none_is_selected():
    html = h("::::{tab-set}\n:::{tab-item} A\nx\n:::\n:::{tab-item} B\ny\n:::\n::::")
    assert html.count('class="tab-pane active"') == 1 and html.index("tab-pane active") < html.index("<p>x</p>")


def test_lone_tags_start_blocks():
    assert h("a\n<custom>\n*b*") == "<p>a</p>\n<custom>\n*b*\n"
    assert h("a\n<span>\n*b*") == "<p>a\n<span>\n<em>b</em></p>\n"
    assert h("a\n\n<span>\n*b*") == "<p>a</p>\n<span>\n*b*\n"
    assert h('<x y="http://z">\n*b*') == '<p><x y="http://z">\n<em>b</em></p>\n'


def test_custom_directive_and_role():
    r = HtmlRenderer(Options(), {"box": lambda r, n, body: f"<box>{body}</box>"}, {"up": lambda r, n: n.data["content"].upper()})
    assert r.render(parse(":::{box}\n{up}`a`\n:::", Options())) == "<box><p>A</p>\n</box>"


def test_failing_role_leaves_a_span():
    r = HtmlRenderer(Options(), roles={"bad": lambda r, n: 1 / 0})
    assert r.render(parse("{bad}`a`", Options())) == '<p><span class="role role-bad">a</span></p>\n'


def test_icons_and_highlighter():
    r = HtmlRenderer(Options(), icons=lambda n: f"<svg>{n}</svg>", highlight=lambda c, lang: f"<hl {lang}>{c}</hl>")
    assert r.render(parse("{icon}`x`\n\n```py\n1\n```", Options())) == "<p><svg>x</svg></p>\n<hl py>1\n</hl>\n"


def test_carriage_returns_stay():
    assert h("a\r\nb\r\n") == "<p>a\r\nb\r</p>\n"


@pytest.mark.parametrize("source", ["> " * 200 + "a", "- " * 200 + "a", "*" * 500 + "a" + "*" * 500])
def test_depth_is_limited(source):
    with pytest.raises(ParseError):
        parse(source, Options())


@pytest.mark.parametrize("source", ["[" * 50_000, "*a " * 20_000, "`" * 20_000 + "a", "<" * 50_000, "![" * 20_000, "a_" * 30_000, "a " + "<!--" * 30_000, "a " + "<?" * 30_000, "a <b" + " c" * 30_000, "[a](" * 20_000, "[a]: <" * 10_000, "| a " * 20_000 + "\n" + "|-" * 20_000])
def test_hostile_inputs_are_fast(source):
    start = time.time()
    h(source, "all")
    assert time.time() - start < 5


MARKS = st.text(alphabet="abcXYZ 0123\n#*_`>-[]()!|~^:.<&${}\t", max_size=120)


@settings(max_examples=300, deadline=None)
@given(MARKS)
def test_never_raises_and_is_deterministic(source):
    assert h(source, "all") == h(source, "all")


@settings(max_examples=200, deadline=None)
@given(MARKS)
def test_intervals_and_round_trips(source):
    tree = parse(source, Options.of("all"))
    rows = flatten(tree)
    for i, (parent, last) in enumerate(zip(rows["parent"], rows["last"])):
        assert parent < i <= last
        assert parent < 0 or last <= rows["last"][parent]
    table = [dict(zip(rows, values)) for values in zip(*rows.values())]
    again = unflatten(table)
    assert HtmlRenderer(Options()).render(again) == HtmlRenderer(Options()).render(tree)
    assert to_json(from_json(to_json(tree))) == to_json(tree)
    assert [t and to_json(t) for t in trees_of(arrow_rows([tree, None, tree]))] == [to_json(tree), None, to_json(tree)]


@settings(max_examples=100, deadline=None)
@given(MARKS, st.permutations(PLUGINS))
def test_plugin_order_does_not_matter(source, order):
    assert h(source, *order) == h(source, "all")


def test_llm_text():
    got = llm_text(parse("# A\n\n> q\n\n3. x\n4. y\n\n<p>raw</p>\n\n---", Options()))
    assert got == "# A\n\n> q\n\n\n3. x\n4. y\n\n---\n\n"


def test_plain_text_keeps_separators():
    assert plain_text(parse("a\n\n---\n\n- b\n- c", Options())) == "a  b c"


def test_scalars():
    assert slugify("Café &amp; Bär!") == "café-bär"
    assert slugify("one two three", max_length=8) == "one-two"[:3] or slugify("one two three", max_length=8) == "one-two"
    assert cut_at_word("aaa bbb ccc", 9) == "aaa..."
    assert cut_at_sentence("One two three. Four five six.", 20) == "One two three."
    assert url_scheme("java&Tab;script:x") == "javascript" and url_scheme("//h/p") is None and url_scheme("/a:b") is None


def test_json_errors():
    for bad in ('{"_type": "Nope"}', '{"_type": "Text", "content": "a"}', "{}"):
        with pytest.raises(ValueError):
            from_json(bad)
