"""Queries whose result has a closed form: Markdown made from a table's columns, and what must come out.

A case gives the source and the expected value as SQL that Spark and DuckDB read
alike; the query parses and renders the source, the oracle states the value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.kernel.model import Options
from quillspark.runtime import ship, spread, table

NL = "chr(10)"
#: marks that are taken out of prose (a SQL string literal)
_MARKS = "'*_`[]!<>&~$#|+=-:;(){}%@/\"^' || chr(92) || chr(39) || chr(9) || chr(13)"
PROSE = f"trim(replace(translate(coalesce(text, ''), {_MARKS}, ''), chr(10), ' '))"
_PART, _ORDER, _CUSTOMER = ("part", "p_partkey"), ("orders", "o_orderkey"), ("customer", "c_custkey")


@dataclass(frozen=True)
class Case:
    """One query and its oracle."""

    name: str
    table: str
    key: str
    source: str
    expect: str
    make: Callable[[Column], Column]
    out: str = "html"

    def query(self, spark, sf_dir: str) -> DataFrame:
        """(id, out) of every row of the table."""
        ship(spark)
        rows = spread(table(spark, sf_dir, self.table).select(F.expr(self.key).alias("id"), F.expr(self.source).alias("source")))
        return rows.select("id", self.make(F.col("source")).alias(self.out))

    def oracle(self) -> str:
        """The expected rows."""
        return f"select {self.key} as id, {self.expect} as {self.out} from {self.table}"


def _lines(*parts: str) -> str:
    """SQL of parts (column expressions, or text in single quotes), each ending a line."""
    return " || ".join(f"{p} || {NL}" for p in parts)


def _html(*plugins: str):
    return lambda c: C.md_html(c, Options.of(*plugins))


def _case(name: str, where: tuple[str, str], source: str, expect: str, *plugins: str, make=None, out: str = "html") -> Case:
    return Case(name, *where, source, expect, make or _html(*plugins), out)


def _p(inner: str) -> str:
    return f"'<p>' || {inner} || '</p>' || {NL}"


n, r, k = "replace(c_name, '#', '_')", "cast(c_nationkey as string)", "cast(c_custkey as string)"
p, brand, size = "p_name", "p_brand", "cast(p_size as string)"
o, pri = "cast(o_orderkey as string)", "o_orderpriority"
c = "c_name"

CASES = [
    # -- blocks
    _case("parse_prose", ("documents", "doc_id"), f"'x ' || {PROSE}", _p(f"trim('x ' || {PROSE})")),
    _case("parse_paragraphs", _CUSTOMER, _lines(n, "''", f"'second ' || {r}"), f"{_p(n)} || {_p(f"'second ' || {r}")}"),
    _case("parse_atx", _CUSTOMER, _lines(f"'# ' || {n}", "''", f"'Region **' || {r} || '** ok.'"), f"'<h1 id=\"' || lower({n}) || '\">' || {n} || '</h1>' || {NL} || {_p(f"'Region <strong>' || {r} || '</strong> ok.'")}"),
    _case("parse_atx_closed", _CUSTOMER, f"'### ' || {n} || ' ###'", f"'<h3 id=\"' || lower({n}) || '\">' || {n} || '</h3>' || {NL}"),
    _case("parse_setext", _CUSTOMER, _lines(n, "'==='", n, "'---'"), f"'<h1 id=\"' || lower({n}) || '\">' || {n} || '</h1>' || {NL} || '<h2 id=\"' || lower({n}) || '-1\">' || {n} || '</h2>' || {NL}"),
    _case("parse_explicit_id", _CUSTOMER, f"'## ' || {n} || ' {{#r' || {r} || '}}'".replace("{{", "{").replace("}}", "}"), f"'<h2 id=\"r' || {r} || '\">' || {n} || '</h2>' || {NL}"),
    _case("parse_thematic", _CUSTOMER, _lines(n, "''", "'* * *'", n), f"{_p(n)} || '<hr />' || {NL} || {_p(n)}"),
    _case("parse_fence", _PART, _lines("'```json'", f"'{{\"k\": \"' || {brand} || '\"}}'".replace("{{", "{").replace("}}", "}"), "'```'"), f"'<pre><code class=\"language-json\">{{&quot;k&quot;: &quot;' || {brand} || '&quot;}}'".replace("{{", "{").replace("}}", "}") + f" || {NL} || '</code></pre>' || {NL}"),
    _case("parse_fence_unclosed", _PART, _lines("'~~~'", "'# no heading'", p), f"'<pre><code># no heading' || {NL} || {p} || {NL} || '</code></pre>' || {NL}"),
    _case("parse_indented", _PART, _lines(f"'    ' || {p}", "''", f"'      ' || {size}"), f"'<pre><code>' || {p} || {NL} || {NL} || '  ' || {size} || {NL} || '</code></pre>' || {NL}"),
    _case("parse_html_block", _PART, _lines("'<div>'", f"'*' || {size} || '*'", "''", f"'*' || {size} || '*'"), f"'<div>' || {NL} || '*' || {size} || '*' || {NL} || {_p(f"'<em>' || {size} || '</em>'")}"),
    _case("parse_html_comment", _PART, _lines(f"'<!-- ' || {p}", "''", "'end -->'", p), f"'<!-- ' || {p} || {NL} || {NL} || 'end -->' || {NL} || {_p(p)}"),
    _case("parse_blockquote", _CUSTOMER, _lines(f"'> ' || {n}", f"'> ' || {r}"), f"'<blockquote>' || {NL} || {_p(f"{n} || {NL} || {r}")} || '</blockquote>' || {NL}"),
    _case("parse_quote_lazy", _CUSTOMER, _lines(f"'> ' || {n}", "'lazy'"), f"'<blockquote>' || {NL} || {_p(f"{n} || {NL} || 'lazy'")} || '</blockquote>' || {NL}"),
    _case("parse_quote_nested", _CUSTOMER, _lines(f"'> > ' || {n}", f"'> ' || {r}", "'>'", f"'> ' || {r}"), f"'<blockquote>' || {NL} || '<blockquote>' || {NL} || {_p(f"{n} || {NL} || {r}")} || '</blockquote>' || {NL} || {_p(r)} || '</blockquote>' || {NL}"),
    _case("parse_list_tight", _ORDER, _lines(f"'- ' || {o}", f"'- ' || {pri}"), f"'<ul>' || {NL} || '<li>' || {o} || '</li>' || {NL} || '<li>' || {pri} || '</li>' || {NL} || '</ul>' || {NL}"),
    _case("parse_list_loose", _ORDER, _lines(f"'* ' || {o}", "''", f"'* ' || {pri}"), f"'<ul>' || {NL} || '<li>' || {NL} || {_p(o)} || '</li>' || {NL} || '<li>' || {NL} || {_p(pri)} || '</li>' || {NL} || '</ul>' || {NL}"),
    _case("parse_list_nested", _CUSTOMER, _lines(f"'- ' || {c}", f"'  - ' || c_mktsegment", "'- end'"), f"'<ul>' || {NL} || '<li>' || {c} || {NL} || '<ul>' || {NL} || '<li>' || c_mktsegment || '</li>' || {NL} || '</ul>' || {NL} || '</li>' || {NL} || '<li>end</li>' || {NL} || '</ul>' || {NL}"),
    _case("parse_list_blocks", _CUSTOMER, _lines(f"'1. ' || {c}", "''", "'   ```'", f"'   ' || c_mktsegment", "'   ```'"), f"'<ol>' || {NL} || '<li>' || {NL} || {_p(c)} || '<pre><code>' || c_mktsegment || {NL} || '</code></pre>' || {NL} || '</li>' || {NL} || '</ol>' || {NL}"),
    _case("parse_ordered_start", _PART, _lines(f"{size} || '. ' || {p}", f"{size} || '. ' || {brand}"), f"'<ol' || case when p_size = 1 then '' else ' start=\"' || {size} || '\"' end || '>' || {NL} || '<li>' || {p} || '</li>' || {NL} || '<li>' || {brand} || '</li>' || {NL} || '</ol>' || {NL}"),
    _case("parse_list_markers", _PART, _lines(f"'- ' || {p}", f"'+ ' || {brand}"), f"'<ul>' || {NL} || '<li>' || {p} || '</li>' || {NL} || '</ul>' || {NL} || '<ul>' || {NL} || '<li>' || {brand} || '</li>' || {NL} || '</ul>' || {NL}"),
    _case("parse_task_list", _ORDER, _lines(f"'- [x] ' || {o}", f"'- [ ] ' || {pri}"), f"'<ul class=\"contains-task-list\">' || {NL} || '<li class=\"task-list-item\"><input type=\"checkbox\" disabled checked /> ' || {o} || '</li>' || {NL} || '<li class=\"task-list-item\"><input type=\"checkbox\" disabled /> ' || {pri} || '</li>' || {NL} || '</ul>' || {NL}"),
    _case("parse_table", _PART, _lines("'| Name | Size |'", "'|:-:|--:|'", f"'| ' || {p} || ' | ' || {size} || ' | extra |'", f"'| ' || {brand}"), f"'<table>' || {NL} || '<thead>' || {NL} || '<tr>' || {NL} || '<th style=\"text-align: center\">Name</th>' || {NL} || '<th style=\"text-align: right\">Size</th>' || {NL} || '</tr>' || {NL} || '</thead>' || {NL} || '<tbody>' || {NL} || '<tr>' || {NL} || '<td style=\"text-align: center\">' || {p} || '</td>' || {NL} || '<td style=\"text-align: right\">' || {size} || '</td>' || {NL} || '</tr>' || {NL} || '<tr>' || {NL} || '<td style=\"text-align: center\">' || {brand} || '</td>' || {NL} || '<td style=\"text-align: right\"></td>' || {NL} || '</tr>' || {NL} || '</tbody>' || {NL} || '</table>' || {NL}", "table"),
    _case("parse_linkref", _CUSTOMER, _lines(f"'[' || {n} || '] and [Two][ KEY ]'", "''", f"'[' || {n} || ']: /a/' || {k} || ' \"t' || {r} || '\"'", "'[key]: /b'", "'[key]: /c'"), _p(f"'<a href=\"/a/' || {k} || '\" title=\"t' || {r} || '\">' || {n} || '</a> and <a href=\"/b\">Two</a>'")),
    _case("parse_footnotes", _CUSTOMER, _lines(f"{n} || '[^a] and [^a]'", "''", f"'[^a]: note ' || {r}"), f"{_p(f"{n} || '<sup><a href=\"#fn-a\" id=\"fnref-a-1\">1</a></sup> and <sup><a href=\"#fn-a\" id=\"fnref-a-2\">2</a></sup>'")} || '<section class=\"footnotes\">' || {NL} || '<ol>' || {NL} || '<li id=\"fn-a\">' || {NL} || {_p(f"'note ' || {r}")} || '<a href=\"#fnref-a-1\">↩</a>' || {NL} || '<a href=\"#fnref-a-2\">↩<sup>2</sup></a>' || {NL} || '</li>' || {NL} || '</ol>' || {NL} || '</section>' || {NL}", "footnotes"),
    # -- directives
    _case("directive_admonition", _PART, _lines("':::{caution} ' || p_type", p, "':::'"), f"'<div class=\"admonition warning\">' || {NL} || '  <p class=\"admonition-title\">' || p_type || '</p>' || {NL} || {_p(p)} || '</div>' || {NL}"),
    _case("directive_note", _PART, _lines("':::{note}'", "':class: big'", "''", p, "':::'"), f"'<div class=\"admonition note big\">' || {NL} || '  <p class=\"admonition-title\">Note</p>' || {NL} || {_p(p)} || '</div>' || {NL}"),
    _case("directive_dropdown", _PART, _lines(f"':::{{dropdown}} ' || {p}".replace("{{", "{").replace("}}", "}"), "':open:'", f"':badge: ' || {size}", brand, "':::'"), f"'<details class=\"dropdown\" open>' || {NL} || '  <summary><span class=\"dropdown-header\"><span class=\"dropdown-title\">' || {p} || '</span></span><span class=\"dropdown-badge\">' || {size} || '</span></summary>' || {NL} || '  <div class=\"dropdown-content\">' || {NL} || {_p(brand)} || '  </div>' || {NL} || '</details>' || {NL}"),
    _case("directive_container", _PART, _lines("':::{container} a b'", p, "':::'"), f"'<div class=\"a b\">' || {NL} || {_p(p)} || '</div>' || {NL}"),
    _case("directive_unknown", _PART, _lines("':::{zzz} T'", p, "':::{/zzz}'", brand), f"'<div class=\"directive directive-zzz\">' || {NL} || '<p class=\"directive-title\">T</p>' || {NL} || {_p(p)} || '</div>' || {NL} || {_p(brand)}"),
    _case("directive_nested", _PART, _lines("'::::{note}'", "':::{tip} T'", p, "':::'", brand, "'::::'"), f"'<div class=\"admonition note\">' || {NL} || '  <p class=\"admonition-title\">Note</p>' || {NL} || '<div class=\"admonition tip\">' || {NL} || '  <p class=\"admonition-title\">T</p>' || {NL} || {_p(p)} || '</div>' || {NL} || {_p(brand)} || '</div>' || {NL}"),
    _case("directive_tabs", _PART, _lines("'::::{tab-set}'", "':id: t'", "':::{tab-item} A'", p, "':::'", "':::{tab-item} B'", "':selected:'", brand, "':::'", "'::::'"), f"'<div class=\"tabs\" id=\"t\" data-tabs=\"tabs\">' || {NL} || '  <ul class=\"tab-nav\">' || {NL} || '    <li><a href=\"#\" data-tab-target=\"t-0\">A</a></li>' || {NL} || '    <li class=\"active\"><a href=\"#\" data-tab-target=\"t-1\">B</a></li>' || {NL} || '  </ul>' || {NL} || '  <div class=\"tab-content\">' || {NL} || '    <div id=\"t-0\" class=\"tab-pane\">' || {NL} || {_p(p)} || '    </div>' || {NL} || '    <div id=\"t-1\" class=\"tab-pane active\">' || {NL} || {_p(brand)} || '    </div>' || {NL} || '  </div>' || {NL} || '</div>' || {NL}"),
    # -- inlines
    _case("inline_emphasis", _CUSTOMER, f"'*' || {n} || '* _' || {r} || '_'", _p(f"'<em>' || {n} || '</em> <em>' || {r} || '</em>'")),
    _case("inline_strong", _CUSTOMER, f"'**' || {n} || '** __' || {r} || '__ ***b***'", _p(f"'<strong>' || {n} || '</strong> <strong>' || {r} || '</strong> <em><strong>b</strong></em>'")),
    _case("inline_emphasis_rules", _CUSTOMER, f"'*a**' || {r} || '* b_c_' || {r}", _p(f"'<em>a**' || {r} || '</em> b_c_' || {r}")),
    _case("inline_code", _CUSTOMER, f"'`` ' || {n} || '`x ``'", _p(f"'<code>' || {n} || '`x</code>'")),
    _case("inline_link", _PART, f"'[' || {p} || '](/p/' || {size} || ' \"' || {brand} || '\")'", _p(f"'<a href=\"/p/' || {size} || '\" title=\"' || {brand} || '\">' || {p} || '</a>'")),
    _case("inline_link_nested", _PART, f"'[a *' || {size} || '*](<x y>) [u [v](w) x](z)'", _p(f"'<a href=\"x%20y\">a <em>' || {size} || '</em></a> [u <a href=\"w\">v</a> x](z)'")),
    _case("inline_image", _PART, f"'![*' || {p} || '*](/i/' || {size} || '.png)'", _p(f"'<img src=\"/i/' || {size} || '.png\" alt=\"' || {p} || '\" />'")),
    _case("inline_autolink", ("pages", "page_id"), "'<http://e.org/' || cast(page_id as string) || '> <a' || cast(page_id as string) || '@e.org>'", _p("'<a href=\"http://e.org/' || cast(page_id as string) || '\">http://e.org/' || cast(page_id as string) || '</a> <a href=\"mailto:a' || cast(page_id as string) || '@e.org\">a' || cast(page_id as string) || '@e.org</a>'")),
    _case("inline_bare_autolink", ("pages", "page_id"), "'see www.e.org/' || cast(page_id as string) || '. (https://f.org/a) x@y.org!'", _p("'see <a href=\"http://www.e.org/' || cast(page_id as string) || '\">www.e.org/' || cast(page_id as string) || '</a>. (<a href=\"https://f.org/a\">https://f.org/a</a>) <a href=\"mailto:x@y.org\">x@y.org</a>!'"), "autolinks"),
    _case("inline_breaks", _CUSTOMER, f"{n} || '  ' || {NL} || 'a' || chr(92) || {NL} || 'b ' || {NL} || {r}", _p(f"{n} || '<br />' || {NL} || 'a<br />' || {NL} || 'b' || {NL} || {r}")),
    _case("inline_escapes", _CUSTOMER, f"chr(92) || '*' || {n} || chr(92) || '* ' || chr(92) || 'q'", _p(f"'*' || {n} || '* ' || chr(92) || 'q'")),
    _case("inline_entities", _CUSTOMER, f"'&copy; &#35;' || {r} || ' &#x41; &nope; &amp;'", _p(f"'© #' || {r} || ' A &amp;nope; &amp;'")),
    _case("inline_html", _CUSTOMER, f"'a <b class=\"x\">' || {n} || '</b> <!-- c --> <'", _p(f"'a <b class=\"x\">' || {n} || '</b> <!-- c --> &lt;'")),
    _case("inline_strikethrough", _CUSTOMER, f"'~~' || {n} || '~~ ~' || {r} || '~'", _p(f"'<del>' || {n} || '</del> ~' || {r} || '~'"), "strikethrough"),
    _case("inline_math", _CUSTOMER, f"'$x_' || {r} || '$ and $5'", _p(f"'<span class=\"math\">x_' || {r} || '</span> and $5'"), "math"),
    _case("role_kbd", _CUSTOMER, f"'{{kbd}}`A+' || {r} || '`'".replace("{{", "{").replace("}}", "}"), _p(f"'<kbd>A</kbd>+<kbd>' || {r} || '</kbd>'")),
    _case("role_format", _CUSTOMER, f"'{{sub}}`' || {r} || '` {{sup}}`' || {r} || '` {{abbr}}`x`'".replace("{{", "{").replace("}}", "}"), _p(f"'<sub>' || {r} || '</sub> <sup>' || {r} || '</sup> <abbr>x</abbr>'")),
    _case("role_reference", _CUSTOMER, f"'{{ref}}`s' || {r} || '` {{doc}}`d' || {r} || '.md`'".replace("{{", "{").replace("}}", "}"), _p(f"'<a class=\"reference internal\" href=\"#s' || {r} || '\">s' || {r} || '</a> <a class=\"reference internal\" href=\"d' || {r} || '.html\">d' || {r} || '.md</a>'")),
    _case("role_icon_math", _CUSTOMER, f"'{{icon}}`i' || {r} || '` {{math}}`m` {{other}}`y`'".replace("{{", "{").replace("}}", "}"), _p(f"'<span class=\"icon-placeholder\">[icon:i' || {r} || ']</span> <span class=\"math notranslate nohighlight\">m</span> <span class=\"role role-other\">y</span>'")),
    # -- other sinks and summaries
    _case("render_llm", _CUSTOMER, _lines(f"'## ' || {n}", "''", f"'[x](/u) **' || {r} || '**'", "''", "'- a'", "'- b'", "''", "'<div>'", "'</div>'"), f"'## ' || {n} || {NL} || {NL} || 'x (/u) ' || {r} || {NL} || {NL} || '- a' || {NL} || '- b' || {NL} || {NL}", make=C.md_llm, out="text"),
    _case("render_llm_code", _PART, _lines("'```py'", p, "'```'", "''", "'---'", "''", "'![i](u)'"), f"'[code:py]' || {NL} || {p} || {NL} || {NL} || '[/code]' || {NL} || {NL} || '---' || {NL} || {NL} || '[image: i]' || {NL} || {NL}", make=C.md_llm, out="text"),
    _case("render_llm_table", _PART, _lines("'|a|b|'", "'|-|-|'", f"'|' || {p} || '|*' || {size} || '*|'"), f"'| a | b |' || {NL} || '| ' || {p} || ' | ' || {size} || ' |' || {NL} || {NL}", make=lambda c: C.md_llm(c, Options.of("table")), out="text"),
    _case("extract_text", _CUSTOMER, _lines(f"'# ' || {n}", f"'a *' || {r} || '* `c`  '", "'b'", "''", "'- x'", "'- y'", "'> q'"), f"{n} || ' a ' || {r} || ' c b x y q'", make=C.md_text, out="text"),
    _case("excerpt_plain", _CUSTOMER, _lines(f"'# ' || {n}", f"'first ' || {r}", "''", "'## Two'", "'last **b**'"), f"'first ' || {r} || ' Two last b'", make=C.md_excerpt, out="text"),
    _case("excerpt_html", _CUSTOMER, _lines(f"'# ' || {n}", f"'first *' || {r} || '*'", "''", "'## Two'", "'- a'", "'- b'"), f"'<p>first <em>' || {r} || '</em></p><div class=\"excerpt-heading\">Two</div><ul class=\"excerpt-list\">' || {NL} || '<li>a</li>' || {NL} || '<li>b</li>' || {NL} || '</ul>'", make=lambda c: C.md_excerpt(c, rich=True), out="text"),
    _case("excerpt_cut", ("documents", "doc_id"), f"'x ' || {PROSE}", "", make=lambda c: C.md_excerpt(c, 120), out="text"),
    _case("meta_description", ("documents", "doc_id"), f"'x ' || {PROSE}", "", make=C.md_meta, out="text"),
    _case("slugify", ("documents", "doc_id"), PROSE, "", make=C.slugify, out="slug"),
    _case("slugify_entities", _PART, f"'  Q&amp;A &ndash; ' || {p} || ' &lt;' || p_size || '&gt;! '", "'qa-' || replace(lower(p_name), ' ', '-') || '-' || p_size", make=C.slugify, out="slug"),
    _case("html_escape", ("pages", "page_id"), "html", "replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')", make=C.html_escape),
    _case("escape_html", ("conversations", "conv_id * 1000 + turn"), "text", "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')", make=C.escape_html),
    _case("hash_content", ("documents", "doc_id"), "text", "sha256(text)", make=C.hash_content, out="hash"),
    _case("process_escapes", _PART, f"chr(92) || '*' || {p} || chr(92) || 'a' || chr(92) || chr(92)", f"'*' || {p} || chr(92) || 'a' || chr(92)", make=C.process_escapes, out="text"),
    _case("limits_error", _PART, f"repeat('> ', 60 + 5 * p_size) || {p}", "case when 60 + 5 * p_size >= 100 then '1: nesting exceeds 100 levels' end", make=C.parse_error, out="error"),
]

_CUT = "case when length(s) <= {m} then s else trim(case when strpos(reverse(substr(s, 1, {r})), ' ') > 0 then substr(s, 1, {r} - strpos(reverse(substr(s, 1, {r})), ' ')) else substr(s, 1, {r}) end) || '...' end"


def _cut(sql: str, m: int) -> str:
    return _CUT.format(m=m, r=m - 3).replace("(s)", f"({sql})").replace("substr(s,", f"substr({sql},").replace("then s ", f"then {sql} ")


def oracles() -> dict[str, str]:
    """Oracle SQL by query name."""
    out = {x.name: x.oracle() for x in CASES if x.expect}
    text = f"(select doc_id, trim('x ' || {PROSE}) s from documents)"
    # a long text is first cut to the limit, then shortened at a word only if that is longer than the limit
    out["excerpt_cut"] = f"select doc_id as id, trim(substr(s, 1, 120)) as text from {text}"
    mark = lambda m: f"(case when strpos(reverse(h), ' {m}') > 0 then length(h) - strpos(reverse(h), ' {m}') - 1 else -1 end)"
    room = 157
    word = f"case when strpos(reverse(substr(e, 1, {room})), ' ') > 0 then trim(substr(e, 1, {room} - strpos(reverse(substr(e, 1, {room})), ' '))) else substr(e, 1, {room}) end || '...'"
    out["meta_description"] = (
        f"select id, case when length(e) <= 160 then e when greatest({mark('.')}, {mark('!')}, {mark('?')}) > 96 then"
        f" trim(substr(h, 1, greatest({mark('.')}, {mark('!')}, {mark('?')}) + 1)) else {word} end as text"
        f" from (select doc_id as id, trim(substr(s, 1, 200)) e, substr(trim(substr(s, 1, 200)), 1, 160) h from {text})"
    )
    out["slugify"] = f"select doc_id as id, trim(regexp_replace(regexp_replace(lower(trim({PROSE})), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '-') as slug from documents"
    return out
