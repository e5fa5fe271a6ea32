"""The library's queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions.handlers import DEFAULT_ROLES, DirectiveHandler, Handlers, RoleHandler, directive, md_html_with, registry_of, transform_nodes, visit_nodes
from quillspark.functions.options import OPTIONS
from quillspark.kernel.model import Node, Options, Visitor
from quillspark.kernel.render import plain_text
from quillspark.operators import reuse, trees
from quillspark.runtime import ship, spread, table
from quillspark.sources import documents as S
from quillspark.streaming.incremental import parse_incremental

from .cases import CASES, NL, oracles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {c.name: c.query for c in CASES}
ORACLES: dict[str, str] = oracles()


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _docs(spark, sf_dir, name: str, key: str, source: str, options: Options = C.DEFAULT, columns: tuple[str, ...] = ()) -> DataFrame:
    rows = spread(table(spark, sf_dir, name).select(F.expr(key).alias("doc_id"), F.expr(source).alias("source")))
    return rows.withColumn("ast", C.md_nodes("source", *columns, options=options) if columns else C.md_parse("source", options))


_LIST = f"string_agg('- ' || cast(o_orderkey as varchar), {NL} order by o_orderkey)"


@query(f"select o_custkey as id, count(*)::bigint as items, '<ul>' || {NL} || string_agg('<li>' || cast(o_orderkey as varchar) || '</li>' || {NL}, '' order by o_orderkey) || '</ul>' || {NL} as html from orders group by o_custkey")
def list_per_customer(spark, sf_dir):
    """A list of each customer's orders."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    source = F.array_join(F.transform("k", lambda x: F.concat(F.lit("- "), x.cast("string"))), "\n")
    return rows.select("id", F.size("k").cast("bigint").alias("items"), C.md_html(source).alias("html"))


@query(f"select n_regionkey as id, '<table>' || {NL} || '<thead>' || {NL} || '<tr>' || {NL} || '<th>k</th>' || {NL} || '<th>n</th>' || {NL} || '</tr>' || {NL} || '</thead>' || {NL} || '<tbody>' || {NL} || string_agg('<tr>' || {NL} || '<td>' || n_nationkey || '</td>' || {NL} || '<td>' || n_name || '</td>' || {NL} || '</tr>' || {NL}, '' order by n_nationkey) || '</tbody>' || {NL} || '</table>' || {NL} as html from nation group by n_regionkey")
def table_per_region(spark, sf_dir):
    """A table of each region's nations."""
    row = F.struct("n_nationkey", F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.col("n_name"), F.lit(" |")).alias("line"))
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("k"))
    source = F.concat(F.lit("| k | n |\n|---|---|\n"), F.array_join(F.transform("k", lambda x: x["line"]), "\n"))
    return rows.select("id", C.md_html(source, Options.of("table")).alias("html"))


@query(f"select event_id as id, '<pre><code class=\"language-json\">' || replace(props, '\"', '&quot;') || {NL} || '</code></pre>' || {NL} as html from events")
def fence_of_events(spark, sf_dir):
    """Each event's properties as a code block."""
    source = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```\n"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), C.md_html(source).alias("html"))


@query("select type, count(*)::bigint as n from (select unnest(['Document', 'Heading', 'Text', 'Paragraph', 'Text', 'Strong', 'Text', 'List', 'ListItem', 'Paragraph', 'Text']) as type from part) group by type")
def node_counts(spark, sf_dir):
    """Nodes of each type over a table."""
    rows = spread(table(spark, sf_dir, "part").select(F.expr("'# h' || chr(10) || 'a **b**' || chr(10) || chr(10) || '- c'").alias("source")))
    return rows.select(F.inline(C.md_nodes("source", "type"))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey as doc_id, unnest([1, 2]) as level, unnest(['a b', p_name]) as text, unnest(['a-b', replace(lower(p_name), ' ', '-')]) as slug from part")
def toc(spark, sf_dir):
    """Tables of contents."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr("'# a b' || chr(10) || '## ' || p_name").alias("source"))
    return rows.select("doc_id", F.inline(C.md_toc("source")))


@query("select p_partkey as doc_id, id, parent, depth, last, type from part, (values (0, -1, 0, 6, 'Document'), (1, 0, 1, 4, 'BlockQuote'), (2, 1, 2, 4, 'Paragraph'), (3, 2, 3, 4, 'Emphasis'), (4, 3, 4, 4, 'Text'), (5, 0, 1, 6, 'Paragraph'), (6, 5, 2, 6, 'Text')) t(id, parent, depth, last, type)")
def node_intervals(spark, sf_dir):
    """The interval encoding."""
    docs = _docs(spark, sf_dir, "part", "p_partkey", "'> *a*' || chr(10) || chr(10) || p_name")
    return trees.nodes(docs).select("doc_id", "id", "parent", "depth", "last", "type")


_UNSAFE = "'[a](javascript:x) [b](https://e.org/' || cast(p_size as string) || ') [c](ftp://f) <b>' || p_brand || '</b> ![i](data:y) ![j](/k)' || chr(10) || chr(10) || '<div>' || chr(10) || chr(10) || '    code'"


def _sanitised(policy, spark, sf_dir, source=_UNSAFE, options=C.DEFAULT):
    docs = _docs(spark, sf_dir, "part", "p_partkey", source, options)
    return docs.select("doc_id", C.render_html(policy(F.col("ast"))).alias("html"))


_B = "'<a href=\"https://e.org/' || cast(p_size as varchar) || '\">b</a>'"
_CODE = f"'<pre><code>code' || {NL} || '</code></pre>' || {NL}"


@query(f"select p_partkey as doc_id, '<p> ' || {_B} || '  ' || p_brand || '  <img src=\"/k\" alt=\"j\" /></p>' || {NL} || {_CODE} as html from part")
def sanitize_llm_safe(spark, sf_dir):
    """The policy for language models."""
    return _sanitised(trees.llm_safe, spark, sf_dir)


@query(f"select p_partkey as doc_id, '<p> ' || {_B} || '  ' || p_brand || '  j</p>' || {NL} as html from part")
def sanitize_strict(spark, sf_dir):
    """The strict policy."""
    return _sanitised(trees.strict, spark, sf_dir)


@query(f"select p_partkey as doc_id, '<p> ' || {_B} || ' <a href=\"ftp://f\">c</a> <b>' || p_brand || '</b>  <img src=\"/k\" alt=\"j\" /></p>' || {NL} || '<div>' || {NL} || {_CODE} as html from part")
def sanitize_dangerous_urls(spark, sf_dir):
    """Dangerous schemes dropped."""
    return _sanitised(trees.strip_dangerous_urls, spark, sf_dir)


@query(f"select p_partkey as doc_id, '<p>a' || p_name || 'b</p>' || {NL} as html from part")
def sanitize_unicode(spark, sf_dir):
    """Invisible characters removed."""
    return _sanitised(trees.normalize_unicode, spark, sf_dir, "'a' || '​' || p_name || '‮' || 'b' || '﻿'")


@query(f"select p_partkey as doc_id, '<p>x  y</p>' || {NL} || '<!-- ' || p_brand || ' -->' || {NL} as html from part")
def sanitize_comments(spark, sf_dir):
    """Inline comments dropped, blocks kept."""
    return _sanitised(trees.strip_html_comments, spark, sf_dir, "'x <!-- c --> y' || chr(10) || chr(10) || '<!-- ' || p_brand || ' -->'")


@query(f"select p_partkey as doc_id, '<blockquote>' || {NL} || '<p>a</p>' || {NL} || '<blockquote>' || {NL} || '</blockquote>' || {NL} || '</blockquote>' || {NL} as html from part")
def sanitize_limit_depth(spark, sf_dir):
    """Deep quotes emptied."""
    return _sanitised(trees.limit_depth(2), spark, sf_dir, "'> a' || chr(10) || '>' || chr(10) || '> > ' || p_name")


@query("select p_partkey as doc_id, 'heading-increment' as rule_id, 'warning' as severity, 2 as line, 'Heading level skipped: expected h2 or lower after h1, found h' || (p_size % 6 + 1) as message from part where p_size % 6 + 1 > 2")
def lint_heading_increment(spark, sf_dir):
    """Skipped heading levels."""
    docs = _docs(spark, sf_dir, "part", "p_partkey", "'# a' || chr(10) || repeat('#', p_size % 6 + 1) || ' b'", columns=trees.LINT_COLUMNS)
    return trees.heading_increment(docs).select("doc_id", "rule_id", "severity", "line", "message")


@query("select p_partkey as doc_id, 'no-empty-link' as rule_id, 1 as line, 'Link has no visible text (url: ''/' || p_size || ''')' as message from part")
def lint_empty_link(spark, sf_dir):
    """Links without text."""
    docs = _docs(spark, sf_dir, "part", "p_partkey", "'[](/' || cast(p_size as string) || ') [x](/y) [![i](j)](/z)'", columns=trees.LINT_COLUMNS)
    return trees.no_empty_link(docs).select("doc_id", "rule_id", "line", "message")


@query("select p_partkey as doc_id, line, col, case line when 1 then 'Trailing whitespace (2 character(s))' else 'Trailing whitespace (1 character(s))' end as message, offs as \"offset\" from part, lateral (select 1 as line, length(p_name) + 1 as col, length(p_name) as offs union all select 6, 2, length(p_name) + 3 + 4 + 3 + 4 + 1 + 1) t")
def lint_trailing_whitespace(spark, sf_dir):
    """Blanks at line ends outside code."""
    docs = _docs(spark, sf_dir, "part", "p_partkey", "p_name || '  ' || chr(10) || '```' || chr(10) || 'a ' || chr(10) || '```' || chr(10) || chr(10) || 'b ' || chr(10)", columns=trees.LINT_COLUMNS)
    return trees.trailing_whitespace(docs).select("doc_id", "line", "col", "message", "offset")


@query("select p_partkey as doc_id, rule_id, line from part, (values ('heading-increment', 2), ('no-empty-link', 4), ('trailing-whitespace', 1)) t(rule_id, line)")
def lint_all(spark, sf_dir):
    """All default rules."""
    docs = _docs(spark, sf_dir, "part", "p_partkey", "'# a ' || chr(10) || '### b' || chr(10) || chr(10) || '[](x)'", columns=trees.LINT_COLUMNS)
    return trees.lint(docs).select("doc_id", "rule_id", "line")


_BLANKS = f"replace(replace(coalesce(text, ''), '`', ''), {NL}, ' ' || {NL})"
_BREAKS = f"(length(coalesce(text, '')) - length(replace(coalesce(text, ''), {NL}, '')))"


@query(f"select doc_id, unnest([1, 5 + {_BREAKS}])::int as line from documents")
def lint_documents(spark, sf_dir):
    """Every document as a code block whose lines end in blanks, between two lines that do."""
    source = f"'a ' || {NL} || '```' || {NL} || {_BLANKS} || {NL} || '```' || {NL} || 'b '"
    return trees.lint(_docs(spark, sf_dir, "documents", "doc_id", source, columns=trees.LINT_COLUMNS)).select("doc_id", "line")


@query(f"with s as (select doc_id, unnest(string_split({_BLANKS}, {NL})) as x from documents) select doc_id, count(*)::bigint as n from s where regexp_matches(x, '[ \\t]$') group by doc_id")
def lint_lines(spark, sf_dir):
    """Lines of all documents that end in blanks, without regard to code."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BLANKS).alias("source"), F.array().cast(C.AST).alias("ast"))
    return trees.trailing_whitespace(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey as doc_id, nth, rule_id, line, end_col from part, (values (0, 'trailing-whitespace', 1, 5), (1, 'heading-increment', 2, 0), (2, 'no-empty-link', 4, 0), (3, 'no-empty-link', 4, 0), (4, 'trailing-whitespace', 4, 14)) t(nth, rule_id, line, end_col)")
def lint_sorted(spark, sf_dir):
    """Diagnostics of a document in the order of their places."""
    docs = _docs(spark, sf_dir, "part", "p_partkey", "'# a ' || chr(10) || '### b' || chr(10) || chr(10) || '[](x) [](y)  '", columns=trees.LINT_COLUMNS)
    found = docs.select("doc_id", F.posexplode(trees.diagnostics(F.col("source"), F.col("ast"))).alias("nth", "d"))
    return found.select("doc_id", "nth", "d.rule_id", "d.line", F.coalesce("d.end_col", F.lit(0)).alias("end_col"))


_CHANGES = "('modified', '1', 'Paragraph'), ('removed', '2', 'ThematicBreak'), ('added', '2', 'List'), ('added', '3', 'Paragraph')"


def _versions(spark, sf_dir):
    old = "'# ' || p_name || chr(10) || 'a' || chr(10) || chr(10) || '---'"
    new = "'# ' || p_name || chr(10) || 'b' || chr(10) || chr(10) || '- c' || chr(10) || chr(10) || 'd'"
    rows = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("doc_id"), F.expr(old).alias("old"), F.expr(new).alias("new"))
    return rows.select("doc_id", C.md_parse("old").alias("old_ast"), C.md_parse("new").alias("new_ast"))


@query(f"select p_partkey as doc_id, kind, path, type from part, (values {_CHANGES}) t(kind, path, type)")
def diff_documents(spark, sf_dir):
    """Changes between two versions."""
    return trees.diff(_versions(spark, sf_dir)).withColumn("path", F.array_join("path", "."))


@query(f"select p_partkey as doc_id, kind, path, type from part, (values {_CHANGES}, ('modified', '1.0', 'Text')) t(kind, path, type)")
def diff_recursive(spark, sf_dir):
    """Changes between two versions, those inside modified blocks too."""
    return trees.diff(_versions(spark, sf_dir), recursive=True).withColumn("path", F.array_join("path", "."))


@query("select p_partkey as doc_id, 0 as n from part")
def diff_identical(spark, sf_dir):
    """No changes between equal versions."""
    docs = _docs(spark, sf_dir, "part", "p_partkey", "'# ' || p_name || chr(10) || '- a'")
    found = trees.diff(docs.select("doc_id", F.col("ast").alias("old_ast"), F.col("ast").alias("new_ast"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("int").alias("n"))


@query("select n_nationkey as doc_id, type, paths from nation, (values ('Heading', 'page.body,page.headings,page.toc'), ('Paragraph', 'page.body'), ('Text', 'page.body,page.meta,page.toc'), ('Document', 'page.body,page.meta,page.toc')) t(type, paths)")
def context_paths(spark, sf_dir):
    """Template paths by node type."""
    docs = _docs(spark, sf_dir, "nation", "n_nationkey", "'# a' || chr(10) || 'b'")
    return trees.nodes(docs).select("doc_id", "type", F.array_join(trees.context_paths(F.col("type")), ",").alias("paths")).distinct()


@query("select p_partkey as doc_id, directive, violation, message from part, (values ('tab-item', 'missing_parent', '''tab-item'' must be inside: tab-set, tabs'), ('steps', 'missing_required_child', '''steps'' requires at least one of: step'), ('steps', 'forbidden_child', '''note'' is not allowed inside ''steps''')) t(directive, violation, message)")
def contracts(spark, sf_dir):
    """Directives nested against their contracts."""
    source = "':::{tab-item} A' || chr(10) || p_name || chr(10) || ':::' || chr(10) || '::::{steps}' || chr(10) || ':::{note}' || chr(10) || 'x' || chr(10) || ':::' || chr(10) || '::::'"
    return trees.contract_violations(_docs(spark, sf_dir, "part", "p_partkey", source)).select("doc_id", "directive", "violation", "message")


@query("select p_partkey as doc_id, p_name as title, cast(p_size as double) as weight, p_brand as body from part")
def frontmatter(spark, sf_dir):
    """Metadata and body."""
    source = F.expr("'---' || chr(10) || 'title: \"' || p_name || '\"' || chr(10) || 'weight: ' || cast(p_size as string) || chr(10) || '---' || chr(10) || chr(10) || p_brand || chr(10)")
    meta, body = S.parse_frontmatter(F.col("source"))
    rows = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), source.alias("source"))).select("doc_id", meta.alias("meta"), body.alias("body"))
    return rows.select("doc_id", F.get_json_object("meta", "$.title").alias("title"), F.get_json_object("meta", "$.weight").cast("double").alias("weight"), "body")


@query("select n_nationkey as doc_id, case n_nationkey % 3 when 0 then 'b ' || n_name when 1 then 'a: 1' || chr(10) || n_name else n_name end as body from nation")
def extract_body(spark, sf_dir):
    """Bodies of closed, unclosed and absent blocks."""
    source = "case n_nationkey % 3 when 0 then '---' || chr(10) || 'a: x---y' || chr(10) || '---' || chr(10) || 'b ' || n_name when 1 then '---' || chr(10) || 'a: 1' || chr(10) || n_name else ' ' || n_name || chr(10) end"
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), S.extract_body(F.expr(source)).alias("body"))


@query(f"select event_id as doc_id, '# ' || event_type || {NL} || {NL} || '```julia' || {NL} || 'x = ' || user_id || {NL} || '```' || {NL} || {NL} || '<div class=\"nb-output\"><pre>&lt;' || user_id || '&gt;</pre></div>' as source, 'T' || user_id as title, 2 as cells from events")
def notebook(spark, sf_dir):
    """Notebooks as Markdown."""
    text = F.concat(
        F.lit('{"nbformat":4,"metadata":{"title":"T'), F.col("user_id").cast("string"), F.lit('"},"cells":[{"cell_type":"markdown","source":["# '), F.col("event_type"),
        F.lit('\\n"]},{"cell_type":"code","metadata":{"language":"julia"},"source":"x = '), F.col("user_id").cast("string"),
        F.lit('","outputs":[{"output_type":"stream","text":["<'), F.col("user_id").cast("string"), F.lit('>"]}]}]}'),
    )
    source, meta = S.parse_notebook(F.col("nb"))
    rows = spread(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), text.alias("nb")))
    return rows.select("doc_id", source.alias("source"), meta["title"].alias("title"), meta["cell_count"].alias("cells"))


@query("select doc_id, sha256(text) as content_hash, length(text)::bigint as n_text from documents")
def parse_many(spark, sf_dir):
    """Every distinct document parsed once; the text of prose comes back whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"))
    # code of a fence keeps any text as it is
    fenced = docs.withColumn("source", F.concat(F.lit("~~~~~~~~~~~~\n"), "source", F.lit("\n~~~~~~~~~~~~\n")))
    got = reuse.parse_many(fenced)
    body = F.element_at(trees.nodes_of_type(F.col("ast"), "FencedCode"), 1)["text"]
    text = F.substring(body, F.lit(1), F.length(body) - 1)
    return got.select("doc_id", F.sha2(text, 256).alias("content_hash"), F.length(text).cast("bigint").alias("n_text"))


@query("select count(*)::bigint as parse_calls, sum(length(p_name) + 8)::bigint as source_length, 2 * count(*)::bigint as node_count, 5 * count(*)::bigint as all_nodes from part")
def profile(spark, sf_dir):
    """Totals over a table."""
    return reuse.profile(_docs(spark, sf_dir, "part", "p_partkey", "'# abc' || chr(10) || chr(10) || p_name || chr(10)"))


@query("select p_partkey as doc_id, true as same, 'Document' as kind from part")
def json_round_trip(spark, sf_dir):
    """AST JSON read back gives the same JSON."""
    docs = _docs(spark, sf_dir, "part", "p_partkey", "'# ' || p_name || chr(10) || '1. a' || chr(10) || '   > *b*' || chr(10) || chr(10) || '```x' || chr(10) || p_brand || chr(10) || '```'")
    docs = docs.withColumn("j", C.ast_json("ast"))
    return docs.select("doc_id", (C.ast_json(C.ast_from_json("j")) == F.col("j")).alias("same"), F.get_json_object("j", "$._type").alias("kind"))


@query("select p_partkey as doc_id, true as same from part")
def incremental(spark, sf_dir):
    """A re-parse after an edit equals a full parse."""
    para = lambda x: f"'# ' || p_name || chr(10) || chr(10) || 'one' || chr(10) || chr(10) || '{x}' || chr(10) || chr(10) || 'three' || chr(10) || chr(10) || '## four' || chr(10) || p_brand || chr(10)"
    rows = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(para("two")).alias("old"), F.expr(para("two *and* more")).alias("new"), (F.length("p_name") + 2 + 2 + 5 + 3).alias("at")))
    rows = rows.select("doc_id", "new", C.md_parse("old").alias("previous"), "at", F.lit(11).alias("added"))
    got = parse_incremental("new", "previous", "at", "at", "added")
    return rows.select("doc_id", (C.ast_json(got) == C.ast_json(C.md_parse("new"))).alias("same"))


@query(f"select conv_id, '<blockquote>' || {NL} || '<p>' || replace(replace(replace(replace(string_agg(role || ' ' || turn, {NL} order by turn), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</p>' || {NL} || '</blockquote>' || {NL} as html from conversations group by conv_id")
def quote_per_conversation(spark, sf_dir):
    """A quote of each conversation's turns."""
    row = F.struct("turn", F.concat(F.lit("> "), "role", F.lit(" "), F.col("turn").cast("string")).alias("line"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("k"))
    return rows.select("conv_id", C.md_html(F.array_join(F.transform("k", lambda x: x["line"]), "\n")).alias("html"))


@query()
def html_of_documents(spark, sf_dir):
    """HTML of all documents, every plugin on."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", C.md_html("text", Options.of("all")).alias("html"))


@query(f"select page_id, rtrim(replace(html, {NL}, ' '), {NL}) || {NL} as html from pages")
def html_of_pages(spark, sf_dir):
    """Raw pages, each on one line, as HTML blocks."""
    rows = spread(table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("\n"), F.lit(" ")).alias("html")))
    return rows.select("page_id", C.md_html("html").alias("html"))


@query()
def excerpt_of_documents(spark, sf_dir):
    """Excerpts of all documents."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", C.md_excerpt("text", 200).alias("excerpt"), C.md_meta("text").alias("meta"))


@directive("box")
def _box(renderer, node, body):
    return f"<box>{body}</box>"


@query(f"select n_nationkey as id, '<box><p>' || upper(n_name) || ' <i>' || n_regionkey || '</i> <svg>x</svg></p>' || {NL} || '</box><hl py>1' || {NL} || '</hl>' || {NL} as html from nation")
def custom_handlers(spark, sf_dir):
    """A directive, a role, an icon resolver, a highlighter and a change of lines of the user's own."""
    handlers = Handlers(
        registry_of(_box), DEFAULT_ROLES.register("it", handler=lambda r, n: f"<i>{n.data['content']}</i>"),
        lambda name: f"<svg>{name}</svg>", lambda code, language: f"<hl {language}>{code}</hl>", lambda line: line.replace("nation", "NATION"),
    )
    source = "':::{box}' || chr(10) || lower(n_name) || ' {it}`' || cast(n_regionkey as string) || '` {icon}`x`' || chr(10) || ':::' || chr(10) || '```py' || chr(10) || '1' || chr(10) || '```'"
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), md_html_with(F.expr(source), handlers).alias("html"))


@query(f"select n_nationkey as id, '<p>' || n_name || '</p>' || {NL} as html, n_name as text from nation")
def sql_functions(spark, sf_dir):
    """The functions in SQL."""
    C.register(spark)
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey as id", "md_html(n_name) as html", "md_text(n_name) as text")


@query("select p_partkey as doc_id, 'a.md:2:1: [heading-increment] Heading level skipped: expected h2 or lower after h1, found h3' as text, 2 as lsp from part")
def diagnostic_text(spark, sf_dir):
    """Diagnostics as lines and editor severities."""
    docs = _docs(spark, sf_dir, "part", "p_partkey", "'# a' || chr(10) || '### b'", columns=trees.LINT_COLUMNS)
    return trees.lint(docs).select("doc_id", trees.diagnostic_text("a.md").alias("text"), trees.severity_lsp(F.col("severity")).alias("lsp"))


@query("select p_partkey as doc_id, md5(p_name) as a, substr(sha256(p_name), 1, 12) as b from part")
def hash_text(spark, sf_dir):
    """Digests by name."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), C.hash_text(F.col("p_name"), "md5").alias("a"), C.hash_text(F.col("p_name"), truncate=12).alias("b"))


@query("select p_partkey as doc_id, case when p_size % 2 = 0 then 'true' end as open, case when p_size % 3 = 0 then '-' else p_size::varchar end as size from part")
def typed_options(spark, sf_dir):
    """Raw directive options as typed values."""
    raw = F.create_map(F.lit("open"), F.expr("if(p_size % 2 = 0, 'Yes', 'none')"), F.lit("size"), F.expr("if(p_size % 3 = 0, 'NULL', cast(p_size as string))"))
    got = C.options_from_raw(raw, flags=("open",), numbers=("size",))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), got.alias("o")).select(
        "doc_id", F.col("o.open").cast("string").alias("open"), F.coalesce(F.col("o.size").cast("string"), F.lit("-")).alias("size")
    )


@query("select p_partkey as doc_id, directive, violation, message from part, (values ('box', 'too_many_children', '''box'' allows max 1 children, got 2'), ('box', 'forbidden_child', '''pin'' is forbidden inside ''box'''), ('lid', 'suggested_parent', '''lid'' is intended to be inside: jar')) t(directive, violation, message)")
def contracts_own(spark, sf_dir):
    """Contracts of one's own: at most so many children, and none of some names."""
    source = "'::::{box}' || chr(10) || ':::{lid}' || chr(10) || p_name || chr(10) || ':::' || chr(10) || ':::{pin}' || chr(10) || 'x' || chr(10) || ':::' || chr(10) || '::::'"
    rules = {"box": trees.Contract(max_children=1, forbids_children=("pin",)), "lid": trees.Contract(allows_parent=("jar",))}
    return trees.contract_violations(_docs(spark, sf_dir, "part", "p_partkey", source), contracts=rules).select("doc_id", "directive", "violation", "message")


@query(f"select p_partkey as id, '<p><strong>' || p_name || '</strong> <strong>x</strong></p>' || {NL} || '<pre><code>@@y@@' || {NL} || '</code></pre>' || {NL} as html from part")
def text_lines(spark, sf_dir):
    """A function over the lines that makes Markdown before it is read; code stays."""
    source = F.expr("'@@' || p_name || '@@ @@x@@' || chr(10) || chr(10) || '```' || chr(10) || '@@y@@' || chr(10) || '```'")
    handlers = Handlers(text=lambda line: line.replace("@@", "**"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), md_html_with(source, handlers).alias("html"))


@query(f"select p_partkey as id, '<p>' || p_name || ' (/u)</p>' || {NL} || '<p>' || p_size || '</p>' || {NL} as html from part")
def transform_trees(spark, sf_dir):
    """A function over all nodes that builds new subtrees and drops others."""

    def change(n: Node) -> Node | None:
        if n.type == "Link":
            return Node("Text", [], {"content": plain_text(n) + f" ({n.data['url']})"}, n.line, n.col, n.start, n.end, n.last_line)
        if n.type == "List":
            return Node("Paragraph", [c for item in n.children for p in item.children for c in p.children], {}, n.line, n.col, n.start, n.end, n.last_line)
        return None if n.type == "ThematicBreak" else n

    docs = _docs(spark, sf_dir, "part", "p_partkey", "'[' || p_name || '](/u)' || chr(10) || chr(10) || '---' || chr(10) || '- ' || p_size")
    return docs.select(F.col("doc_id").alias("id"), C.render_html(transform_nodes(F.col("ast"), change)).alias("html"))


class _Outline(Visitor):
    """Headings and words of text."""

    def __init__(self):
        self.levels, self.words = [], 0

    def visit_Heading(self, node):
        self.levels.append(node.data["level"])

    def visit_Text(self, node):
        self.words += len(node.data["content"].split())

    def result(self):
        return {"levels": ",".join(map(str, self.levels)), "words": self.words}


@query("select p_partkey as id, '1,3' as levels, 2 + len(string_split(p_name, ' ')) as words from part")
def visit_trees(spark, sf_dir):
    """What a visitor of one's own finds in each document."""
    docs = _docs(spark, sf_dir, "part", "p_partkey", "'# a' || chr(10) || '### *b*' || chr(10) || p_name")
    got = visit_nodes(F.col("ast"), _Outline, "struct<levels:string,words:bigint>")
    return docs.select(F.col("doc_id").alias("id"), got.alias("o")).select("id", "o.levels", "o.words")


@query(f"select p_partkey as id, '<dl><dt>' || p_name || '</dt><dd>' || p_size || '</dd></dl>' || {NL} as html from part")
def directive_parsed(spark, sf_dir):
    """A directive whose own parser reads its raw content, with typed options."""

    def parse(node: Node, content: str) -> Node:
        node.data["pairs"] = [line.split(node.data["typed"], 1) for line in content.splitlines()]
        return node

    def show(renderer, node, body):
        return "<dl>" + "".join(f"<dt>{a}</dt><dd>{b}</dd>" for a, b in node.data["pairs"]) + "</dl>\n"

    pairs = DirectiveHandler(("pairs",), parse, show, options=lambda raw: raw.get("mark", ":"))
    source = F.expr("':::{pairs}' || chr(10) || ':mark: =' || chr(10) || p_name || '=' || p_size || chr(10) || ':::'")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), md_html_with(source, Handlers(custom=(pairs,))).alias("html"))


@query("select p_partkey as id, length(p_name) + 1 as fence, length(p_brand) + 1 as indented from part")
def code_lengths(spark, sf_dir):
    """Lengths of code blocks."""
    docs = _docs(spark, sf_dir, "part", "p_partkey", "'```' || chr(10) || p_name || chr(10) || '```' || chr(10) || chr(10) || '    ' || p_brand")
    node = lambda kind: F.element_at(trees.nodes_of_type(F.col("ast"), kind), 1)
    return docs.select(F.col("doc_id").alias("id"), C.code_length(node("FencedCode")).alias("fence"), C.code_length(node("IndentedCode")).alias("indented"))


@query("select p_partkey as id, p_name as name, p_size % 2 = 0 as selected, case when p_size % 3 = 0 then 0 else p_size end as start, p_brand as caption from part")
def option_specs(spark, sf_dir):
    """Typed options of tab items and code blocks."""
    flag = F.expr("if(p_size % 2 = 0, 'Yes', 'no')")
    tab = OPTIONS["tab-item"].column(F.create_map(F.lit("selected"), flag, F.lit("name"), F.col("p_name")))
    code = OPTIONS["code-block"].column(F.create_map(F.lit("lineno_start"), F.expr("if(p_size % 3 = 0, 'null', cast(p_size as string))"), F.lit("caption"), F.col("p_brand")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tab.alias("t"), code.alias("c"))
    return rows.select("id", "t.name", "t.selected", F.coalesce("c.lineno_start", F.lit(0)).alias("start"), "c.caption")


@query(f"select p_partkey as id, '<p><abbr title=\"' || p_brand || '\">' || p_name || '</abbr></p>' || {NL} as html from part")
def role_parsed(spark, sf_dir):
    """A role whose own parser splits its content."""

    def parse(node: Node) -> Node:
        node.data["content"], _, rest = node.data["content"].partition(" (")
        node.data["target"] = rest.rstrip(")")
        return node

    role = RoleHandler(("long",), parse, lambda r, node: f'<abbr title="{node.data["target"]}">{node.data["content"]}</abbr>')
    source = F.expr("'{long}`' || p_name || ' (' || p_brand || ')`'")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), md_html_with(source, Handlers(custom_roles=(role,))).alias("html"))
