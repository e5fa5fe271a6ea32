"""Operators on node arrays: views, sanitising, lint, diff, contracts.

They work inside a row on the interval encoding (a node's descendants have ids
from its own to ``last``), so none of them shuffles, and each is linear in a
document's nodes: array functions, and for running answers those of ``spans``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.kernel.compare import changes
from quillspark.kernel.table import trees_of

from .spans import blank_ends, nesting, outside, sizes

Pred = Callable[[Column], Column]


def nodes(df: DataFrame, key: str = "doc_id", ast: str = "ast") -> DataFrame:
    """One row per node with the document's key."""
    return df.select(key, F.inline(ast))


def nodes_of_type(ast: Column, *kinds: str) -> Column:
    """The rows of these types, in document order."""
    return F.filter(ast, lambda n: n["type"].isin(*kinds))


def children_of(ast: Column, node: Column) -> Column:
    """A node's direct children."""
    return F.filter(ast, lambda n: n["parent"] == node["id"])


def subtree(ast: Column, node: Column) -> Column:
    """A node and its descendants."""
    return F.filter(ast, lambda n: (n["id"] >= node["id"]) & (n["id"] <= node["last"]))


def remove(ast: Column, gone: Pred) -> Column:
    """Without the nodes that ``gone`` picks and all below them; the root stays."""
    keep = outside(ast, F.transform(ast, lambda n: F.coalesce(gone(n), F.lit(False)) & (n["parent"] >= 0)))
    return F.filter(F.zip_with(ast, keep, lambda n, k: F.when(k, n)), lambda n: n.isNotNull())


def rewrite(ast: Column, change: Callable[[Column], Column]) -> Column:
    """Every node changed by a function of its row."""
    return F.transform(ast, change)


# -- sanitising -----------------------------------------------------------

#: schemes that are dropped, and those that the default list allows (fixed values)
DANGEROUS = ("javascript", "data", "vbscript")
SAFE = ("https", "http", "mailto")


class Policy:
    """A function of node arrays; ``a | b`` applies a, then b.

    Policies that only drop nodes join to one that drops what either does: a node's row decides alone.
    """

    def __init__(self, fn: Callable[[Column], Column], gone: Pred | None = None):
        self.fn, self.gone = fn, gone

    def __call__(self, ast: Column) -> Column:
        return self.fn(ast)

    def __or__(self, other: Policy) -> Policy:
        if self.gone and other.gone:
            return _dropping(lambda n: F.coalesce(self.gone(n), F.lit(False)) | other.gone(n))
        return Policy(lambda ast: other(self(ast)))


def _dropping(gone: Pred) -> Policy:
    return Policy(lambda ast: remove(ast, gone), gone)


strip_html = _dropping(lambda n: n["type"].isin("HtmlBlock", "HtmlInline"))
strip_html_comments = _dropping(lambda n: (n["type"] == "HtmlInline") & F.ltrim(n["text"]).startswith("<!--"))
strip_dangerous_urls = _dropping(lambda n: n["type"].isin("Link", "Image") & F.coalesce(n["scheme"].isin(*DANGEROUS), F.lit(False)))
strip_raw_code = _dropping(lambda n: n["type"].isin("FencedCode", "IndentedCode"))
normalize_unicode = Policy(
    lambda ast: rewrite(ast, lambda n: F.when(n["type"] == "Text", n.withField("text", F.regexp_replace(n["text"], "[\u200b-\u200f\u202a-\u202e\ufeff]", ""))).otherwise(n))
)
strip_images = Policy(
    lambda ast: rewrite(
        ast,
        lambda n: F.when(
            n["type"] == "Image", n.withField("type", F.lit("Text")).withField("url", F.lit(None).cast("string")).withField("title", F.lit(None).cast("string"))
        ).otherwise(n),
    )
)


def allow_url_schemes(*schemes: str) -> Policy:
    """Keeps links and images of these schemes, and those without a scheme."""
    allowed = tuple(s.lower() for s in schemes) or SAFE
    return _dropping(lambda n: n["type"].isin("Link", "Image") & F.coalesce(~n["scheme"].isin(*allowed), F.lit(False)))


def limit_depth(max_depth: int = 10) -> Policy:
    """Drops what stands in quotes and directives nested ``max_depth`` deep; lists are not looked into."""
    return Policy(lambda ast: F.filter(ast, lambda n: n["boxes"] < max_depth))


llm_safe = strip_html | allow_url_schemes() | normalize_unicode
web_safe = llm_safe
# what drops comes first, in one pass: neither rewrite changes what it looks at
strict = (strip_html | allow_url_schemes() | strip_raw_code) | normalize_unicode | strip_images


# -- lint -----------------------------------------------------------------

SEVERITY = {"error": 1, "warning": 2, "info": 3}
_DIAGNOSTIC = ("rule_id", "message", "severity", "line", "col", "offset", "end_offset", "end_line", "end_col", "source_file")


def diagnostic(message: Column, line: Column, col: Column, offset: Column, end_offset: Column, end_line: Column | None = None, end_col: Column | None = None) -> Column:
    """What a rule says about one place."""
    values = {"message": message, "line": line, "col": col, "offset": offset, "end_offset": end_offset, "end_line": end_line, "end_col": end_col}
    return F.struct(*[(F.lit(None) if v is None else v).cast("string" if k == "message" else "int").alias(k) for k, v in values.items()])


def at_node(n: Column, message: Column) -> Column:
    """A diagnostic at a node."""
    return diagnostic(message, n["lineno"], n["col"], n["offset"], n["end_offset"], n["end_lineno"])


@dataclass(frozen=True)
class Rule:
    """A lint rule: ``check(source, ast)`` gives an array of ``diagnostic`` values; ``rule(docs)`` runs it alone."""

    rule_id: str
    severity: str
    check: Callable[[Column, Column], Column]

    def __call__(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        return lint(docs, key, LintRules(**{self.rule_id: self}))


def _skipped_levels(source: Column, ast: Column) -> Column:
    heads = nodes_of_type(ast, "Heading")
    before = F.concat(F.array(F.lit(None).cast("int")), F.transform(heads, lambda n: n["level"]))
    message = lambda n, b: F.format_string("Heading level skipped: expected h%d or lower after h%d, found h%d", b + 1, b, n["level"])
    found = F.zip_with(heads, before, lambda n, b: F.when(n["level"] > b + 1, at_node(n, message(n, b))))
    return F.filter(found, lambda d: d.isNotNull())


def _empty_links(source: Column, ast: Column) -> Column:
    visible = lambda n: (n["type"] == "Image") | (n["type"].isin("Text", "CodeSpan", "HtmlInline") & (F.trim(n["text"]) != ""))
    placed = F.transform(F.zip_with(ast, sizes(ast), lambda n, s: F.struct(n.alias("n"), s.alias("s"))), lambda x, i: F.struct(x["n"].alias("n"), x["s"].alias("s"), i.alias("i")))
    links = F.filter(placed, lambda x: x["n"]["type"] == "Link")
    empty = F.filter(links, lambda x: ~F.exists(F.slice(ast, x["i"] + 2, F.greatest(x["s"] - 1, F.lit(0))), visible))
    return F.transform(empty, lambda x: at_node(x["n"], F.concat(F.lit("Link has no visible text (url: '"), x["n"]["url"], F.lit("')"))))


def _trailing_blanks(source: Column, ast: Column) -> Column:
    message = lambda x: F.format_string("Trailing whitespace (%d character(s))", x["length"] - x["kept"])
    return F.transform(
        blank_ends(source, nodes_of_type(ast, "FencedCode", "IndentedCode")),
        lambda x: diagnostic(message(x), x["line"], x["kept"] + 1, x["offset"] + x["kept"], x["offset"] + x["length"], x["line"], x["length"] + 1),
    )


heading_increment = Rule("heading-increment", "warning", _skipped_levels)
no_empty_link = Rule("no-empty-link", "warning", _empty_links)
trailing_whitespace = Rule("trailing-whitespace", "info", _trailing_blanks)


def diagnostic_text(file: str | None = None) -> Column:
    """``file:line:col: [rule] message`` of a diagnostics row."""
    place = F.concat_ws(":", *([F.lit(file)] if file else []), F.col("line").cast("string"), F.col("col").cast("string"))
    return F.concat(place, F.lit(": ["), "rule_id", F.lit("] "), "message")


def diagnostic_json() -> Column:
    """A diagnostics row as JSON; fields without a value are null."""
    return F.to_json(F.struct(*_DIAGNOSTIC), {"ignoreNullFields": "false"})


def severity_lsp(severity: Column) -> Column:
    """The number that editors use for a severity."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), severity)


class LintRules:
    """An ordered set of rules by id; a second rule of one id is refused."""

    def __init__(self, **rules: Rule):
        self.rules = dict(rules)

    def register(self, rule_id: str, rule: Rule) -> LintRules:
        """These rules and one more."""
        if rule_id in self.rules:
            raise ValueError(f"lint rule {rule_id!r} is registered already")
        return LintRules(**self.rules, **{rule_id: replace(rule, rule_id=rule_id)})


#: the columns of nodes that the default rules read; ``md_nodes`` with these is enough for them
LINT_COLUMNS = ("id", "last", "type", "level", "text", "url", "lineno", "col", "offset", "end_offset", "end_lineno")
DEFAULT_RULES = LintRules(**{r.rule_id: r for r in (heading_increment, no_empty_link, trailing_whitespace)})


def diagnostics(source: Column, ast: Column, rules: LintRules = DEFAULT_RULES, source_file: Column | None = None) -> Column:
    """All diagnostics of a document as an array, sorted by (offset, line, col, rule_id)."""
    order = ("offset", "line", "col", "rule_id", "message", "severity", "end_offset", "end_line", "end_col", "source_file")
    file = F.lit(None).cast("string") if source_file is None else source_file

    def stamped(r: Rule) -> Column:
        own = {"rule_id": F.lit(r.rule_id), "severity": F.lit(r.severity), "source_file": file}
        return F.transform(r.check(source, ast), lambda d: F.struct(*[own.get(c, d[c] if c not in own else None).alias(c) for c in order]))

    return F.array_sort(F.concat(*map(stamped, rules.rules.values())))


def lint(docs: DataFrame, key: str = "doc_id", rules: LintRules = DEFAULT_RULES, source_file: Column | None = None) -> DataFrame:
    """Diagnostics of ``docs(key, source, ast)``; those of a document follow each other in order of (offset, line, col, rule_id)."""
    found = docs.select(key, diagnostics(F.col("source"), F.col("ast"), rules, source_file).alias("d"))
    return found.select(key, F.explode("d").alias("d")).select(key, *[F.col(f"d.{c}").alias(c) for c in _DIAGNOSTIC])


# -- diff -----------------------------------------------------------------


def _level(ast: Column, parent: Column) -> Column:
    """(type, hash of the subtree and its places) of a node's children."""
    same = lambda n, top: F.struct(
        (n["id"] - top["id"]).alias("i"), (n["last"] - top["id"]).alias("j"), *[n[c].alias(c) for c in ("type", "level", "style", "explicit_id", "text", "url", "title", "name", "identifier", "info", "ordered", "start", "tight", "checked", "align", "lineno", "col", "offset", "end_offset")]
    )
    # where a child stands in the array and how far its subtree reaches
    placed = F.transform(
        F.zip_with(ast, sizes(ast), lambda n, s: F.struct(n["type"].alias("type"), n["id"].alias("id"), n["parent"].alias("parent"), s.alias("s"))),
        lambda t, i: F.struct(t["type"].alias("type"), t["id"].alias("id"), t["parent"].alias("parent"), t["s"].alias("s"), i.alias("i")),
    )
    kids = F.filter(placed, lambda t: t["parent"] == parent)
    rows = lambda t: F.transform(F.slice(ast, t["i"] + 1, t["s"]), lambda n: same(n, t))
    return F.transform(kids, lambda t: F.struct(t["type"].alias("type"), t["id"].alias("id"), F.sha2(F.to_json(rows(t)), 256).alias("hash")))


def subtree_hash(ast: Column, node: Column, truncate: int = 16) -> Column:
    """The first characters of a SHA-256 over a node's subtree with its places."""
    return F.substring(F.element_at(F.filter(_level(ast, node["parent"]), lambda x: x["id"] == node["id"]), 1)["hash"], 1, truncate)


_CHANGES = "array<struct<kind:string,path:array<int>,type:string>>"
_CHANGE_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("path", pa.list_(pa.int32())), ("type", pa.string())]))


@lru_cache(None)
def _deep():
    @F.arrow_udf(_CHANGES)
    def run(old: pa.Array, new: pa.Array) -> pa.Array:
        pairs = zip(trees_of(old), trees_of(new))
        return pa.array([None if a is None or b is None else [dict(zip(("kind", "path", "type"), c)) for c in changes(a, b)] for a, b in pairs], _CHANGE_TYPE)

    return run


def diff(df: DataFrame, key: str = "doc_id", old: str = "old_ast", new: str = "new_ast", recursive: bool = False) -> DataFrame:
    """Changes by position: (key, kind, path, type) of top-level blocks, or of the nodes in modified ones too."""
    if recursive:
        return df.select(key, F.inline(_deep()(old, new)))
    both = F.arrays_zip(_level(F.col(old), F.lit(0)).alias("a"), _level(F.col(new), F.lit(0)).alias("b"))
    pairs = df.select(key, F.posexplode(both).alias("at", "p")).select(key, "at", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    change = lambda kind, side: F.struct(F.lit(kind).alias("kind"), F.col(f"{side}.type").alias("type"))
    changes = (
        F.when(F.col("a").isNull(), F.array(change("added", "b")))
        .when(F.col("b").isNull(), F.array(change("removed", "a")))
        .when(F.col("a.hash") == F.col("b.hash"), F.array().cast("array<struct<kind:string,type:string>>"))
        .when(F.col("a.type") == F.col("b.type"), F.array(change("modified", "a")))
        .otherwise(F.array(change("removed", "a"), change("added", "b")))
    )
    return pairs.select(key, F.array("at").alias("path"), F.explode(changes).alias("c")).select(key, "c.kind", "path", "c.type")


#: template paths that a change of a node type touches (fixed values)
CONTEXT_PATHS = {
    "Heading": ("page.body", "page.headings", "page.toc"),
    "FootnoteDef": ("page.body", "page.footnotes"),
} | dict.fromkeys(("Paragraph", "FencedCode", "IndentedCode", "List", "ListItem", "BlockQuote", "Table", "ThematicBreak", "Directive", "MathBlock", "HtmlBlock"), ("page.body",))
CONTEXT_FALLBACK = ("page.body", "page.meta", "page.toc")


def context_paths(kind: Column) -> Column:
    """Sorted template paths that a node type affects."""
    arrays = F.create_map(*[x for k, v in CONTEXT_PATHS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.element_at(arrays, kind), F.array(*map(F.lit, CONTEXT_FALLBACK)))


# -- contracts ------------------------------------------------------------

@dataclass(frozen=True)
class Contract:
    """How a directive may be nested; None allows anything."""

    requires_parent: tuple[str, ...] | None = None
    allows_parent: tuple[str, ...] | None = None
    requires_children: tuple[str, ...] | None = None
    allows_children: tuple[str, ...] | None = None
    max_children: int | None = None
    forbids_children: tuple[str, ...] | None = None


#: contracts of directives (fixed values)
CONTRACTS: dict[str, Contract] = {
    "steps": Contract(requires_children=("step",), allows_children=("step",)),
    "step": Contract(allows_parent=("steps",)),
    "tab-set": Contract(allows_children=("tab-item", "tab")),
    "tabs": Contract(allows_children=("tab-item", "tab")),
    "tab-item": Contract(requires_parent=("tab-set", "tabs")),
    "tab": Contract(requires_parent=("tab-set", "tabs")),
    "dropdown": Contract(),
    "details": Contract(),
    "grid": Contract(requires_children=("grid-item", "card")),
    "grid-item": Contract(requires_parent=("grid",)),
    "cards": Contract(allows_children=("card",)),
    "card": Contract(),
    "definition-list": Contract(requires_children=("definition",), allows_children=("definition",)),
    "definition": Contract(requires_parent=("definition-list",)),
}


def contract_violations(docs: DataFrame, key: str = "doc_id", contracts: dict[str, Contract] = CONTRACTS) -> DataFrame:
    """(key, directive, violation, message, line, suggestion) of directives nested against their contracts."""
    rows = docs.select(key, nodes_of_type(F.col("ast"), "Directive").alias("all"))
    rows = rows.select(key, F.explode(F.arrays_zip(F.col("all").alias("d"), nesting(F.col("all")).alias("n"))).alias("x"))
    rows = rows.select(key, F.col("x.d.name").alias("directive"), F.col("x.d.lineno").alias("line"), F.col("x.n.around").alias("parent"), F.col("x.n.kids").alias("kids"))
    # one row per directive with a contract: a table of the size of this module's constant
    rule = docs.sparkSession.createDataFrame(
        [(n, *(list(x) if isinstance(x, tuple) else x for x in (c.requires_parent, c.allows_parent, c.requires_children, c.allows_children, c.forbids_children, c.max_children))) for n, c in contracts.items()],
        "directive string, must array<string>, should array<string>, needs array<string>, only array<string>, never array<string>, most int",
    )
    rows = rows.join(F.broadcast(rule), "directive")
    names = lambda c: F.array_join(c, ", ")
    none = F.array().cast("array<struct<violation:string,message:string>>")
    one = lambda when, kind, text: F.when(when, F.array(F.struct(F.lit(kind).alias("violation"), text.alias("message")))).otherwise(none)
    d = F.concat(F.lit("'"), F.col("directive"), F.lit("'"))
    each = lambda kids, text: F.transform(kids, lambda k: F.struct(F.lit("forbidden_child").alias("violation"), F.concat(F.lit("'"), k, F.lit(text), d).alias("message")))
    top = F.col("parent").isNull()
    wrong_parent = F.col("must").isNotNull() & (top | ~F.array_contains("must", F.coalesce("parent", F.lit(""))))
    bad = F.flatten(
        F.array(
            one(F.col("must").isNotNull() & top, "missing_parent", F.concat(d, F.lit(" must be inside: "), names("must"))),
            one(F.col("must").isNotNull() & ~top & ~F.array_contains("must", F.coalesce("parent", F.lit(""))), "wrong_parent", F.concat(d, F.lit(" must be inside "), names("must"), F.lit(", not '"), F.col("parent"), F.lit("'"))),
            one(~wrong_parent & F.col("should").isNotNull() & (top | ~F.array_contains("should", F.coalesce("parent", F.lit("")))), "suggested_parent", F.concat(d, F.lit(" is intended to be inside: "), names("should"))),
            one(F.col("needs").isNotNull() & ~F.arrays_overlap("kids", "needs"), "missing_required_child", F.concat(d, F.lit(" requires at least one of: "), names("needs"))),
            F.when(F.col("only").isNotNull(), each(F.filter("kids", lambda k: ~F.array_contains("only", k)), "' is not allowed inside ")).otherwise(none),
            F.when(F.col("never").isNotNull(), each(F.filter("kids", lambda k: F.array_contains("never", k)), "' is forbidden inside ")).otherwise(none),
            one(F.size("kids") > F.col("most"), "too_many_children", F.concat(d, F.format_string(" allows max %d children, got %d", "most", F.size("kids")))),
        )
    )
    hint = (
        F.when(F.col("v.violation") == "missing_parent", F.concat(F.lit("Wrap '"), "directive", F.lit("' inside a ':::{"), F.element_at("must", 1), F.lit("}' block")))
        .when(F.col("v.violation") == "missing_required_child", F.concat(F.lit("Add at least one ':::{"), F.element_at("needs", 1), F.lit("}' inside '"), "directive", F.lit("'")))
    )
    rows = rows.select(key, "directive", "line", "must", "needs", F.explode(bad).alias("v"))
    return rows.select(key, "directive", "v.violation", "v.message", "line", hint.alias("suggestion"))
