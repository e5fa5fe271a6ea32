"""Column functions: parse, render and summarise Markdown.

Each is one Arrow-batched pass over its column. A source that breaks a limit
gives null (``parse_error`` says why); it never stops a job. Null gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.kernel import render
from quillspark.kernel.model import Node, Options, ParseError
from quillspark.kernel.table import COLUMNS, SPARK_TYPE, arrow_rows, from_json, parse, to_json, trees_of

AST = SPARK_TYPE
DEFAULT = Options()


def _tree(source: str | None, options: Options) -> Node | None:
    if source is None:
        return None
    try:
        return parse(source, options)
    except ParseError:
        return None


def _per_source(options: Options, make: Callable[[Node, Options], object], kind: str, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def run(source: pa.Array) -> pa.Array:
        trees = (_tree(s, options) for s in source.to_pylist())
        return pa.array([None if t is None else make(t, options) for t in trees], arrow)

    return run


def _per_ast(make: Callable[[Node], object], kind: str, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def run(ast: pa.Array) -> pa.Array:
        return pa.array([None if t is None else make(t) for t in trees_of(ast)], arrow)

    return run


@lru_cache(None)
def _parser(options: Options):
    @F.arrow_udf(SPARK_TYPE)
    def run(source: pa.Array) -> pa.Array:
        return arrow_rows([_tree(s, options) for s in source.to_pylist()])

    return run


def md_parse(source: Column | str, options: Options = DEFAULT) -> Column:
    """The node table of each source as an array of rows."""
    return _parser(options)(source)


@lru_cache(None)
def _nodes(options: Options, names: tuple[str, ...]):
    kinds = {n: t for n, t, _ in COLUMNS}
    if unknown := set(names) - set(kinds):
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")

    @F.arrow_udf("array<struct<" + ",".join(f"`{n}`:{kinds[n]}" for n in names) + ">>")
    def run(source: pa.Array) -> pa.Array:
        return arrow_rows([_tree(s, options) for s in source.to_pylist()], names)

    return run


def md_nodes(source: Column | str, *names: str, options: Options = DEFAULT) -> Column:
    """The node table with these columns alone, where a query needs no more: only they leave the parser."""
    return _nodes(options, names)(source)


@lru_cache(None)
def _errors(options: Options):
    @F.arrow_udf("string")
    def run(source: pa.Array) -> pa.Array:
        def check(s):
            try:
                if s is not None:
                    parse(s, options)
            except ParseError as e:
                return str(e)
            return None

        return pa.array([check(s) for s in source.to_pylist()], pa.string())

    return run


def parse_error(source: Column | str, options: Options = DEFAULT) -> Column:
    """Why a source cannot be parsed, else null."""
    return _errors(options)(source)


@lru_cache(None)
def _html(options: Options):
    return _per_source(options, lambda t, o: render.HtmlRenderer(o).render(t), "string", pa.string())


def md_html(source: Column | str, options: Options = DEFAULT) -> Column:
    """Parse and render in one pass."""
    return _html(options)(source)


@lru_cache(None)
def _llm(options: Options):
    return _per_source(options, lambda t, _: render.llm_text(t), "string", pa.string())


def md_llm(source: Column | str, options: Options = DEFAULT) -> Column:
    """Structured plain text for language models, in one pass."""
    return _llm(options)(source)


@lru_cache(None)
def _text(options: Options):
    return _per_source(options, lambda t, _: render.plain_text(t), "string", pa.string())


def md_text(source: Column | str, options: Options = DEFAULT) -> Column:
    """The plain text of each source, in one pass."""
    return _text(options)(source)


@lru_cache(None)
def _toc(options: Options):
    def make(t: Node, o: Options):
        r = render.HtmlRenderer(o)
        r.render(t)
        return [{"level": a, "text": b, "slug": c} for a, b, c in r.toc]

    arrow = pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string()), ("slug", pa.string())]))
    return _per_source(options, make, "array<struct<level:int,text:string,slug:string>>", arrow)


def md_toc(source: Column | str, options: Options = DEFAULT) -> Column:
    """Headings with unique slugs, in order of rendering."""
    return _toc(options)(source)


@lru_cache(None)
def _excerpt(options: Options, max_chars: int, skip_h1: bool, headings: bool, rich: bool):
    return _per_source(options, lambda t, _: render.excerpt(t, max_chars, skip_h1, headings, rich), "string", pa.string())


def md_excerpt(source: Column | str, max_chars: int = 750, skip_h1: bool = True, headings: bool = True, rich: bool = False, options: Options = DEFAULT) -> Column:
    """The first blocks' text up to ``max_chars``; ``rich`` gives HTML."""
    return _excerpt(options, max_chars, skip_h1, headings, rich)(source)


@lru_cache(None)
def _meta(options: Options, max_chars: int):
    return _per_source(options, lambda t, _: render.meta_description(t, max_chars), "string", pa.string())


def md_meta(source: Column | str, max_chars: int = 160, options: Options = DEFAULT) -> Column:
    """A description for search results."""
    return _meta(options, max_chars)(source)


@lru_cache(None)
def _ast_functions() -> dict:
    return {
        "html": _per_ast(lambda t: render.HtmlRenderer(DEFAULT).render(t), "string", pa.string()),
        "llm": _per_ast(render.llm_text, "string", pa.string()),
        "text": _per_ast(render.plain_text, "string", pa.string()),
        "json": _per_ast(to_json, "string", pa.string()),
    }


def render_html(ast: Column | str) -> Column:
    """HTML of parsed (and perhaps changed) nodes."""
    return _ast_functions()["html"](ast)


def render_llm(ast: Column | str) -> Column:
    """LLM text of parsed nodes."""
    return _ast_functions()["llm"](ast)


def extract_text(ast: Column | str) -> Column:
    """Plain text of parsed nodes."""
    return _ast_functions()["text"](ast)


def ast_json(ast: Column | str) -> Column:
    """Deterministic JSON of parsed nodes."""
    return _ast_functions()["json"](ast)


@lru_cache(None)
def _from_json():
    @F.arrow_udf(SPARK_TYPE)
    def run(text: pa.Array) -> pa.Array:
        return arrow_rows([None if s is None else from_json(s) for s in text.to_pylist()])

    return run


def ast_from_json(text: Column | str) -> Column:
    """Nodes of a JSON text; another root than a Document is an error."""
    return _from_json()(text)


# -- native scalars -------------------------------------------------------


def html_escape(c: Column) -> Column:
    """``& < > "`` escaped; apostrophes stay."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_html(c: Column) -> Column:
    """Like ``html_escape``, apostrophes too."""
    return F.replace(html_escape(c), F.lit("'"), F.lit("&#x27;"))


@lru_cache(None)
def _slugs(max_length: int | None, separator: str, decode: bool):
    @F.arrow_udf("string")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else render.slugify(t, max_length, separator, decode) for t in text.to_pylist()], pa.string())

    return run


def slugify(c: Column | str, max_length: int | None = None, separator: str = "-", decode: bool = True) -> Column:
    """A lower-case anchor of the letters, digits and underscores of any script; character references are decoded first."""
    return _slugs(max_length, separator, decode)(c)


def code_length(node: Column) -> Column:
    """Characters of a code block's content; of a fence from its places alone, without the text."""
    return F.when(node["type"] == "FencedCode", node["source_end"] - node["source_start"]).otherwise(F.length(node["text"]))


def span(first: Column, last: Column) -> Column:
    """The place from the start of one node to the end of another."""
    return F.struct(
        first["lineno"].alias("lineno"), first["col"].alias("col"), first["offset"].alias("offset"),
        F.coalesce(F.nullif(last["end_offset"], F.lit(0)), last["offset"]).alias("end_offset"), F.coalesce(last["end_lineno"], last["lineno"]).alias("end_lineno"),
    )


def process_escapes(c: Column) -> Column:
    """A backslash before ASCII punctuation removed."""
    return F.regexp_replace(c, r"\\([!-/:-@\[-`{-~])", "$1")


def cut_at_word(c: Column, length: int, suffix: str = "...") -> Column:
    """Shortened at a space, with the suffix, when longer than ``length``."""
    room = length - len(suffix)
    if room <= 0:
        return F.when(F.length(c) <= length, c).otherwise(F.lit(suffix[:length]))
    head = F.substring(c, 1, room)
    at = F.length(head) - F.instr(F.reverse(head), " ") + 1
    kept = F.trim(F.when((F.instr(F.reverse(head), " ") > 0) & (at > 1), F.substring(head, F.lit(1), at - 1)).otherwise(head))
    return F.when(F.length(c) <= length, c).otherwise(F.concat(kept, F.lit(suffix)))


def hash_text(c: Column, algorithm: str = "sha256", truncate: int | None = None) -> Column:
    """A hex digest by name (md5, sha1, sha224, sha256, sha384, sha512), perhaps its first characters."""
    if algorithm in ("md5", "sha1"):
        out = getattr(F, algorithm)(c.cast("binary"))
    elif algorithm in ("sha224", "sha256", "sha384", "sha512"):
        out = F.sha2(c.cast("binary"), int(algorithm[3:]))
    else:
        raise ValueError(f"unknown algorithm: {algorithm}")
    return out if truncate is None else F.substring(out, 1, truncate)


def location_text(line: Column, col: Column, file: Column | None = None) -> Column:
    """``file:line:col``, without the file where there is none."""
    return F.concat_ws(":", *([file] if file is not None else []), line.cast("string"), col.cast("string"))


def register(spark, options: Options = DEFAULT) -> None:
    """Make md_html, md_llm, md_text, md_parse, md_excerpt and md_meta known to SQL."""
    made = {"md_html": _html(options), "md_llm": _llm(options), "md_text": _text(options), "md_parse": _parser(options), "md_excerpt": _excerpt(options, 750, True, True, False), "md_meta": _meta(options, 160)}
    for name, fn in made.items():
        spark.udf.register(name, fn)


def hash_content(c: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(c, 256)


def options_from_raw(raw: Column, flags: tuple[str, ...] = (), numbers: tuple[str, ...] = ()) -> Column:
    """A struct of typed directive options: ``none`` and ``null`` are null, flags and integers are coerced."""
    out = []
    for n in (*flags, *numbers):
        v = F.element_at(raw, n)
        v = F.when(F.lower(v).isin("none", "null"), F.lit(None)).otherwise(v)
        out.append((F.lower(v).isin("true", "yes", "1", "") if n in flags else F.try_to_number(v, F.lit("999999999")).cast("int")).alias(n))
    return F.struct(*out)
