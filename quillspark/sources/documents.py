"""Sources and sinks: Markdown files, frontmatter, notebooks, AST JSON, rendered text."""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: metadata fields that are numbers wherever they can be read as one (fixed value)
NUMERIC_FIELDS = ("weight", "order", "priority")

# opening line, block, closing line of its own, body
_FRONT = r"^---[^\n]*\n((?:[^\n]*\n)*?)[^\S\n]*---[^\S\n]*(?:\n([\s\S]*))?$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, source): one row per file, read through Spark's own file systems."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))


def read_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, source, metadata): one row per notebook; the file's name is the title where none is given."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("nb"))
    source, meta = parse_notebook(F.col("nb"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    named = F.when(F.col("metadata.title") == "Untitled", F.initcap(F.translate(stem, "-_", "  "))).otherwise(F.col("metadata.title"))
    return rows.select("path", source.alias("source"), meta.alias("metadata")).withColumn("metadata", F.col("metadata").withField("title", named))


def read_ast_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, ast): documents stored as AST JSON, one to a file."""
    from quillspark.functions.columns import ast_from_json

    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    return rows.select("path", ast_from_json("json").alias("ast"))


def has_frontmatter(source: Column) -> Column:
    """True if a delimited block opens the source."""
    return source.rlike(_FRONT)


def frontmatter_block(source: Column) -> Column:
    """The text between the delimiters, or null."""
    return F.when(has_frontmatter(source), _strip(F.regexp_extract(source, _FRONT, 1)))


def frontmatter_body(source: Column) -> Column:
    """The body after the block; a source without one as it is."""
    return F.when(has_frontmatter(source), _strip(F.regexp_extract(source, _FRONT, 2))).otherwise(source)


def extract_body(source: Column) -> Column:
    """The body without reading the block; an unclosed block loses its first line."""
    opened = source.startswith("---") & (F.instr(source, "\n") > 0)
    return (
        F.when(has_frontmatter(source), _strip(F.regexp_extract(source, _FRONT, 2)))
        .when(opened, _strip(F.regexp_replace(source, r"^[^\n]*\n", "")))
        .otherwise(_strip(source))
    )


@lru_cache(1)
def _yaml():
    @F.arrow_udf("string")
    def run(block: pa.Array) -> pa.Array:
        try:
            import yaml
        except ImportError as e:
            raise ImportError("frontmatter needs PyYAML on the executors") from e

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # the same results, several times faster

        def one(text):
            if text is None:
                return None
            try:
                got = yaml.load(text, loader)
            except yaml.YAMLError:
                return "{}"
            if not isinstance(got, dict):
                return "{}"
            for k in NUMERIC_FIELDS:
                if got.get(k) is not None:
                    try:
                        got[k] = float(got[k])
                    except (ValueError, TypeError):
                        pass
            return json.dumps(got, default=str, sort_keys=True)

        return pa.array([one(x) for x in block.to_pylist()], pa.string())

    return run


def parse_frontmatter(source: Column) -> tuple[Column, Column]:
    """Metadata as JSON (``{}`` without any) and body; use ``parse_json`` or ``get_json_object`` on the first."""
    return F.coalesce(_yaml()(frontmatter_block(source)), F.lit("{}")), frontmatter_body(source)


# -- notebooks ------------------------------------------------------------

_OUTPUT = "struct<output_type:string,text:string,data:map<string,string>,ename:string,evalue:string,traceback:array<string>>"
NOTEBOOK = (
    "struct<nbformat:int,metadata:struct<title:string,kernelspec:struct<name:string,language:string>,"
    "jupytext:struct<text_representation:struct<display_name:string>,formats:string>,date:string,summary:string,description:string,"
    "tags:array<string>,authors:array<string>>,"
    "cells:array<struct<cell_type:string,source:string,metadata:struct<language:string,jupytext:struct<language_id:string>>,"
    f"outputs:array<{_OUTPUT}>>>>"
)
#: image types in the order of preference (fixed value)
_IMAGES = ("image/png", "image/jpeg", "image/gif", "image/svg+xml")


def _joined(c: Column) -> Column:
    """A text that may be a JSON list of lines."""
    lines = F.from_json(c, "array<string>")
    return F.when(c.startswith("[") & lines.isNotNull(), F.array_join(lines, "")).otherwise(c)


def _output(o: Column) -> Column:
    from quillspark.functions.columns import html_escape

    data = lambda kind: F.element_at(o["data"], kind)
    text = F.coalesce(_joined(o["text"]), F.lit(""))
    box = lambda css, inner: F.concat(F.lit(f'<div class="nb-output{css}">'), inner, F.lit("</div>"))
    pre = lambda c: F.concat(F.lit("<pre>"), html_escape(c), F.lit("</pre>"))
    shown = F.lit("")
    plain, rich = _joined(data("text/plain")), _joined(data("text/html"))
    shown = F.when(_strip(plain) != "", box("", pre(plain))).otherwise(shown)
    shown = F.when(rich.isNotNull(), F.when(_strip(rich) != "", box(" nb-output--html", rich)).otherwise(shown)).otherwise(shown)
    for kind in reversed(_IMAGES):
        image = F.concat(F.lit(f'<img src="data:{kind};base64,'), _joined(data(kind)), F.lit('" alt="output" />'))
        shown = F.when(data(kind).isNotNull(), box(" nb-output--image", image)).otherwise(shown)
    trace = F.when(F.size(o["traceback"]) > 0, F.array_join(o["traceback"], "\n")).otherwise(F.concat_ws(": ", F.coalesce(o["ename"], F.lit("Error")), F.coalesce(o["evalue"], F.lit(""))))
    error = box(" nb-output--error", F.concat(F.lit('<pre class="notebook-error">'), html_escape(trace), F.lit("</pre>")))
    return (
        F.when(o["output_type"] == "stream", F.when(_strip(text) != "", box("", pre(text))).otherwise(F.lit("")))
        .when(o["output_type"].isin("execute_result", "display_data"), shown)
        .when(o["output_type"] == "error", error)
        .otherwise(F.lit(""))
    )


def _cell(c: Column) -> Column:
    text = F.regexp_replace(F.coalesce(_joined(c["source"]), F.lit("")), r"(?U)\s+$", "")
    language = F.coalesce(F.nullif(c["metadata"]["language"], F.lit("")), F.nullif(c["metadata"]["jupytext"]["language_id"], F.lit("")), F.lit("python"))
    outputs = F.filter(F.transform(F.coalesce(c["outputs"], F.array().cast(f"array<{_OUTPUT}>")), _output), lambda x: x != "")
    code = F.concat(F.lit("```"), language, F.lit("\n"), text, F.lit("\n```\n\n"), F.array_join(F.transform(outputs, lambda x: F.concat(x, F.lit("\n\n"))), ""))
    kind = F.coalesce(c["cell_type"], F.lit("code"))
    return F.when(kind == "code", code).when(kind.isin("markdown", "raw") & (text != ""), F.concat(text, F.lit("\n\n"))).otherwise(F.lit(""))


def parse_notebook(content: Column) -> tuple[Column, Column]:
    """Markdown and a struct of metadata of an nbformat 4 notebook; an older one is an error."""
    nb = F.from_json(content, NOTEBOOK)
    old = F.coalesce(nb["nbformat"], F.lit(4)) < 4
    body = F.regexp_replace(F.array_join(F.transform(nb["cells"], _cell), ""), r"(?U)\s+$", "")
    source = F.when(old, F.raise_error(F.concat(F.lit("notebook format "), nb["nbformat"].cast("string"), F.lit(" is not supported")))).otherwise(F.coalesce(body, F.lit("")))
    meta = nb["metadata"]
    title = F.coalesce(F.nullif(meta["title"], F.lit("")), F.nullif(meta["jupytext"]["text_representation"]["display_name"], F.lit("")), F.lit("Untitled"))
    about = F.struct(
        title.alias("title"), F.lit("notebook").alias("type"), F.coalesce(F.size(nb["cells"]), F.lit(0)).alias("cell_count"),
        F.coalesce(meta["kernelspec"]["name"], F.lit("")).alias("kernel_name"), F.coalesce(meta["kernelspec"]["language"], F.lit("")).alias("language_version"),
        meta["date"].alias("date"), meta["summary"].alias("summary"), meta["description"].alias("description"),
        meta["tags"].alias("tags"), meta["authors"].alias("authors"), F.when(meta["jupytext"]["formats"].isNotNull(), F.lit("ipynb")).alias("format"),
    )
    return source, about


def write_rendered(df: DataFrame, path: str, content: str = "html") -> None:
    """Sink: the rendered column and its keys as Parquet."""
    df.where(F.col(content).isNotNull()).write.mode("errorifexists").parquet(path)
