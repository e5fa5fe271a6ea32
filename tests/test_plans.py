"""Plans: filters and columns reach the scan, one parse per row, no shuffle in tree operators."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.operators import trees
from quillspark.runtime import ship, table


def plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf):
    ship(spark)
    got = plan(table(spark, sf, "documents").select("doc_id", "lang", C.md_html("text").alias("html")).where("lang = 'en'"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(lang,en\)", got)
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string,lang:string>", got)


def test_tree_operators_do_not_shuffle(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("source")).withColumn("ast", C.md_parse("source"))
    for df in (trees.nodes(docs), trees.lint(docs), docs.select(trees.strict(F.col("ast"))), trees.diff(docs.select("doc_id", F.col("ast").alias("old_ast"), F.col("ast").alias("new_ast")))):
        assert "Exchange" not in plan(df)


def test_one_parse_for_many_uses(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", C.md_parse("text").alias("ast"))
    got = plan(docs.select("doc_id", F.size("ast"), F.size(trees.nodes_of_type(F.col("ast"), "Text"))))
    assert len(re.findall(r"\) ArrowEvalPython", got)) == 1


def test_rendering_is_one_pass(spark, sf):
    ship(spark)
    got = plan(table(spark, sf, "documents").select("doc_id", C.md_html("text")))
    assert "Exchange" not in got and len(re.findall(r"\) ArrowEvalPython", got)) == 1
