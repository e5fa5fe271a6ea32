"""Every operator and stage over awkward and empty tables, with the results that are defined for them."""

import pytest

import corpus_pipeline
from quillspark.llm.entry import QUERIES

TABLE = {"op3_neardup": "embeddings", "op6_neighbours": "embeddings", "op8_urls": "pages", "op9_extraction": "pages"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op1_packing", "op6_neighbours"}))
def test_one_row_per_row(spark, awkward, name):
    rows = QUERIES[name](spark, awkward).collect()
    assert len(rows) == spark.read.parquet(f"{awkward}/{TABLE.get(name, 'documents')}.parquet").count()


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, awkward)
        assert got.columns == docs.columns and got.count() <= docs.count()
    assert corpus_pipeline.run(spark, awkward).count() > 0


def test_pipeline_stages_defined(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    unique = stages["n-gram jaccard join"](spark, docs, awkward).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in unique) == [-1, -1, 0, 1, 2, 3, 5, 5, 5, 6, 8, 10, 11, 12]
    for name in ("quality classifier", "mixing to target weights"):  # equal rows share their fate
        kept = [tuple(r) for r in stages[name](spark, docs, awkward).collect()]
        everything = [tuple(r) for r in docs.collect()]
        assert set(kept) <= set(everything) and all(kept.count(r) == everything.count(r) for r in kept)
    scored = {r["text"] for r in stages["quality classifier"](spark, docs, awkward).collect()}
    assert {None, ""} <= scored or not {None, ""} & scored  # texts without words alike
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    from quillspark.llm.quality import score_quality

    assert score_quality(docs, none).where("quality_keep").count() == docs.count()


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows if r[key] is not None}


def test_op1_defined(spark, awkward):
    rows = QUERIES["op1_packing"](spark, awkward).collect()
    got = by_id(rows)
    assert got[0]["doc_tokens"] == got[1]["doc_tokens"] == 1
    assert sum(r["length"] for r in rows if r["doc_id"] == 8) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 8) > 100_000


def test_op2_defined(spark, awkward):
    got = by_id(QUERIES["op2_licenses"](spark, awkward).collect())
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["labels"], got[0]["score"]) == (0, 0, None, "", 0.0)
    assert (got[10]["n_base"], got[10]["first_word"], got[10]["base_labels"], got[10]["score"]) == (1, 3, "mit", 1.0)
    assert got[11]["n_words"] == 4 and got[8]["n_words"] == 120_000


def test_op3_defined(spark, awkward):
    got = by_id(QUERIES["op3_neardup"](spark, awkward).collect(), "vec_id")
    for bad in (0, 20, 40, 60, 80, 100, 120):
        assert (got[bad]["n_links"], got[bad]["component_id"], got[bad]["kept"]) == (0, bad, True)
    for k in (140, 160, 180, 220):  # two rows of one id, an equal one, one longer, one nearly equal, one equal without id
        assert got[k]["component_id"] == 140 and got[k]["n_links"] == 5
    assert got[200]["n_links"] == 0


def test_op4_defined(spark, awkward):
    rows = QUERIES["op4_mixing"](spark, awkward).collect()
    assert all(0 < r["rate"] <= 1 for r in rows) and max(r["rate"] for r in rows) == 1.0
    assert by_id(rows)[0]["lang"] == "null" and by_id(rows)[0]["tokens"] == 1


def test_op5_defined(spark, awkward):
    got = by_id(QUERIES["op5_quality"](spark, awkward).collect())
    assert got[0]["score"] == got[1]["score"] == got[2]["score"] and 0 <= got[0]["score"] <= 1


def test_op6_defined(spark, awkward):
    rows = QUERIES["op6_neighbours"](spark, awkward).collect()
    assert {r["query_id"] for r in rows} == {140, 160, 180, 200, 220}
    first = [r["vec_id"] for r in sorted((r for r in rows if r["query_id"] == 140), key=lambda r: r["rank"])]
    assert first[:3] == [180, 160, 220]


def test_op7_defined(spark, awkward):
    got = by_id(QUERIES["op7_jaccard"](spark, awkward).collect())
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(8)] == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 3), (1, 5), (1, 6), (1, 6)]
    assert got[9]["component_id"] == got[8]["component_id"] == 8


def test_op8_defined(spark, awkward):
    rows = QUERIES["op8_urls"](spark, awkward).collect()
    got = by_id(rows, "page_id")
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in (0, 1, 2, 3)] == [("", "", None)] * 3 + [("a.com", "", None)]
    odd = next(r for r in rows if r["page_id"] is None)
    assert (odd["host"], odd["path"], odd["rule"], odd["verdict"]) == ("net", "/es/1", "net/es/", "block")


def test_op9_defined(spark, awkward):
    rows = QUERIES["op9_extraction"](spark, awkward).collect()
    got = by_id(rows, "page_id")
    assert got[0]["text"] == got[1]["text"] == "" and got[2]["text"] == "a" and got[5]["text"] == "plain"
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_op10_defined(spark, awkward):
    rows = QUERIES["op10_sharding"](spark, awkward).collect()
    assert by_id(rows)[0]["size"] == 16 and by_id(rows)[0]["text_crc32"] == 0
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
