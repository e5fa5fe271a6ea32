"""Training-corpus pipeline: quality, near-duplicates, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that the next
one gets as ``docs`` after it was written and read again. All but the last return
the columns of ``documents``.

* Quality drops what the classifier rejects (see ``quillspark.llm.quality``).
* Near-duplicates drops all but the smallest ``doc_id`` of every class of
  documents that link at a Jaccard similarity of 0.8 over five-word shingles.
  Documents without words link with nothing and stay; rows of one ``doc_id`` are
  one document and stay or go together; a null ``doc_id`` stays.
* Mixture takes documents at the calibrated rate of their cell; the cells of the
  highest rates, a hundredth of the tokens at most, are taken whole and set no scale.
* Packing returns the pieces of sequences (see ``quillspark.llm.packing``).

In all stages null and empty texts are texts without words, ties go to the smaller
``doc_id``, equal rows share their fate, an empty table gives no rows, and columns
beyond those of ``documents`` pass through, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.mixing import mix
from quillspark.llm.packing import pack
from quillspark.llm.quality import score_quality
from quillspark.llm.setjoin import jaccard_classes
from quillspark.runtime import discard, stash, table

#: share of the tokens whose cells do not set the scale of the mixture
SPARE = 0.01


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    # whatever other columns are called; each text goes to the workers once
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")
    kept = score_quality(rows, table(spark, sf_dir, "labels")).where("quality_keep")
    return kept.select(*["text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    gone = jaccard_classes(docs).where("component_id != doc_id").select("doc_id")
    return docs.join(stash(gone, "gone").distinct(), "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target marginals of source, language and topic."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", "lang")
    return mix(rows, spare=SPARE).where(F.col("mix_selected")).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("mixing to target weights", mixture),
    ("packing", packing),
]

#: the classifier and the tokenizer are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, f"stage{k}")
            discard(before)
    return docs
