import pytest

#: names that the operators use for columns of their own
CLASHING = "id sig n shard run nth part slab role node weight v unit own other cut host path shape score quality_score quality_keep mix_tokens mix_rate tokens rate kind u component".split()


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """Write tables under a folder like those of the data; returns the folder."""

    def make(**tables):
        root = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{root}/{name}.parquet")
        return str(root)

    return make


@pytest.fixture(scope="session")
def awkward(spark, small):
    """Documents, pages and embeddings with nulls, empties, giants, ties, repeats and clashing columns."""
    from pyspark.sql import functions as F

    giant = " ".join(f"word{i % 997} x{i}" for i in range(60_000))
    texts = [None, "", " \n\t ", "one", "one", "a b c d", "a b c d e", "A B C D E", giant, giant + " more", "Released under the MIT License.", "x😀y é ﬁ 　z", "!!! ??? |||"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 1 else "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "one", None, None, None), (None, None, None, None, None), (5, "a b c d", "en", "s", 7), (5, "a b c d", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    pages = spark.createDataFrame(
        [(0, None, None), (1, "", ""), (2, "no scheme", "<p>a"), (3, "http://A.COM", "<<<>>>"), (3, "http://A.COM", "<<<>>>"), (None, "x://net/es/1?q#f", "<nav>" * 2000 + "text" + "<p>word " * 5000), (5, "http://h/" + "a/" * 3000, "plain")],
        "page_id bigint, url string, html string",
    )
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0], [1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [1.0, 0.01], [1.0, 0.0]]
    ids = [*range(0, 240, 20), None]
    ids, vectors = [*ids, 140, 200], [*vectors, [1.0, 0.0], [0.0, 2.0]]  # a repeated row, and an id with two vectors
    emb = spark.createDataFrame(list(zip(ids, vectors, [None] * 15)), "vec_id bigint, embedding array<float>, label int")
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, None), (None, 1, 1), (4, None, None), (5, 1, 0), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    extra = {c: F.lit(7) for c in CLASHING}
    return small(documents=docs.withColumns(extra), pages=pages.withColumns({k: v for k, v in extra.items()}), embeddings=emb.withColumns(extra), labels=labels.withColumns(extra))


@pytest.fixture(scope="session")
def nothing(spark, awkward, small):
    """The same tables without rows."""
    return small(**{t: spark.read.parquet(f"{awkward}/{t}.parquet").limit(0) for t in ("documents", "pages", "embeddings", "labels")})
