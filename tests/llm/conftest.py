import pytest

AWKWARD = [
    (1, None, "x"),
    (2, "", "x"),
    (3, "   \n\t ", None),
    (4, "one", "x"),
    (4, "one", "x"),
    (4, "another text under the same id", "y"),
    (None, "no id at all", "z"),
    (5, "long " * 60_000, "x"),
    (6, "é日本  <|endoftext|> \x00 end", "x"),
    (7, "\n" * 50, "x"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names operators use."""
    rows = spark.createDataFrame(AWKWARD, SCHEMA).selectExpr(
        "doc_id", "text", "lang", "'s' AS source", "5L AS n_chars", "1 AS tag", "2.0 AS score", "'r' AS rest", "3 AS key", "4 AS fp", "array(1) AS spans"
    )
    return rows.cache()


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
