import pytest

TEXT = "the cat sat on the mat and looked at the moon for a long while before it slept"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty, blank, very long and repeated rows, and columns named like the operators' own."""
    rows = [
        (1, TEXT, "en", "s"),
        (2, None, "en", None),
        (3, "", None, "s"),
        (4, " \n\t\r\x0b\x0c ", "en", "s"),
        (5, "word " * 60_000, "en", "s"),
        (6, "x" * 100_000, None, "s"),
        (7, TEXT, "en", "t"),
        (7, TEXT, "en", "t"),
        (None, TEXT + " again", "en", "s"),
        (None, None, None, None),
        (8, "'s 'll <|endoftext|> été 日本語 ١٢ 🙂   á it's I'LL", "fr", "s"),
        (9, "|", "de", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ("key", "label", "score", "spans", "fp", "component_id", "_0", "_1", "value", "n", "part", "batch", "tier", "vector", "_rank", "_hash", "_part", "_parts", "rank", "places", "ids", "a.b", "a`b", "a b")
    return df.selectExpr("*", "cast(length(text) as long) n_chars", "named_struct('a b', doc_id, 'c`d', array(source)) nested", *(f"'clash' `{c.replace('`', '``')}`" for c in names))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
