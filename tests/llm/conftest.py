import pytest

LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeats, and columns named like the operators' own."""
    rows = [(1, "a b c d e f g h", "en", "s1", 15), (1, "a b c d e f g h", "en", "s1", 15), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, " \t\n ", "fr", "s2", 4), (None, "a b c d e f g h", "en", "s1", 15),
            (5, LONG, "en", "s2", len(LONG)), (6, "Straße ünïcode 漢字 \U0001f600", "de", "s2", 9), (7, "x", None, "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_text", "_key", "_row", "_hits", "_lm", "_label", "_score", "size", "n", "uid", "kind", "bucket", "sig", "print", "p"):
        df = df.withColumn(name, df.n_chars)
    return df


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
