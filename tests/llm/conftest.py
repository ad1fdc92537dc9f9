import pytest



@pytest.fixture
def docs(spark):
    """Documents with every awkward row, and a column whose name clashes with one the operators add."""

    def make(rows, extra=True):
        d = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id bigint, text string, lang string, source string")
        if extra:
            d = d.selectExpr("*", "1 as size", "'x' as score", "2 as n", "3 as kept", "4 as fp")
        return d

    return make


AWKWARD = [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, "one", "b"), (4, "one", "b"), (None, "two words", "b"), (5, "é 日本 🙂 " * 40, None), (6, "word " * 30_000, "a"), (7, "x" * 50_000, "a")]


@pytest.fixture
def awkward(docs):
    return docs(AWKWARD)


