import pytest

#: Names that the operators use for columns of their own.
CLASHES = "row copies s q x len odds id h n key bin score keep toxic label rank cut over whole node group prints component begin bucket upto base term query shared i t full kept part w sx"


@pytest.fixture
def make(spark):
    """A documents table with extra columns whose names clash with the operators' own."""

    def build(rows, clash=True):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", *[f"'extra' AS `{c}`" for c in CLASHES.split()]) if clash else df

    return build


@pytest.fixture
def odd(make):
    """Null in every column, empty, blank and very long texts, repeated rows."""
    long = "word " * 60_000
    rows = [(1, "some plain words here", "en", "a", 21), (1, "some plain words here", "en", "a", 21), (2, None, "en", "a", None), (None, "no id at all", None, None, 12), (None, None, None, None, None), (3, "", "en", "b", 0), (4, "   ", "en", "b", 3), (5, long, "en", "b", len(long)), (6, "x", "en", "", 1), (7, "é́ \U0001f600 ünï", "de", "b", 7)]
    return make(rows)


@pytest.fixture
def none(make):
    return make([])
