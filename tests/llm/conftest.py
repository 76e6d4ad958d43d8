import pytest

from tests.conftest import SF_SMALL

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows and clashing extra columns."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [
        (1, passage + " one", "en", "a", "x", 1, "r"), (2, "two " + passage, "en", "a", None, 2, "r"),
        (2, "two " + passage, "en", "a", None, 2, "r"), (3, None, None, None, None, None, None),
        (4, "", "en", "b", "y", 3, ""), (None, passage + " none", None, "b", "z", 4, "q"),
        (None, None, None, None, None, None, None), (5, LONG, "de", None, "t", 5, "u"),
        (6, LONG, "de", "a", "t", 6, "u"), (7, " \t\n\x0b\x0c\r ", "en", "a", "t", 7, "u"),
        (8, "É Straße  naïve  wide", "fr", "b", "t", 8, "u"),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, rid string, doc long, score string")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def small_texts(small_docs):
    return {r.doc_id: r.text for r in small_docs.select("doc_id", "text").collect()}
