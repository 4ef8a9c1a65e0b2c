import pytest

LONG = " ".join(f"word{i % 977} filler" for i in range(20000))
#: Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names.
ODD_TEXTS = [None, "", " \n\t", "a", "The only one.\nAnd another line here, of some length.", "The only one.\nAnd another line here, of some length.", LONG, LONG + " tail", "éà ü ñ 123", "  x"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows of documents with every oddity, and columns named as an operator might name its own."""
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "s0"][i % 2], None if t is None else len(t), "k", 1, "x", i, [i], i, "s", "b") for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id", *[None] * 11), (None, None, *[None] * 11), rows[4], rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int, _key string, _gone int, stats array<int>, fp long, _lines string, term string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
