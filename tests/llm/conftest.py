import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (id, text, source) with a further column; ids, texts and sources may be null."""

    def make(data):
        rows = [(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in data]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and very long texts, repeated rows and ids, beyond the basic plane."""
    long = " ".join(f"word{i % 977} a.b@c{i % 7}.org" for i in range(6000))
    return make_docs([
        (1, "plain words here and there", "a"), (1, "plain words here and there", "a"), (2, "", "a"), (3, None, None), (None, "no id at all", "b"), (4, long, "b"),
        (5, "\n\n \t", "b"), (6, "😀 ünïcode Ünïcode 😀", None), (7, "one", "c"), (7, "another text of id seven", "c"),
    ])
