import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string, doc string, size long"


@pytest.fixture(scope="session")
def docs(spark):
    """Null, empty, very long, repeated and tied rows, and columns with clashing names."""

    def make(rows):
        full = [(i, t, "en", s, len(t or ""), "x", "y", 1) for i, t, s in rows]
        return spark.createDataFrame(full, DDL)

    return make


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
LINE = "This very line is shared by many of the documents here."
ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (None, "a b c", None),
    (4, LONG, "b"),
    (5, "one two three\n" + LINE, "b"),
    (5, "one two three\n" + LINE, "b"),
    (6, "\n\n  \t\n", "c"),
    (7, LINE.upper() + "\n" + LINE, "a"),
    (8, "x " + LINE + "\r\n" + LINE + "\x0b", None),
    (9, LINE, "a"),
    (10, LINE, "a"),
]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)


@pytest.fixture(scope="session")
def none(docs):
    return docs([])
