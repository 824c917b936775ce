import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty and blank texts, repeats, one very long text, unusual characters."""
    base = "The quick brown fox jumps over the lazy dog near the river bank, and then it rests. "
    return [
        None, "", "  \n\t ", "word", "two words", base, base, base.upper(), "token = \"abcdefghijkl0123\" user: bob", "mail a.b@mail.example.com or 4111111111111111",
        "é日本語 😀 ﬁ ▁mark", "a | b | c | d | e | f | g", " ".join(f"w{i % 97}x{i}" for i in range(30_000)), base * 20, "x" * 20_000, "<|endoftext|> tail",
    ]


@pytest.fixture(scope="session")
def odd_rows(odd_texts):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(odd_texts)]
    return [*rows, rows[5], rows[5], (None, "a text without an id, and it has some words", None, None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows under a schema with further columns whose names clash with anything an operator may use."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, SCHEMA)
    names = ("TEXT", "Doc_ID", "fp", "length", "kept", "__words", "__c1", "spans", "score", "x")
    return docs.select("*", *[F.lit("clash").alias(name) for name in names])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
