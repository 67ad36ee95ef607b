import duckdb
import pytest

FOLDER = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def clashing():
    """Names that the operators use inside, for columns that must not matter."""
    return ("n_words", "size", "target", "node", "component", "kept", "score", "shingles", "window", "length", "offset", "part")


@pytest.fixture(scope="session")
def odd_documents(spark, clashing):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long_text = " ".join(f"word{k}" for k in range(60_000)) + "."
    sentence = "The quick brown fox jumps over the lazy dog and runs away."
    rows = [
        (1, sentence, "s1"),
        (1, sentence, "s1"),
        (2, None, "s1"),
        (3, "", "s2"),
        (4, " \t\n\r ", "s2"),
        (5, "two words", None),
        (6, "two words", None),
        (7, long_text, "s3"),
        (8, long_text + " more", "s3"),
        (9, sentence + "\n" + sentence + "\n| a | b | c |", "s1"),
        (None, sentence, "s1"),
        (None, None, None),
        (10, "Grüße 世界 🙂 <|endoftext|> # $ %", "s4"),
    ]
    names = ", ".join(f"{c} string" for c in clashing)
    full = [(i, t, "en", s, None, *("x" for _ in clashing)) for i, t, s in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {names}")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection
