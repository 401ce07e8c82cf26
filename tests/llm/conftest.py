import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents table of (doc_id, text) pairs."""
    def make(rows):
        full = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties and a very long text."""
    long = "\n".join(f"line number {i} of a very long text with words" for i in range(3000))
    return [
        (1, None), (2, ""), (3, "  \t\n "), (4, "Same text here for all"), (4, "Same text here for all"),
        (5, "sAME TEXT here for all"), (None, "Same text here for all"), (None, None), (6, long), (7, long + " x"),
        (8, "É ünïcode Ä\n\n\nwith\x0bodd\x0cblanks and a long enough line"), (9, "one"),
    ]
