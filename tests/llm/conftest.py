import pytest

ROWS = [
    (1, "The cat sat on the mat, the cat's mat."),
    (1, "The cat sat on the mat, the cat's mat."),
    (2, None),
    (None, "a row without an id"),
    (None, None),
    (3, ""),
    (4, "  two  spaces \t and\n\nlines  "),
    (5, "İstanbul ΣΑΣ ﬁn naïve 漢字 😀 \x00 <|endoftext|> <|ENDOFTEXT|> </s> <0x0A>"),
    (6, "long " * 3000 + "x" * 4000),
    (7, "▁ marks▁ inside ▁▁"),
    (-8, "negative id"),
]


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Nulls, repeats, empty, long and odd texts, with extra columns that clash with results."""
    rows = [(i, t, "x", "y", 0) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, ids string, n_tokens int").repartition(3)


@pytest.fixture(scope="module")
def no_rows(odd_rows):
    return odd_rows.limit(0)
