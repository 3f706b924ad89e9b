import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaked_id string, kept_id string, bits bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeats, and columns with clashing names."""
    prose = " ".join(f"word{i % 37} and{i % 11} then{i % 5}" for i in range(60))
    rows = [
        (1, prose, "en", "a", len(prose), "x", "y", 1),
        (1, prose, "en", "a", len(prose), "x", "y", 1),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, None, None, 2),
        (None, "one two three", "xx", "a", 13, None, None, 3),
        (4, "long " * 60_000, "en", "b", 300_000, None, None, 4),
        (5, " \t\n\x0b ", "de", "b", 5, None, None, 5),
        (6, "▁ \x00 <|im_end|> 日本語 😀\n\n  spaced   out ", "fr", "b", 40, None, None, 6),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
