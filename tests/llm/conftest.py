import pytest

#: Columns that clash with names the operators use inside.
EXTRA = ", ".join(f"{c} string" for c in ("size", "key", "digest", "chunk", "level", "n", "label", "interval", "words", "value", "part"))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns."""
    pad = ("x",) * 11
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 10, *pad),
        (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 10, *pad),
        (2, None, "en", "a", None, *pad),
        (3, "", None, None, 0, *pad),
        (None, "the quick brown fox jumps over the lazy dog again and again today", "en", None, 1, *pad),
        (5, " \t\n ", "de", "b", 4, *pad),
        (6, "ab", None, "b", 2, *pad),
        (7, long, "en", "c", len(long), *pad),
        (8, "The Quick brown fox jumps over the lazy dog again and again TODAY", "en", "b", 66, *pad),
        (9, "日本語 テキスト é́ <|endoftext|> don't\x00 stop", None, "c", 9, *pad),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
