import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, print string, bucket string, _score string, _row string, _stats string, _id string, point string"


@pytest.fixture
def docs(spark):
    """A maker of document tables with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, lang, src, len(t or ""), *"xyzwabcde") for i, t, lang, src in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd(docs):
    """Nulls in every column, empty and long texts, repeated rows and equal texts."""
    long = " ".join(f"word{i % 977} ünï{i}" for i in range(30_000))
    return docs([
        (1, "a b c d", "en", "s1"), (1, "a b c d", "en", "s1"), (2, None, None, None), (3, "", "de", "s2"), (4, "   \n\t", "de", None),
        (5, long, "fr", "s2"), (None, "no id here", "en", "s3"), (None, None, None, None), (6, "a b c d", "en", "s4"), (7, "\U0001d4b3é \x00 日本", "xx", "s1"),
        (-8, "one", None, "s2"), (9, "1234 !!! ???", "en", "s2"),
    ])
