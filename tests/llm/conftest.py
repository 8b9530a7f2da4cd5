import pytest

#: Rows with every special case: nulls, empty and white-space texts, repeated rows, a very long text, clashing extra columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, component string, row_no int, size string, score string, run int"


def rows():
    long_text = "palabra " * 30_000 + "x" * 5_000
    base = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (3, "the quick  brown fox\njumps over the lazy dog again and again ", "en", None),
        (4, "", "en", "b"),
        (5, None, None, "b"),
        (6, " \t\n\r ", "fr", "c"),
        (7, long_text, "es", "é"),
        (8, "Été!! it's 42  nights  and   tabs\t\tend <|endoftext|> \0 x", "fr", "z"),
        (None, "no id here", "en", "a"),
        (9, "one", "en", "a"),
        (10, "two words", "en", None),
        (11, "日本語のテキスト と emoji 🙂🙂 é", "ja", "c"),
    ]
    return [(*r, len(r[1] or ""), "x", None, "y", 1, "s", "t", 2) for r in base]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
