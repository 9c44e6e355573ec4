import pytest

LONG = "wort und satz, the end. " * 40_000


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, texts and sources, empty and very long texts, repeats, ties, and columns
    named like those that operators add."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog, again and again it jumps over.", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog, again and again it jumps over.", "en", "a"),
        (2, "the QUICK brown fox jumps over the lazy dog, again and again it jumps over.", "en", "a"),
        (3, None, "en", "a"), (4, "", None, "b"), (5, " \n\t ", "en", None), (None, "no id here", "en", "b"), (None, None, None, None),
        (6, LONG, "de", "a"), (7, "one", "de", "c"), (8, "zwei w\u00f6rter", "de", "c"), (9, "\U0001f600 caf\u00e9 \\<x> {{ }} <|endoftext|>", "fr", "c"), (7, "another text of the same id", "de", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = "id fp key unit a b score kept n_words word_chars block epoch position ids n_pieces y mode g6 root node n_tokens base_failed _id _keep text_hash part start".split()
    return df.selectExpr("*", "length(text) AS n_chars", *(f"'x' AS `{c}`" for c in clash))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
