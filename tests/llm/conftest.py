from __future__ import annotations

import pytest

#: Nulls, empty and blank texts, ties, repeated rows, a very long text, and columns whose names clash with the operators' own.
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    words = "the quick brown fox jumps over the lazy dog while seven small boats sail past the old harbour wall at dawn and nobody hears them go"
    rows = [
        (1, words, "a", "en", 5), (2, words, "a", "en", 5), (2, words, "a", "en", 5), (3, None, "a", None, None), (4, "", None, "en", 0), (5, " \t\n ", "b", "en", 4), (None, words + " again", None, "fr", 1), (None, None, None, None, None),
        (6, LONG, "b", "en", 1), (7, words.replace("seven", "eight"), "b", "en", 9), (8, "éè \U0001f600 café", "c", "fr", 2), (9, "one", "c", "fr", 3), (2, "another text under a known number", "c", "fr", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return df.selectExpr("*", "'x' AS size", "1 AS copies", "2 AS fp", "'h' AS host", "0 AS th", "'k' AS kept", "7 AS piece", "'b' AS bucket", "'u' AS u", "3 AS items", "4 AS start")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
