"""A small documents table with every awkward case, and whole driver tables at the smallest scale."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, id string, comp int, size string, row int"


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("driver tables are not here")
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, columns whose names clash with outputs."""
    words = "the quick brown fox jumps over the lazy dog while nine more small animals look on and wait for their turn".split()
    long = " ".join(f"{words[i % 21]}{i % 997}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 3), (4, long, "en", "a", len(long)),
        (5, " ".join(words), "en", "b", 1), (5, " ".join(words), "en", "b", 1), (6, " ".join(words), "en", None, 1), (7, " ".join(words[:20]) + " end", "en", "b", 1),
        (None, " ".join(words), "en", "b", 1), (8, "mail ann@example.org or +49 170 1234567", "de", "c", 1), (8, "other text of the same id here", "de", "c", 1),
        (9, "x\0y ퟿ \U0001f600 ÀÉ ﬁ", "fr", "c", 1), (10, "word", "fr", "c", 4), (11, "12345 !!! ???", "fr", "c", 1),
    ]
    return spark.createDataFrame([(*r, "s", "k", "i", 7, "z", 1) for r in rows], SCHEMA)
