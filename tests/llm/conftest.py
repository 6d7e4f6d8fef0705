import os
from pathlib import Path

import pytest

DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))
SMALL = str(DATA / "sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, class long, packed string"
#: Documents with nulls, empty and blank texts, repeats, a long one, non-ASCII text, special tokens, and columns of clashing names.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 5, "k", 1, "p"),
    (2, "alpha beta  gamma\tdelta epsilon zeta eta theta iota kappa\n", "en", "a", 5, "k", 1, "p"),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "a", 0, "k", 1, "p"),
    (5, " \n\t ", "fr", None, 0, "k", 1, "p"),
    (5, " \n\t ", "fr", None, 0, "k", 1, "p"),
    (None, "null id words", "en", "b", 3, "k", 1, "p"),
    (6, "word " * 30_000, "en", "b", 1, "k", 1, "p"),
    (7, "é ß Ünï İ ﬁ <|endoftext|> 123 日本語 😀", "de", "c", 1, "k", 1, "p"),
    (8, "Alpha BETA gamma", "en", "c", 1, "k", 1, "p"),
    (9, "alpha beta gamma", "en", "c", 1, "k", 1, "p"),
    (10, "...!!! 12345", "en", "c", 1, "k", 1, "p"),
    (-3, "x" * 5000, None, "d", 1, "k", 1, "p"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r for r in documents.collect()}
