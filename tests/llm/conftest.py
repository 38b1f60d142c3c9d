import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"

#: Nulls, empty and long texts, ties and repeated rows; names that clash with inner and result columns.
ODD_TEXTS = [
    (None, None, None, None),
    (None, "one two three four five", "en", "a"),
    (1, "", "en", "a"),
    (1, "", "en", "a"),
    (2, " \t\n ", None, None),
    (3, "Same text, twice. " * 40, "fr", "b"),
    (4, "Same text, twice. " * 40, "fr", "b"),
    (5, "long" * 60_000, "en", ""),
    (6, "word " * 30_000, "en", "a"),
    (7, "\x00 \x1c � 日本語 🎉 ́", "xx", "a"),
    (3, "another text of id three", "fr", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*row, None if k % 3 else k, "x", k, "y", "z") for k, row in enumerate(ODD_TEXTS)]
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, rid int, key string, fp string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
