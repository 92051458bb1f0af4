import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture()
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    further columns with names that the operators use themselves."""
    rows = [(1, "", "x", 9, "a"), (2, None, None, None, None), (3, "one", "x", 1, "b"), (None, "no id at all here", "x", 2, "c"),
            (None, None, None, None, None), (4, "word " * 30_000, "x", 3, "d"), (5, "same text in two rows, it is", "x", 4, "e"),
            (6, "same text in two rows, it is", "x", 4, "e"), (7, " \t\n\r  ", "x", 5, "f"), (8, "Ünïcode – ß 中文 🙂 <|endoftext|> x", "x", 6, "g"),
            (9, "the  \n   end\x1c of\xa0it", "x", 7, "h")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, length long, block string")


@pytest.fixture()
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
