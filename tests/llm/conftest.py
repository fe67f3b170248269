from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k0 string, t string, sid long, n int, token long, score double, rid int, `key` string, id string, word string, range int, ids string, c string, copies int"
LONG = " ".join(f"Word{k % 997} and {k}" for k in range(60_000))


def rows_of(*pairs):
    """Rows of documents with columns whose names clash with those that operators make up."""
    return [(i, t, None, s, None if t is None else len(t), "x", "y", 1, 2, 3, 0.5, 4, "z", "i", "w", 5, "q", "c", 6) for i, t, s in pairs]


EDGE = [
    (5, "The quick brown fox jumps over the lazy dog and runs away", "a"),
    (5, "The quick brown fox jumps over the lazy dog and runs away", "a"),
    (7, "the QUICK brown fox jumps over the lazy dog and runs away", "b"),
    (None, "a null id with some words in it", None),
    (None, None, None),
    (9, None, "b"),
    (11, "", "b"),
    (13, " \t\n\r\x0b\x0c ", "a"),
    (15, "two words", "a"),
    (17, "😀 é ▁ \x00 \x1c x", "c"),
    (19, LONG, "a"),
    (21, "x" * 30_000, "c"),
    (-3, "line\nline\nline\n\nline", "c"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows_of(*EDGE), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def piece_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def word_bpe():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def sample(n=400, table="documents"):
    """(doc_id, text, source) of the smallest documents, with edited copies of some."""
    import duckdb

    rows = duckdb.sql(f"select doc_id, text, source from '/root/testdata/sf0.001/{table}.parquet' order by doc_id limit {n}").fetchall()
    return rows
