import hashlib  # noqa: F401

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, value string, name string, kept string, size string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank texts, ties, repeated rows and columns whose names operators also use."""
    passage = " ".join(f"w{i}" for i in range(60)) + "."
    texts = [None, "", " \t\n", "one", "one two", passage, passage.replace(" ", "\t\n"), passage, "x " + passage, "token = abcdef0123456789abcdef01", "İ Ünïcode 😀 token=abcdef done.", "a b " * 3000]
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", i, "v", "n", "k", "z") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[1], (None, passage, "en", "s1", None, None, None, None, None), (20, passage, None, None, None, "v", "n", "k", "z")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


CLASHING = ["_w", "_ordered", "_lines", "_full", "_good", "_text", "_whole", "_stay", "_carried", "n_words", "base_failed", "clean_text", "_sha", "_id", "_own_hash", "_row_of_key", "keep_id", "copies", "text_hash", "mark", "root", "_row", "_size", "_taken", "_shard", "position", "chunk", "bucket"]


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """The odd rows with a column for each name that an operator uses inside, which holds its name and the row's value."""
    return odd.selectExpr("*", *(f"concat('{n}', value) AS {n}" for n in CLASHING))


def values_stay(row):
    """Whether a row's clashing columns, and those of the odd rows, are what they were."""
    plain = row.value is None or (row.value, row.name, row.kept, row["size"]) == ("v", "n", "k", "z")
    return plain and all(row[n] == (None if row.value is None else n + row.value) for n in CLASHING)
