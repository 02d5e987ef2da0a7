from __future__ import annotations

import pytest
from pyspark.sql import functions as F

COLUMNS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
           # Names that operators use inside.
           "size bigint, hash string, row string, fp bigint, key string, shard string, slot string, _rid string, "
           "_slot string, _score string, _clean string, _spans string, record string, spans string, label string")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names clash with internal ones; rows are ``(doc_id, text, source)``."""
    def make(rows):
        width = len(COLUMNS.split(","))
        full = [(i, t, "en", s, None if t is None else len(t), *[None] * (width - 5)) for i, t, s in rows]
        return spark.createDataFrame(full, COLUMNS)
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return [
        (1, "one two three four five", "a"), (1, "one two three four five", "a"), (2, "one two three four five", "b"),
        (None, "no id here at all", None), (None, None, None), (None, None, None), (3, None, "a"), (4, "", "a"),
        (5, "  \n\t ", "b"), (6, "x", None), (7, "long " * 60_000, "a"), (8, "äöü ñ 漢字 " * 50, "b"),
        (9, "y" * 200_000, ""), (10, "\x00 zero byte İK ſ", "a"),
    ]


@pytest.fixture(scope="session")
def edge_docs(make_docs, edge_rows):
    return make_docs(edge_rows)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where(F.lit(False))
