from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def texts(spark):
    """A table ``doc_id, text`` with more columns whose names clash with those of operators."""

    def make(rows: list[tuple]) -> DataFrame:
        return spark.createDataFrame(
            [(i, t, "x", 1, "y", 2.0) for i, t in rows],
            "doc_id bigint, text string, found string, n int, spans string, score double",
        )

    return make


#: Nulls, empty and blank texts, one very long text, ties and repeated rows.
ODD = [(None, "a lone text"), (1, None), (2, ""), (3, " \n "), (4, "word " * 30000), (5, "the sea is blue and calm"),
       (6, "the sea is blue and calm"), (6, "the sea is blue and calm"), (7, "日本語 é")]


@pytest.fixture
def odd(texts):
    return texts(ODD)


@pytest.fixture
def empty(texts):
    return texts([])
