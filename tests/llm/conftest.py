from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

#: Awkward rows: nulls, empty and blank texts, repeated rows, one id twice, a long text, special strings.
ROWS = [
    (5, "The quick brown fox jumps over the lazy dog. It does so every day!\nAnd again."),
    (1, "The quick brown fox jumps over the lazy dog. It does so every day!\nAnd again."),
    (2, ""),
    (3, None),
    (None, "A text without an id."),
    (7, "   \n\t "),
    (8, "é́ combining, 日本語テキスト — don't I'LL 123 <|endoftext|> x"),
    (8, "é́ combining, 日本語テキスト — don't I'LL 123 <|endoftext|> x"),
    (9, "word " * 5000),
    (10, "one"),
    (12, "Licensed under the Apache License, Version 2.0.\nTo be or not to be, that is the question here."),
]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return ROWS


@pytest.fixture(scope="session")
def docs(spark: SparkSession) -> DataFrame:
    """The rows, with further columns whose names operators use within."""
    shape = "doc_id long, text string, fp long, window string, size string, shard string, anchor string"
    return spark.createDataFrame([(i, t, 1, "w", "s", "x", "a") for i, t in ROWS], shape).repartition(3)


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))
