import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t string, rn int, key string, h long, size int, w double, kept string"


@pytest.fixture
def make_docs(spark):
    """Documents with extra columns whose names the operators use inside."""

    def make(rows):
        full = [(*r[:4], *([None] * (4 - len(r[:4]))), len(r[1] or ""), "x", 1, "k", 2, 3, 4.0, "y") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def long_text():
    return " ".join(f"word{i % 977} thing{i % 13}" for i in range(20_000))


@pytest.fixture
def rows_of():
    def get(df, key="doc_id"):
        return sorted(df.collect(), key=lambda r: (r[key] is None, r[key]))

    return get


def lit(x):
    return F.lit(x)
