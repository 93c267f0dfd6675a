import pytest

#: Extra columns have the names that operators use inside.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key long, name string, bucket long, label int, words string"


def rows(pairs, lang=None):
    return [(i, t, lang, "s", None if t is None else len(t), 1, "n", 2, 3, "w") for i, t in pairs]


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text) pairs, with further columns of clashing names."""
    return lambda pairs, lang=None: spark.createDataFrame(rows(pairs, lang), COLUMNS)


@pytest.fixture
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
