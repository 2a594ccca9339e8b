import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Makes documents of (id, text) pairs, with columns whose names the operators use."""

    def make(rows, lang="en", source="s"):
        data = [(i, t, lang, source, None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(data, DOCUMENTS).repartition(3)

    return make


@pytest.fixture
def clashing(documents):
    """Documents with extra columns named like results."""

    def make(rows):
        df = documents(rows)
        for name in ("score", "shard", "slot", "ids", "kept", "removed", "fingerprint", "tokens", "n_words", "rule", "component_id", "licences", "Round"):
            df = df.selectExpr("*", f"'own' as {name}")
        return df

    return make


def rows_of(df):
    assert isinstance(df.schema, T.StructType)
    return sorted((tuple(r) for r in df.collect()), key=repr)
