import pytest

DOCUMENTS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)
    return make


@pytest.fixture
def sf(spark, tmp_path):
    """A folder with the given tables as a query reads them."""
    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return make
