import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) pairs, or with source as a third value."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def sample():
    """Text, language and source of real documents of the smallest table, or a skip."""
    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.001/documents.parquet"
    try:
        return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{path}' ORDER BY doc_id").fetchall()
    except duckdb.IOException:
        pytest.skip("no tables")
