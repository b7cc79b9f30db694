import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts; doc_id counts from 0."""

    def make(texts, first=0):
        rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def table_dir(spark, tmp_path_factory):
    """A folder with a documents table of the given frame, as the queries read it."""

    def make(df, name="documents"):
        path = str(tmp_path_factory.mktemp("tables"))
        df.write.parquet(f"{path}/{name}.parquet")
        return path

    return make
