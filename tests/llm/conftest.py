import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from (doc_id, text, source) tuples."""

    def make(rows, extra=()):
        schema = T.StructType([*DOC_SCHEMA.fields, *(T.StructField(n, T.StringType()) for n in extra)])
        full = [(i, t, "en", s, None if t is None else len(t), *("x" for _ in extra)) for i, t, s in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def label_dir(spark, tmp_path_factory):
    """A folder with a labels table of (doc_id, quality, toxic) rows."""

    def make(rows):
        path = str(tmp_path_factory.mktemp("sf"))
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        return path

    return make
