import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark):
    """Rows as a documents table, with a column whose name clashes with the operators' own."""

    def make(rows, extra="kept"):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField(extra, T.StringType())])
        full = [(r + (None,) * 2)[:3] + ("x",) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame(full, schema)

    return make
