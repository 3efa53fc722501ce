import pytest
from pyspark.sql import types as T


@pytest.fixture
def table(spark):
    """Builds a DataFrame from rows and a schema string."""

    def build(rows, schema):
        return spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], T._parse_datatype_string(schema))

    return build
