import pytest
from llm_rows import SCHEMA, edge_texts, rows_of


@pytest.fixture(scope="session")
def texts():
    return edge_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
