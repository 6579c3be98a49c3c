import pytest
from cases import DOCS, HARD, docs_of


@pytest.fixture(scope="session")
def hard(spark):
    """Texts that break things, null and repeated ids, and columns whose names operators use themselves."""
    extra = spark.createDataFrame([(None, "no id", None, None, None, None, None), (3, "a", "en", "s0", 1, 7, 9)], DOCS)
    return docs_of(spark, HARD).unionByName(extra).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
