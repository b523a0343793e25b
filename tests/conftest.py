import pytest

from tidewater.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cores=4, memory="4g")


@pytest.fixture
def few_partitions(spark):
    """For tests of many small jobs over few rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
