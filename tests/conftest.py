import pytest

from engagement.session import local_session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture
def one(spark):
    """Value of an expression over one row of named texts."""

    def value(column, **fields):
        names = list(fields)
        row = spark.createDataFrame(
            [tuple(fields[n] for n in names)], ", ".join(f"{n} string" for n in names)
        )
        return row.select(column.alias("v")).first()["v"]

    return value
