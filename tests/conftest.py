import pytest

from settlespark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests", memory="8g")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Table from rows and a schema; columns named in ``times`` become instants."""
    def make(rows, schema, times=()):
        df = spark.createDataFrame(rows, schema)
        return df.withColumns({c: df[c].cast("timestamp") for c in times})
    return make
