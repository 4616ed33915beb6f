import pytest


@pytest.fixture(scope="session")
def save(spark, tmp_path_factory):
    """Writes rows as a table of a new folder and returns the folder."""

    def write(name, rows, schema, folder=None):
        folder = folder or str(tmp_path_factory.mktemp("tables"))
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write
