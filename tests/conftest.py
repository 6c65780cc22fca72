import pytest

from tests.oracle_check import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield spark
    spark.stop()
