import pytest

from giurispark.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": tmp_path_factory.mktemp("checkpoints").as_posix()})
