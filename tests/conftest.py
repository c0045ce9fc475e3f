import pytest

from mnemospark.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("tests", cpus=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
