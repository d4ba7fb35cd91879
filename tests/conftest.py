import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from parapet.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session(4, shuffle_partitions=4, app="tests", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=str(folder))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
