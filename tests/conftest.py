import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from panelmill.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "tests", cores=4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__driver__memory="4g"
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
