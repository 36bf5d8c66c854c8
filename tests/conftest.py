import os

import pytest

os.environ.setdefault("SHUFFLE_PARTITIONS", "4")


@pytest.fixture(scope="session")
def spark():
    from docweave.testing import local_session

    return local_session("4", "6g")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
