import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from formulake.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session(cpus=4, shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf_dir():
    return SF
