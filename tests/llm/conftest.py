import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

import os  # noqa: E402

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def sf_dir_medium():
    return os.environ.get("TEST_SF_MEDIUM", "/root/testdata/sf0.01")
