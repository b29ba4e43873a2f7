import os
import shutil
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

FIXTURES = os.path.join(ROOT, "tests", "fixtures")
LAND = os.path.join(FIXTURES, "land")
SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from hourbook.session import checkpoint_dir, get_spark
    s = get_spark("local[*]", app_name="hourbook-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s


@pytest.fixture()
def scratch():
    """A fresh folder per test (never reused)."""
    return tempfile.mkdtemp(prefix="hourbook-test-")


@pytest.fixture()
def land_copy(scratch):
    """A private copy of the landed fixture exports."""
    dst = os.path.join(scratch, "land")
    shutil.copytree(LAND, dst)
    return dst
