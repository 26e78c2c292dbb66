import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lutrin.session import build_session

    cores = os.environ.get("LUTRIN_TEST_CORES", "8")
    session = build_session(f"local[{cores}]", shuffle_partitions=8, shared=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("LUTRIN_TEST_SF", "/root/testdata/sf0.001")
