from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from oracle_util import SF001  # noqa: E402

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session
    # get_session keeps a configured spark.checkpoint.dir and only falls back
    # to a scratch folder when none is set
    s = get_session("local[4]", app="tessera-tests", shuffle_partitions=4,
                    extra={"spark.driver.memory": "8g"})
    yield s


@pytest.fixture(scope="session")
def t001(spark):
    from tessera.sources.fixtures import Tables
    return Tables(spark, SF001)


@pytest.fixture(scope="session")
def t01(spark):
    from tessera.sources.fixtures import Tables
    return Tables(spark, SF01)
