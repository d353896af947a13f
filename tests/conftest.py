import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tokenloom.session import clean_staging, local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    ship_package(session)
    yield session
    clean_staging(session)
    session.stop()


@pytest.fixture()
def many_ranges(spark):
    """Keep small shuffles split, so that running totals really cross ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
