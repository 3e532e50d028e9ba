import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from verdict.session import build_session
    # Catalog tables of the tests go to a private folder, not the working tree.
    s = build_session("local[4]", shuffle_partitions=8, extra={
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="verdict-warehouse-")})
    # Tests own their scratch folder only when the session names none.
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="verdict-test-"))
    yield s


@pytest.fixture()
def scratch(spark):
    from verdict.session import scratch_dir
    return scratch_dir(spark, "test")
