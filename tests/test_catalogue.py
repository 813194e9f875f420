import datetime
import os
import random

import pytest
from oracle import compare

from evalloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, name):
    got, want = compare(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], FOLDER)
    assert got == want


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_rows_without_sql(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("case", ["no events", "just above zero"])
def test_macro_f1_as_sql(spark, tmp_path, case):
    """Without a unit; and one user of 3,000 days whose interval (0.00000035) rounds to zero."""
    for name in os.listdir(FOLDER):
        if name != "events.parquet":
            os.symlink(f"{FOLDER}/{name}", tmp_path / name)
    views = random.Random(12907).getrandbits(3_000)
    days = [datetime.datetime(2016, 1, 1) + datetime.timedelta(i) for i in range(3_000)]
    rows = [(1, d, k) for i, d in enumerate(days) for k in ("click", "view") if k == "click" or views >> i & 1]
    spark.createDataFrame([] if case == "no events" else rows, "user_id long, ts timestamp_ntz, event_type string").coalesce(1).write.parquet(f"file://{tmp_path}/events")
    (part,) = (tmp_path / "events").glob("*.parquet")
    os.rename(part, tmp_path / "events.parquet")
    name = "macro_f1_bootstrap"
    got, want = compare(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], str(tmp_path))
    assert got == want
