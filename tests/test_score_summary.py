"""The summary of scores beside its SQL, also when there are none."""

from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from barloom import plans


@pytest.mark.parametrize(("hours", "row"), [(range(30), ("events", None, None, 0, "", "")), ((0, *range(9, 400, 9)), ("events", 0.1, 0.1, 2, "a/1h,a-b/1h", "a/1h,a-b/1h"))])
def test_score_summary(spark, tmp_path, hours, row):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=h), a, 1.0) for i, (a, h) in enumerate((a, h) for a in ("a", "a-b") for h in hours)]
    pd.DataFrame(rows, columns=["event_id", "ts", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in plans.queries()["score_summary"](spark, str(tmp_path)).collect()]
    assert got == c.execute(plans.oracle_sql()["score_summary"]).fetchall() == [row]
