"""Prices of 0: levels at 0, queries on structure and feature vectors beside their SQL, all over events of few hours."""

import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from barloom import plans


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Hourly events of three assets: prices now and then 0 before others in their hour, a price that stays, and no price but 0 for some hours."""
    rng, start, rows = random.Random(7), datetime(2024, 1, 1), []
    for asset in ("some", "flat", "none"):
        for hour in range(290):
            price = {"some": round(10 + hour % 7 + rng.random() * 3, 2), "flat": 4.0, "none": 5.0 + hour % 3}[asset]
            if asset == "some" and hour % 20 == 10:
                rows.append((asset, start + timedelta(hours=hour, minutes=9), 0.0))
                rows.append((asset, start + timedelta(hours=hour, minutes=3), 1.0))
            if asset == "none" and 20 <= hour < 30:
                price = 0.0
            rows.append((asset, start + timedelta(hours=hour, minutes=30), price))
    d = tmp_path_factory.mktemp("zeros")
    e = pd.DataFrame([(i, t, i % 5, a, v, '{"k": 1}') for i, (a, t, v) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    e.astype({"ts": "datetime64[us]"}).to_parquet(d / "events.parquet")
    return str(d)


def both(spark, sf, name):
    """Rows of the query and of its SQL, sorted; NaN as text, as it equals nothing."""
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    plain = lambda rows: sorted((tuple("nan" if x != x else x for x in r) for r in rows), key=repr)
    return plain(plans.queries()[name](spark, sf).collect()), plain(c.execute(plans.oracle_sql()[name]).fetchall())


def test_levels_at_zero(spark, zeros):
    got, sql = both(spark, zeros, "price_levels")
    assert got == sql
    assert [x[2] for x in got if x[:2] == ("some", 0.0)] == [14]


def test_structure_with_prices_of_zero(spark, zeros):
    rows = plans.queries()["market_structure"](spark, zeros).collect()
    assert len(rows) == 3 * 35 and all(r.support is None or r.support >= 0 for r in rows)
    assert any(r.support == 0 and r.asset == "some" for r in rows)
    assert all(r.poc is None and r.trend == 0 and r.n_levels == 0 for r in rows if r.asset == "flat")


def test_trend_with_prices_of_zero(spark, zeros):
    got, sql = both(spark, zeros, "structure_trend")
    assert got == sql and len(got) == 3 * 290


def test_vectors_with_prices_of_zero(spark, zeros):
    got, sql = both(spark, zeros, "feature_vectors")
    assert got == sql and len(got) == 3 * 91
    assert [x[3] for x in got if x[0] == "some" and x[3] == float("inf")] == [float("inf")] * 4


def test_columns_with_prices_of_zero(spark, zeros):
    got, sql = both(spark, zeros, "feature_columns")
    held = [(a, b) for a, b in zip(got, sql, strict=True) if a[0] == "some"]
    assert len(got) == 3 * 91 and all(a == b for a, b in held)
    assert sum(x == float("inf") for a, _ in held for x in a) == 4


def test_states_with_prices_of_zero(spark, zeros):
    got, sql = both(spark, zeros, "compact_states")
    assert got == sql and len(got) == 3 * 91


def test_market_state_with_prices_of_zero(spark, zeros):
    rows = plans.queries()["market_state"](spark, zeros).collect()
    assert len({(r.asset, r.as_of) for r in rows}) == len(rows) == 3 * 13
