"""Bodies of derivative endpoints, the first provider that answers, and a user's own indicators and folds."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import columns, store
from barloom.sources import derivatives
from tests.test_probe import T0, walk

BODIES = "provider string, asset string, body string, fetched_at timestamp_ntz"
AT = datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, AT) for r in rows], BODIES)


def test_funding_and_interest_bodies(spark):
    ms = 1_735_689_600_000
    good = json.dumps([{"symbol": "X", "fundingTime": ms, "fundingRate": "0.0001", "markPrice": "97.5"}, {"fundingTime": ms + 1, "fundingRate": "-2e-4", "markPrice": ""}, {"fundingTime": ms + 2, "fundingRate": "0"}])
    bad = ['{"code": -1}', "not json", '[{"fundingTime": 5}]', '[{"fundingRate": "x", "fundingTime": 1}]', "[null]", None]
    got = derivatives.funding(frame(spark, [("f", "A", good)] + [("f", f"B{i}", b) for i, b in enumerate(bad)] + [("f", "C", "[]")]))
    by = {r.asset: r for r in got.collect()}
    assert [tuple(p) for p in by["A"].points] == [(AT, 0.0001, 8.0, 97.5), (AT + timedelta(milliseconds=1), -0.0002, 8.0, None), (AT + timedelta(milliseconds=2), 0.0, 8.0, None)]
    assert [by[f"B{i}"].error for i in range(6)] == ["unexpected funding payload"] * 2 + ["malformed funding row"] * 3 + ["unexpected funding payload"]
    assert by["C"].points == [] and by["C"].error is None and all(by[f"B{i}"].points is None for i in range(6))
    (oi,) = derivatives.open_interest(frame(spark, [("f", "A", json.dumps([{"timestamp": ms, "sumOpenInterest": "10.5", "sumOpenInterestValue": "900"}]))])).collect()
    assert tuple(oi.points[0]) == (AT, 10.5, 900.0) and oi.error is None


def test_global_bodies(spark):
    data = {"market_cap_percentage": {"btc": 55.5, "usdt": 4.0, "usdc": 1.5}, "total_market_cap": {"usd": 3e12}, "total_volume": {"eur": 1}, "updated_at": 1_735_689_600}
    got = derivatives.global_metrics(frame(spark, [("g", "1", json.dumps({"data": data})), ("g", "2", json.dumps({"data": {}})), ("g", "3", '{"data": []}'), ("g", "4", "[]")])).orderBy("asset").collect()
    assert tuple(got[0].points[0]) == (AT, 55.5, None, 3e12, None, 5.5) and tuple(got[1].points[0]) == (AT, None, None, None, None, None)
    assert [r.error for r in got[2:]] == ["unexpected global payload"] * 2


def test_the_first_provider_that_answers(spark):
    ok = lambda rate: json.dumps([{"fundingTime": 0, "fundingRate": rate}])
    rows = [("one", "A", "broken"), ("two", "A", ok("2")), ("three", "A", ok("3")), ("one", "B", ok("1")), ("two", "B", "broken"), ("one", "C", "broken"), ("four", "C", ok("4"))]
    points, attempts = derivatives.first_capable(derivatives.funding(frame(spark, rows)), ("one", "two", "three"))
    assert sorted((r.asset, r.source, r.rate) for r in points.collect()) == [("A", "two", 2.0), ("B", "one", 1.0)]
    assert sorted((r.asset, r.provider, r.chosen) for r in attempts.collect()) == [("A", "one", False), ("A", "two", True), ("B", "one", True), ("C", "one", False)]
    held = store.upsert(points.limit(0), points, ("asset", "source", "ts"))
    assert store.upsert(held, points.withColumn("rate", F.lit(9.0)), ("asset", "source", "ts")).agg(F.sum("rate")).head()[0] == 18.0


def test_own_indicators_join_the_plan(spark):
    from barloom.sources.bars import BAR

    bars = spark.createDataFrame(walk("A", 60, 1) + walk("B", 30, 2), BAR)
    if "test_lagged" not in columns.registered():
        columns.indicator("test_lagged", ("close",), 4)(lambda order: F.col("close") - F.lag("close", 3).over(order))
    with pytest.raises(ValueError, match="is registered"):
        columns.indicator("test_lagged", ("close",))(lambda order: F.col("close"))
    out = columns.with_indicators(bars, "range_share_mean", "test_lagged", "range_share")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    got = {(r.asset, (r.open_time - T0) // timedelta(hours=1)): r for r in out.collect()}
    close = [r[7] for r in walk("A", 60, 1)]
    assert got["A", 2].test_lagged is None and got["A", 3].test_lagged == pytest.approx(close[3] - close[0])
    assert got["A", 18].range_share is None and 0 <= got["A", 19].range_share <= 1 and got["A", 22].range_share_mean is None
    assert got["B", 25].range_share_mean == pytest.approx(sum(got["B", i].range_share for i in range(21, 26)) / 5)
    assert columns.warmup("range_share_mean", "test_lagged") == 24
    with pytest.raises(ValueError, match="unknown inputs: high"):
        columns.with_indicators(bars.drop("high"), "range_share")


class Streak:
    """How many closes in a row have risen."""

    def __init__(self):
        self.last, self.n = None, 0

    def update(self, row):
        self.n = self.n + 1 if self.last is not None and row["close"] > self.last else 0
        self.last = row["close"]
        return row["asset"], row["i"], self.n


def test_own_folds_are_table_functions(spark):
    columns.register_folds(spark, {"streak": (Streak, "asset string, i int, n int")})
    rows = [(a, i, float(c)) for a, cs in (("A", (1, 2, 3, 2, 5)), ("B", (9, 8, 9, 10, 10))) for i, c in enumerate(cs)]
    spark.createDataFrame(rows, "asset string, i int, close double").repartition(3).createOrReplaceTempView("own_closes")
    got = spark.sql("SELECT * FROM streak(TABLE(own_closes) PARTITION BY asset ORDER BY i)").collect()
    assert sorted((r.asset, r.i, r.n) for r in got) == [("A", 0, 0), ("A", 1, 1), ("A", 2, 2), ("A", 3, 0), ("A", 4, 1), ("B", 0, 0), ("B", 1, 0), ("B", 2, 1), ("B", 3, 2), ("B", 4, 0)]


def test_measured_impact_of_an_asset_else_of_any(spark):
    from barloom.operators import universe

    tests = "asset string, category string, horizon int, test string, events long, median_ratio double, verdict string"
    measured = spark.createDataFrame([("BTC", "etf", 6, "elevated", 40, 2.0, None), ("BTC", "etf", 6, "directional", 40, 2.0, "moves direction"), ("ANY", "etf", 24, "elevated", 30, 1.5, "moves volatility"), ("ANY", "macro", 6, "elevated", 10, 9.0, "moves volatility")], tests)
    events = spark.createDataFrame([(a, c, 0.5, 0.4) for a in ("BTC", "ETH") for c in ("etf", "macro")], "asset string, category string, importance double, confidence double")
    got = {(r.asset, r.category): (r.volatility_multiple, r.expected_hours, r.measured, r.direction_bias != 0, r.sureness) for r in universe.impact_estimates(events, measured).collect()}
    assert got["BTC", "etf"] == (2.0, 6.0, True, True, 0.5) and got["ETH", "etf"] == (1.5, 24.0, True, False, 0.5)
    assert not got["BTC", "macro"][2] and not got["ETH", "macro"][2] and got["ETH", "macro"][4] == 0.23
    words = {(r.asset, r.category, r.horizon): r.verdict for r in universe.impact_verdicts(measured).collect()}
    assert words == {("BTC", "etf", 6): "moves price directionally", ("ANY", "etf", 24): "precedes elevated volatility, direction unpredictable", ("ANY", "macro", 6): "insufficient evidence (10 events, need 25)"}


def test_tables_are_made_once_and_events_appended(spark, tmp_path):
    for _ in range(2):
        store.create_table(spark, "own_log", "asset string, day date", ("day",))
    spark.sql("INSERT INTO own_log VALUES ('A', DATE '2025-01-01')")
    store.create_table(spark, "own_log", "asset string, day date", ("day",))
    assert spark.table("own_log").collect()[0].asset == "A"
    spark.sql("DROP TABLE own_log")
    events = spark.createDataFrame([(AT, "x" * 3000), (AT + timedelta(days=1), None)], "detected_at timestamp_ntz, message string")
    for _ in range(2):
        store.append_events(events, f"{tmp_path}/log", 100)
    got = spark.read.parquet(f"{tmp_path}/log")
    assert got.count() == 4 and {len(r.message or "") for r in got.collect()} == {0, 100} and got.select("day").distinct().count() == 2
