"""Look-ahead planted in every forecaster is found at every point; without it none is."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import backtest, probe
from barloom.sources.bars import BAR

T0 = datetime(2025, 6, 2)
H = 6


def walk(asset, n, seed):
    rng, close, out = random.Random(seed), 100.0, []
    for i in range(n):
        before, close = close, close * (1 + rng.gauss(0, 0.01))
        out.append((asset, "s", "1h", T0 + timedelta(hours=i), before, max(before, close) * 1.002, min(before, close) * 0.998, close, float(rng.randint(5, 50)), 1.0, 9, True))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk("A", 640, 1) + walk("B", 600, 2), BAR).cache()


@pytest.fixture(scope="module")
def times(bars):
    return probe.probe_times(bars, H).cache()


def ahead(*columns):
    """Every row gets the values of two rows later."""

    def altered(copies, key):
        order = Window.partitionBy(*key).orderBy("ts" if "ts" in copies.columns else "open_time")
        return copies.withColumns({c: F.coalesce(F.lead(c, 2).over(order), F.col(c)) for c in columns})

    return altered


def verdicts(said):
    return {r.model: r for r in backtest.leak_verdict(probe.responses(said)).collect()}


def test_points_are_spread_over_the_whole_range(spark, bars, times):
    series = spark.createDataFrame([("long", 1000), ("just", 432), ("short", 100), ("tiny", 2), ("none", 1)], "asset string, n long")
    got = {}
    for r in backtest.probe_points(series, H).collect():
        got.setdefault(r.asset, []).append((r.probe, r["at"]))
    assert sorted(got["long"]) == [(i, int(400 + i * (593 / 25))) for i in range(25)]
    assert sorted(x for _, x in got["just"]) == list(range(400, 425)) and sorted(x for _, x in got["short"]) == [int(50 + i * 49 / 25) for i in range(25)]
    assert "tiny" not in got and "none" not in got
    at = sorted(r["at"] for r in times.collect())
    assert len(at) == 25 and at[0] == T0 + timedelta(hours=401) and at[-1] == T0 + timedelta(hours=int(400 + 24 * 233 / 25) + 1)


def test_copies_differ_on_one_side_and_stay_valid(bars, times):
    rows = probe.corrupted_bars(probe.copied(bars, times, F.col("open_time") + F.expr("INTERVAL 1 HOUR"))).where("probe = 3")
    keyed = {}
    for r in rows.collect():
        keyed.setdefault(r.side, {})[r.asset, r.open_time] = r
        assert r.high >= max(r.open, r.close) and r.low <= min(r.open, r.close) and r.low > 0
    assert set(keyed) == set(probe.SIDES) and len({len(x) for x in keyed.values()}) == 1
    for key, was in keyed["as_is"].items():
        late = was.open_time + timedelta(hours=1) > was["at"]
        assert (keyed["after"][key].close != was.close) == late and (keyed["before"][key].close != was.close) == (not late)


def test_honest_forecasters_are_clean_and_leaky_ones_are_caught(bars, times):
    honest = verdicts(probe.bar_forecasts(bars, times, H, before=220))
    assert {m: r.verdict for m, r in honest.items()} == {m: "inconclusive" if m == "baseline_uniform" else "clean" for m in ("baseline_climatology", "baseline_persistence", "baseline_uniform", "technical", "timeseries", "crossasset")}
    points = 25 + sum(r["at"] <= T0 + timedelta(hours=600) for r in times.collect())
    assert all(r.points == points and r.leaks == 0 for r in honest.values())
    leaky = verdicts(probe.bar_forecasts(bars, times, H, before=220, altered=ahead("open", "high", "low", "close", "volume")))
    assert {m for m, r in leaky.items() if r.verdict == "leaking"} == set(honest) - {"baseline_uniform"}
    assert all(2 * leaky[m].leaks > points for m in ("technical", "timeseries", "crossasset", "baseline_persistence"))


def test_stored_features_and_rates_are_corrupted_themselves(spark, bars, times):
    assert verdicts(probe.feature_forecasts(bars, times))["technical of stored features"].verdict == "clean"
    found = verdicts(probe.feature_forecasts(bars, times, altered=ahead("close", "ema_21", "rsi_14")))["technical of stored features"]
    assert found.verdict == "leaking" and found.leaks == found.points > 45
    rates = bars.where("asset = 'A'").select("asset", F.col("open_time").alias("ts"), (F.col("close") - F.col("open")).alias("rate"))
    assert verdicts(probe.rate_forecasts(rates, times))["orderflow"].verdict == "clean"
    assert verdicts(probe.rate_forecasts(rates, times, altered=ahead("rate")))["orderflow"].verdict == "leaking"
