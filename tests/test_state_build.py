"""The state of a moment from what was known by then; its words; the compact form; ordered statistics; feeds and run records."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barloom.operators import records, state
from barloom.streaming import bars as stream

T0 = datetime(2025, 6, 2)


@pytest.fixture(scope="module")
def features(spark):
    rows = []
    for tf, hours, lean in (("1h", 1, 1), ("4h", 4, 1), ("1d", 24, -1)):
        for i in range(1, 73 // hours):
            up = lean if i * hours <= 48 else -lean
            rows.append(("A", tf, T0 + timedelta(hours=i * hours), 100.0, 100.0 - 4 * up, 100.0 - 5 * up, 100.0 - 6 * up, 50.0 + 20 * up, 30.0, 40.0))
    return spark.createDataFrame(rows, "asset string, timeframe string, known timestamp_ntz, close double, ema_21 double, sma_50 double, sma_200 double, rsi_14 double, adx double, realised_vol_20 double")


def at(*hours):
    return [("A", T0 + timedelta(hours=h)) for h in hours]


def test_each_timeframe_is_as_of_its_own_close(spark, features):
    asked = spark.createDataFrame(at(0, 3, 30, 49, 60), "asset string, as_of timestamp_ntz")
    got = {(r.as_of - T0) // timedelta(hours=1): r for r in state.build(features, asked).collect()}
    assert 0 not in got  # nothing was known
    assert got[3].timeframes == 1 and got[30].timeframes == 3
    one = {r.timeframe: r for r in state.classify(features).where(F.col("known") <= F.lit(T0 + timedelta(hours=30))).groupBy("timeframe").agg(F.max_by("direction", "known").alias("direction")).collect()}
    assert one["1h"].direction.endswith("up") and one["1d"].direction.endswith("down")
    assert got[30].interpretation.startswith("A ") and f"1d {one['1d'].direction}, 4h {one['4h'].direction}" in got[30].interpretation
    # after 48 hours the fast ones have turned, the day's feature is that of its last close
    assert got[49].bias_score < got[30].bias_score
    later = features.unionByName(features.where("known > timestamp_ntz'2025-06-03 06:00:00'").withColumn("known", F.col("known") + F.expr("INTERVAL 10 DAYS")).withColumn("close", F.lit(1.0)))
    again = state.build(later, asked).where("as_of <= timestamp_ntz'2025-06-04 12:00:00'").collect()
    assert {(r.as_of, r.bias_score, r.interpretation) for r in again} == {(r.as_of, r.bias_score, r.interpretation) for r in got.values()}


def test_trust_is_as_of_the_moment(spark, features):
    asked = spark.createDataFrame(at(20, 40), "asset string, as_of timestamp_ntz")
    trust = spark.createDataFrame([("A", tf, T0 + timedelta(hours=h), x) for tf in ("1h", "4h") for h, x in ((30, 0.5), (90, 0.1))], "asset string, timeframe string, ts timestamp_ntz, score double")
    plain, held = ({r.as_of: r for r in state.build(features, asked, t).collect()} for t in (None, trust))
    first, second = (T0 + timedelta(hours=h) for h in (20, 40))
    assert held[first].confidence == pytest.approx(plain[first].confidence) and held[second].confidence < plain[second].confidence * 0.75


def test_words_of_every_alignment(spark):
    def plain(alignment):
        high, low = "1d up, 4h weak_up — net bullish", "1h down"
        return {
            "pullback_in_uptrend": f"X is in a pullback within a larger uptrend: higher timeframes [{high}] are net constructive while lower timeframes [{low}] are correcting.",
            "rally_in_downtrend": f"X is rallying inside a larger downtrend: higher timeframes [{high}] are net negative while lower timeframes [{low}] are bouncing.",
            "possible_reversal": f"X may be turning: the higher-timeframe trend [{high}] is losing strength",
            "aligned_bullish": f"X is bullish across the hierarchy [{high}; {low}] in a bull regime.",
            "aligned_bearish": f"X is bearish across the hierarchy [{high}; {low}] in a bull regime.",
            "rangebound": f"X has no clear directional structure on any timeframe [{high}; {low}].",
            "conflicted": f"X shows conflicting signals without a clean hierarchy [{high}; {low}]. Bias reads up,",
            "insufficient_evidence": "X has no usable timeframe.",
        }[alignment]

    names = ["pullback_in_uptrend", "rally_in_downtrend", "possible_reversal", "aligned_bullish", "aligned_bearish", "rangebound", "conflicted", "insufficient_evidence"]
    group = "array<struct<timeframe:string,direction:string>>"
    rows = spark.createDataFrame([(n, [("4h", "weak_up"), ("1d", "up")], [("1h", "down")], []) for n in names], f"alignment string, high {group}, low {group}, none {group}")
    d = lambda c, net: state.described(F.col(c), F.lit(net))
    for r in rows.select("alignment", state.interpretation(F.lit("X"), F.col("alignment"), F.lit("bull"), F.lit("up"), d("high", 1), d("low", -1)).alias("text"), d("none", 0).alias("none")).collect():
        assert r.text.startswith(plain(r.alignment)) and r.none == "none"


def test_compact_state(spark):
    rows = [(100.0, 90.0, 80.0, 1.0), (100.0, 110.0, 120.0, -1.0), (100.0, 99.9, 99.9, -1.0), (100.0, 100.0, 100.0, None), (100.0, 90.0, 80.0, -1.0), (100.0, None, 80.0, 1.0)]
    got = state.compact(spark.createDataFrame(rows, "close double, ema_21 double, sma_200 double, structure_trend double")).collect()
    assert [(r.bias_score, r.agreement, r.alignment) for r in got] == [(1.0, 1.0, "aligned_bullish"), (-1.0, 1.0, "aligned_bearish"), (-0.189, 1.0, "aligned_bearish"), (0.0, 0.4, "rangebound"), (0.6, 0.4, "conflicted"), (None, None, None)]


def test_statistics_in_their_order(spark):
    rows = [("A", "x", 0.03, 0.05, True), ("A", "y", 0.01, -0.2, True), ("A", "z", 0.2, 0.5, False), ("A", "w", 0.1, 0.5, False), ("B", "x", 0.5, 0.0, False)]
    stats = spark.createDataFrame(rows, "asset string, kind string, p_value double, edge double, informative boolean")
    got = {(r.asset, r.kind): (r.place, r.place_in_group) for r in records.ranked_statistics(stats, ("asset",)).collect()}
    assert got == {("A", "y"): (1, 1), ("A", "x"): (2, 2), ("A", "w"): (3, 1), ("A", "z"): (4, 2), ("B", "x"): (1, 1)}
    assert [r.kind for r in records.ranked_statistics(stats, informative_only=True, first=1, asset="A").collect()] == ["y"]


def test_feeds_and_runs_are_recorded_once(spark, tmp_path):
    sink = stream.feed_sink(f"{tmp_path}/feed", 20)
    batch = spark.createDataFrame([("a", 30, ""), ("b", 10, ""), ("c", 40, "cooldown")], "title string, level int, held string")
    write = stream.recorded(sink, f"{tmp_path}/runs", "level >= 20", provider="venue")
    for n in (0, 1, 1):  # a replay
        write(batch, n)
    lines = [json.loads(x) for p in Path(f"{tmp_path}/feed").rglob("*.json") for x in p.read_text().splitlines()]
    assert [x["title"] for x in lines] == ["a", "a"]
    runs = spark.read.parquet(f"{tmp_path}/runs").orderBy("batch").collect()
    assert [(r.batch, r.read, r.accepted, r.rejected, r.error, r.provider) for r in runs] == [(n, 3, 2, 1, None, "venue") for n in (0, 1)] and all(r.seconds >= 0 for r in runs)

    def broken(rows, number):
        raise ValueError("no space")

    with pytest.raises(ValueError):
        stream.recorded(broken, f"{tmp_path}/runs")(batch, 2)
    assert spark.read.parquet(f"{tmp_path}/runs").where("batch = 2").head().error == "no space"
