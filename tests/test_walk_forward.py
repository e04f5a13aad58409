"""Models of analogues and of other inputs in the walk-forward: as of each point, and abstaining without evidence."""

import math
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import models, similarity
from barloom.operators.indicators import recursive, windowed
from barloom.sources.bars import BAR
from tests.test_probe import T0, walk

H = 6


@pytest.fixture(scope="module")
def bars(spark):
    """Days that resemble each other."""
    rows, close = [], 100.0
    for i, r in enumerate(walk("A", 640, 1)):
        before, close = close, 100 + 8 * math.sin(i * math.pi / 12) + (r[7] - r[4]) * 0.3
        rows.append((*r[:4], before, max(before, close) * 1.002, min(before, close) * 0.998, close, *r[8:]))
    return spark.createDataFrame(rows, BAR).cache()


@pytest.fixture(scope="module")
def said(spark, bars):
    flow = spark.createDataFrame([("A", T0 + timedelta(hours=h), (u, 0.34, 0.66 - u), c) for h, u, c in ((300, 0.5, 0.2), (400, 0.2, 0.4))], "asset string, ts timestamp_ntz, p struct<up:double,flat:double,down:double>, confidence double")
    return models.walk_forward(bars, H, others={"orderflow": flow}).cache()


def test_every_model_speaks_at_every_point(said):
    n = {r.model: r.n for r in said.groupBy("model").agg(F.count("*").alias("n")).collect()}
    assert set(n) == {"baseline_climatology", "baseline_persistence", "baseline_uniform", "technical", "timeseries", "crossasset", "similarity", "orderflow"}
    assert set(n.values()) == {len([b for b in range(200, 640, H) if b + H < 640])}


def test_other_inputs_are_read_as_of_the_point(said):
    for r in said.where("model = 'orderflow'").collect():
        closed = (r.as_of - T0) / timedelta(hours=1) + 1
        want = (0.0, 1 / 3) if closed < 300 else (0.2, 0.5) if closed < 400 else (0.4, 0.2)
        assert (r.confidence, r.p.up) == pytest.approx(want)


def test_analogues_speak_once_there_is_history(bars, said):
    f = recursive(windowed(bars, "1h")).withColumn("bar", F.col("bars_seen") - 1).cache()
    asked = f.where((F.col("bar") >= 399) & ((F.col("bar") - 200) % H == 0)).select(*similarity.KEY, "bar")
    found = {r.asked: r for r in similarity.verdicts(similarity.analogues(f, asked, H), bars, H).collect()}
    spoke = 0
    for r in said.where("model = 'similarity'").collect():
        bar = int((r.as_of - T0) / timedelta(hours=1))
        v = found.get(bar)
        if v is None or v.n < 20:
            assert r.confidence == 0 and r.p.up == pytest.approx(1 / 3)
            continue
        spoke += 1
        edge = math.tanh((v.up_rate - v.base_rate) * 4) * 0.6
        assert r.p.up == pytest.approx(0.66 * (0.5 + edge / 2)) and r.confidence == pytest.approx(0.2 + min(0.35, v.n / 400))
    assert spoke > 10 and all(b >= 399 for b in found)


def test_analogues_don_t_see_ahead(bars):
    """The forecasts up to a moment stay as they are when everything after it is replaced."""
    cut = T0 + timedelta(hours=560)
    wild = bars.withColumns({c: F.when(F.col("open_time") >= F.lit(cut), F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    kept = (F.col("bar") - 200) % H == 0
    both = [models.similar(b, models.contexts(b, H), kept, H).where(F.col("open_time") < F.lit(cut)).select("open_time", "p", "confidence").orderBy("open_time").collect() for b in (bars, wild)]
    assert both[0] == both[1] and any(r.confidence > 0 for r in both[0])
