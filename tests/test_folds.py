"""A fold is fitted on its training rows only."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, ensemble

T0 = datetime(2025, 1, 6)
ROW = "model string, asset string, source string, timeframe string, as_of timestamp_ntz, regime string, p struct<up:double,flat:double,down:double>, confidence double, threshold double, close double, data_quality double, truth string"


def rows(n=420):
    rng, out = random.Random(8), []
    for i in range(n):
        truth = rng.choice(("up", "flat", "down"))
        for model, know in (("baseline_climatology", 0.0), ("knows", 0.35), ("guesses", 0.0)):
            p = {k: 1 / 3 for k in ("up", "flat", "down")}
            if model != "baseline_climatology":
                said = truth if rng.random() < know else rng.choice(("up", "flat", "down"))
                p = {k: 0.5 if k == said else 0.25 for k in p}
            out.append((model, "A", "s", "1h", T0 + timedelta(hours=i), "range" if i % 3 else "uptrend", (p["up"], p["flat"], p["down"]), 0.4, 1.0, 100.0, 0.95, truth))
    return out


AT = {"horizon": 4, "k": 4, "warmup": 20, "least": 20}


@pytest.fixture(scope="module")
def runs(spark):
    free = ensemble.independence_table(spark.createDataFrame([("knows", "a"), ("guesses", "b"), ("baseline_climatology", "c")], "model string, input string"))
    made = rows()
    last = T0 + timedelta(hours=330)  # within the last fold's test rows
    turned = [(*r[:-1], {"up": "down", "down": "up", "flat": "up"}[r[-1]]) if r[4] >= last else r for r in made]
    return [backtest.fold_run(spark.createDataFrame(x, ROW), free, **AT) for x in (made, turned)]


def test_one_row_a_fold_with_its_points(runs):
    got = sorted(tuple(r)[1:4] for r in runs[0]["summary"].collect())
    size = (420 - 40 - 5) // 4
    assert got == [(f, 40 + f * size - 20, size + (420 - 45 - 4 * size if f == 3 else 0)) for f in range(4)]
    assert all(r.skilled == 1 for r in runs[0]["summary"].where("fold >= 1").collect())
    assert {r.model for r in runs[0]["weights"].where("weight > 0").collect()} == {"knows"}


def test_test_rows_move_nothing_that_was_fitted(runs):
    for part in ("weights", "records"):
        a, b = (sorted(map(str, r[part].where("fold = 3").collect())) for r in runs)
        assert a == b and a
    scores = [{(x.model, x.slice): x.skill for x in r["scores"].where("fold = 3").collect()} for r in runs]
    assert scores[0]["knows", "all"] > 0.05 > 0 > scores[1]["knows", "all"]
    assert [r["scores"].where("fold < 3").select(F.sum("skill")).head()[0] for r in runs][0] == pytest.approx(runs[1]["scores"].where("fold < 3").select(F.sum("skill")).head()[0])


def test_the_ensemble_speaks_in_test_rows_only(spark, runs):
    points = runs[0]["points"].select("fold", "as_of", "weight", "published").collect()
    assert len({(r.fold, r.as_of) for r in points}) == len(points) == 420 - 45
    assert min(r.as_of for r in points) == T0 + timedelta(hours=45) and any(r.weight > 0 for r in points)
    leaky = spark.createDataFrame([("knows",)], "model string")
    free = spark.createDataFrame([("guesses", 1.0)], "model string, independence double")
    out = backtest.fold_run(spark.createDataFrame(rows(), ROW), free, **AT, excluded=leaky)
    assert {r.skilled for r in out["summary"].collect()} == {0} and out["scores"].where("model = 'knows'").count() == 0
