"""The engine's operators against plain Python, DuckDB and themselves."""

import math
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom import plans
from barloom.functions import grid, numbers
from barloom.operators import alerts, asof, backtest, ensemble, evaluation, indicators, models, news, patterns, quality, similarity, state, store
from barloom.sources.bars import BAR

START = datetime(2025, 6, 2)


def series(n=260, asset="AAA", seed=1):
    rng = random.Random(seed)
    out, last = [], 100.0
    for i in range(n):
        close = 100 + 0.08 * i + 6 * math.sin(i / 13) + 2.5 * math.cos(i / 5) + 0.4 * math.sin(2.7 * i)
        pad = 0.3 * abs(close - last) + 0.2
        out.append((asset, "s", "1h", START + timedelta(hours=i), last, max(last, close) + pad, min(last, close) - pad, close, 100 + 40 * math.sin(i / 7) + i % 11 + rng.random(), None, None, True))
        last = close
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(series() + series(asset="BBB", seed=2), BAR).cache()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if not isinstance(v, (int, bool, type(None))) else v


@pytest.mark.parametrize("name", ["bars_1h", "coverage", "gaps", "as_of_features", "indicators_recursive", "validate_events", "trust_scores", "pattern_detections", "climatology", "volume_alerts", "news_categories", "outcome_slices", "learned_weights", "calibration_records", "ensemble_panel", "due_predictions", "funding_upsert", "failover_events", "quality_events_recent", "status"])
def test_queries_match_duckdb(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf}/{t}'")
    q = c.execute(plans.oracle_sql()[name])
    names = [d[0] for d in q.description]
    df = plans.queries()[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([_norm(r[names.index(k)]) for k in sorted(names)]) for r in q.fetchall())
    assert sorted(str([_norm(r[k]) for k in sorted(names)]) for r in df.collect()) == want


def test_grid_algebra(spark):
    df = spark.createDataFrame([(datetime(2025, 6, 5, 13, 7, 9),), (datetime(1969, 12, 31, 23, 0),)], "t timestamp_ntz")
    rows = df.select(grid.floor_to(F.col("t"), "1w").alias("w"), grid.floor_to(F.col("t"), "1h").alias("h"), grid.ceil_to(F.col("t"), "1h").alias("c")).collect()
    assert rows[0] == (datetime(2025, 6, 2), datetime(2025, 6, 5, 13), datetime(2025, 6, 5, 14))
    assert rows[1] == (datetime(1969, 12, 29), datetime(1969, 12, 31, 23), datetime(1969, 12, 31, 23))
    g = spark.createDataFrame([(datetime(2025, 6, 2, 0, 30), datetime(2025, 6, 2, 3, 0))], "a timestamp_ntz, b timestamp_ntz")
    assert [r.open_time.hour for r in grid.grid(g, "a", "b", "1h").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        grid.seconds("2h")


def test_recursive_indicators_are_the_naive_ones(bars):
    rows = sorted((r for r in indicators.recursive(bars).collect() if r.asset == "AAA"), key=lambda r: r.open_time)
    close = [r.close for r in rows]
    value = sum(close[:9]) / 9
    for i in range(9, len(close)):
        value = value * (1 - 0.2) + close[i] * 0.2
        assert rows[i].ema_9 == pytest.approx(value, abs=1e-9)
    gains = [max(b - a, 0) for a, b in zip(close, close[1:], strict=False)]
    losses = [max(a - b, 0) for a, b in zip(close, close[1:], strict=False)]
    g, lo = sum(gains[:14]) / 14, sum(losses[:14]) / 14
    assert rows[13].rsi_14 is None and rows[14].rsi_14 == pytest.approx(100 - 100 / (1 + g / lo))
    assert rows[26].adx is None and all(0 <= r.adx <= 100 for r in rows[27:])


def test_no_feature_sees_the_future(bars):
    cut = START + timedelta(hours=230)
    names = ["sma_20", "realised_vol_20", "bb_percent_b", "stoch_d", "obv", "vwap", "ema_21", "adx", "macd_signal"]
    f = lambda b: {(r.asset, r.open_time): [_norm(r[n]) for n in names] for r in indicators.features(b, "1h").collect()}
    whole, early = f(bars), f(bars.where(F.col("open_time") < F.lit(cut)))
    assert early and all(whole[k] == v for k, v in early.items())


def test_shapes_and_late_rows(spark):
    ok = ("A", "s", "1h", START, 10.0, 11.0, 9.0, 10.5, 1.0, None, None, True)
    bad = [("high", 8.0, "high below low"), ("close", 12.0, "high below body"), ("open", float("nan"), "not a number"), ("low", -1.0, "not positive"), ("volume", -1.0, "volume"), ("close", None, "not a number")]
    cols = [c.split()[0] for c in BAR.split(", ")]
    rows = [tuple(v if c == k else x for c, x in zip(cols, ok, strict=True)) for k, v, _ in bad]
    got = [r.f for r in spark.createDataFrame([ok, *rows], BAR).select(quality.shape_fault().alias("f")).collect()]
    assert got == [None] + [w for _, _, w in bad]


def test_upsert_never_makes_a_final_bar_provisional(spark):
    schema = "asset string, source string, timeframe string, open_time timestamp_ntz, close double, is_final boolean, ingested_at int"
    old = spark.createDataFrame([("A", "s", "1h", START, 1.0, True, 0), ("B", "s", "1h", START, 1.0, False, 0)], schema).withColumn("revision", F.lit(0).cast("long"))
    new = spark.createDataFrame([("A", "s", "1h", START, 2.0, False, 1), ("B", "s", "1h", START, 2.0, True, 1), ("B", "s", "1h", START, 3.0, False, 2), ("C", "s", "1h", START, 4.0, False, 1)], schema)
    out = {r.asset: (r.close, r.is_final, r.revision) for r in store.upsert_bars(old, new).collect()}
    assert out == {"A": (1.0, True, 0), "B": (2.0, True, 1), "C": (4.0, False, 0)}
    again = store.upsert_bars(store.upsert_bars(old, new).select(*old.columns), new)
    assert {r.asset: (r.close, r.is_final) for r in again.collect()} == {k: v[:2] for k, v in out.items()}


def test_as_of_with_tolerance_and_buckets(spark):
    rng = random.Random(3)
    left = [(i, "k", START + timedelta(minutes=rng.randint(0, 9000))) for i in range(200)]
    right = [("k", START + timedelta(minutes=m), m) for m in rng.sample(range(9000), 60)]
    out = asof.last_before(spark.createDataFrame(left, "i int, key string, t timestamp_ntz"), spark.createDataFrame(right, "key string, u timestamp_ntz, v int"), ["key"], "t", "u", ["v"], tolerance="3 HOURS").collect()
    for r in out:
        past = [(u, v) for _, u, v in right if u <= r.t]
        want = max(past) if past else None
        assert r.v == (want[1] if want and want[0] > r.t - timedelta(hours=3) else None)


def test_detectors_that_fold_match_plain_python(bars):
    rows = sorted((tuple(r) for r in bars.where("asset = 'AAA'").collect()), key=lambda r: r[3])
    high, low, close = ([r[k] for r in rows] for k in (5, 6, 7))

    def rsi(xs):
        out = [None] * len(xs)
        d = [b - a for a, b in zip(xs, xs[1:], strict=False)]
        g, lo = sum(max(x, 0) for x in d[:14]) / 14, sum(max(-x, 0) for x in d[:14]) / 14
        for i in range(14, len(xs)):
            if i > 14:
                g += (max(d[i - 1], 0) - g) / 14
                lo += (max(-d[i - 1], 0) - lo) / 14
            out[i] = 100.0 if lo == 0 else 100 - 100 / (1 + g / max(lo, 1e-12))
        return out

    def pivots(xs, best):
        return [i for i in range(2, len(xs) - 2) if xs[i] == best(xs[i - 2 : i + 3]) and xs[i - 2 : i + 3].count(xs[i]) == 1]

    want = set()
    for end in range(80, len(rows) + 1):
        h, lw, c = high[end - 60 : end], low[end - 60 : end], close[end - 60 : end]
        r, tops, pits = rsi(c), pivots(h, max), pivots(lw, min)
        ok = lambda p: len(p) >= 2 and p[-1] >= 56 and None not in (r[p[-2]], r[p[-1]])  # noqa: B023, E731
        if ok(tops) and h[tops[-1]] > h[tops[-2]] and r[tops[-1]] < r[tops[-2]] - 3:
            want.add((end - 1, "bearish_divergence"))
        elif ok(pits) and lw[pits[-1]] < lw[pits[-2]] and r[pits[-1]] > r[pits[-2]] + 3:
            want.add((end - 1, "bullish_divergence"))
        r = rsi(close[end - 40 : end])
        if r[-1] >= 70 and r[-1] < r[-4] - 4:
            want.add((end - 1, "momentum_exhaustion_up"))
        elif r[-1] <= 30 and r[-1] > r[-4] + 4:
            want.add((end - 1, "momentum_exhaustion_down"))
    kinds = ("bearish_divergence", "bullish_divergence", "momentum_exhaustion_up", "momentum_exhaustion_down")
    got = {(r.bar, r.kind) for r in patterns.detect(bars).where(F.col("kind").isin(*kinds) & (F.col("asset") == "AAA")).collect()}
    assert got == want and want


def test_step_up_procedure(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216, 0.222, 0.251, 0.269, 0.275, 0.34]
    out = patterns.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p_value double"))
    assert sorted(r.p_value for r in out.where("significant").collect()) == [0.001]
    five = patterns.benjamini_hochberg(spark.createDataFrame([(x,) for x in (0.05, 0.01, 0.03, 0.02, 0.04)], "p_value double"))
    assert five.where("significant").count() == 5


def test_statistics(spark):
    row = spark.range(1).select(numbers.wilson(F.lit(8), F.lit(10)).alias("w"), numbers.wilson(F.lit(0), F.lit(0)).alias("z"), numbers.normal_tail(F.lit(1.5)).alias("t"), numbers.two_proportion_p(F.lit(45), F.lit(100), F.lit(30), F.lit(100)).alias("p"), numbers.median(F.array(*map(F.lit, (4.0, 1.0, 3.0, 2.0)))).alias("m")).first()
    assert row.w.low == pytest.approx(0.4901, abs=1e-3) and tuple(row.z) == (0, 1) and row.m == 2.5
    assert row.t == pytest.approx(0.5 * math.erfc(1.5 / math.sqrt(2)), abs=1e-6)
    z = 0.15 / math.sqrt(0.375 * 0.625 * 0.02)
    assert row.p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


def test_pooled_fit_is_isotonic_and_keeps_the_mean():
    rng = np.random.RandomState(1)
    y, w = rng.rand(200), rng.rand(200) + 0.1
    fit = evaluation.pooled(np.arange(200), y, w)
    assert (np.diff(fit) >= -1e-12).all() and (fit @ w) == pytest.approx(y @ w)
    assert list(evaluation.pooled(np.arange(3), np.array([1.0, 3.0, 2.0]), np.ones(3))) == [1.0, 2.5, 2.5]


def test_ledger_hashes_and_resolution(spark, bars):
    f = models.climatology(bars, models.points(bars, 6, 230), 6).withColumnRenamed("open_time", "as_of").withColumn("model", F.lit("m")).withColumn("reference_price", F.col("close"))
    ledger = evaluation.hashed(f, 6).cache()
    assert evaluation.verified(ledger).where("NOT intact").count() == 0
    changed = ledger.withColumn("confidence", F.col("confidence") + 0.1)
    assert evaluation.verified(changed).where("intact").count() == 0
    out = evaluation.resolve(ledger, bars, "1h", "2026-01-01 00:00:00").collect()
    closes = {(r.asset, r.open_time): r.close for r in bars.collect()}
    assert out and all(r.exit_price == closes[(r.asset, r.as_of + timedelta(hours=6))] for r in out)


def test_planted_skill_is_found_and_noise_is_not(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        truth = rng.choice(["up", "flat", "down"])
        good = {k: 0.6 if k == truth else 0.2 for k in ("up", "flat", "down")}
        for model, p in (("baseline_climatology", (1 / 3, 1 / 3, 1 / 3)), ("oracle", (good["up"], good["flat"], good["down"])), ("noise", tuple(rng.choice([(0.4, 0.3, 0.3), (0.3, 0.3, 0.4)])))):
            rows.append(("A", "s", "1h", START + timedelta(hours=i), model, p, 0.5, 0.1, truth, "calm"))
    f = evaluation.scored(spark.createDataFrame(rows, "asset string, source string, timeframe string, as_of timestamp_ntz, model string, p struct<up:double,flat:double,down:double>, confidence double, threshold double, truth string, regime string"))
    g = {(r.model, r.slice): r for r in evaluation.learned_weights(f).collect()}
    assert g[("oracle", "all")].weight > 0 and g[("noise", "all")].weight == 0 and g[("noise", "all")].gated_by is not None
    weights = ensemble.skill_weights(evaluation.against_baseline(f))
    records = ensemble.calibration_records(f)
    one = {(r.model, r.slice): r for r in records.collect()}
    assert one[("oracle", "all")].samples == 120 and one[("oracle", "all")].holdout == 48 and not one[("baseline_climatology", "all")].improved
    free = spark.createDataFrame([("oracle", 1.0), ("noise", 0.5)], "model string, independence double")
    panel = ensemble.panel(f.withColumn("close", F.lit(100.0)).withColumn("data_quality", F.lit(1.0)), weights, records, free).cache()
    assert panel.count() == 120 and panel.where("contributors <> 1 OR members <> 3").count() == 0
    before = panel.join(records.where("model = 'oracle' AND slice = 'all'").select("fitted_through")).where("as_of <= fitted_through")
    assert before.where("factors.calibration > 0 AND limited_by <> 'calibration'").count() <= before.count()
    told = panel.where("weight > 0 AND majority IS NOT NULL AND votes = 1").select("majority", F.get("abstainers", 0).alias("x")).count()
    assert told >= 0 and panel.where("published AND size(invalidation) < 3").count() == 0
    assert {tuple(r) for r in ensemble.response(panel).groupBy("form").agg(F.count("*") > 0).collect()} <= {("call", True), ("insufficient evidence", True)}


def test_a_failed_slice_falls_back_to_the_pooled_one(spark):
    report = spark.createDataFrame([("a", "all", 200, 0.2, True), ("a", "calm", 50, -0.1, False), ("b", "all", 200, 0.1, False)], "model string, slice string, n long, skill double, beats_baseline boolean")
    rows = [("X", "s", "1h", START, m, "calm", (0.6, 0.2, 0.2), 0.5, 1.0, 100.0, 1.0) for m in ("a", "b")]
    f = spark.createDataFrame(rows, "asset string, source string, timeframe string, as_of timestamp_ntz, model string, regime string, p struct<up:double,flat:double,down:double>, confidence double, threshold double, close double, data_quality double")
    records = spark.createDataFrame([], "model string, slice string, improved boolean, improvement double, fitted_through timestamp_ntz, curves map<string,struct<xs:array<double>,ys:array<double>>>")
    free = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "model string, independence double")
    one = ensemble.panel(f, ensemble.skill_weights(report), records, free).head()
    assert one.weight == 0.2 and one.contributors == 1 and one.factors.calibration == 0 and one.suppressed_because == ["confidence below the floor, limited by calibration"]


def test_folds_are_purged_and_cover_the_tests(spark):
    n = spark.createDataFrame([("A", 2000), ("B", 700)], "asset string, n long")
    for rolling in (False, True):
        rows = backtest.fold_table(n, 12, rolling=rolling).orderBy("fold").collect()
        assert len(rows) == 5 and {r.asset for r in rows} == {"A"} and rows[0].test_start == 815 and rows[-1].test_end == 2000
        assert all(r.train_end == r.test_start - 15 and not r.leaks for r in rows) and all(a.test_end == b.test_start for a, b in zip(rows, rows[1:], strict=False))
    at = spark.range(2000).select("id", backtest.fold_of(F.col("id"), F.lit(2000), 12).alias("f")).collect()
    assert all((r.f is None) == (r.id < 815) and (r.f is None or rows[r.f].test_start <= r.id < rows[r.f].test_end) for r in at)
    said = {r.model: r.verdict for r in backtest.leak_verdict(spark.createDataFrame([("a", 0.0, 0.3), ("b", 0.2, 0.3), ("c", 0.0, 0.0), ("a", 0.0, 0.0)], "model string, future double, past double")).collect()}
    assert said == {"a": "clean", "b": "leaking", "c": "inconclusive"}


def test_state_of_clear_trends(spark):
    up = {"close": 110.0, "ema_21": 105.0, "sma_50": 100.0, "sma_200": 90.0, "adx": 45.0, "plus_di": 40.0, "minus_di": 10.0, "rsi_14": 65.0, "macd": 2.0, "macd_signal": 1.0, "macd_histogram": 1.0, "roc_10": 5.0, "stoch_k": 80.0, "bb_percent_b": 0.9, "vwap_distance_pct": 2.0, "obv_change_20": 900.0, "volume": 100.0, "change_pct": 1.0}
    names = list(up)
    rows = [tuple(up.values()), tuple(None for _ in names)]
    got = state.classify(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))).collect()
    assert got[0].direction in ("up", "strong_up") and 0 < got[0].confidence <= 0.9 and len(got[0].evidence) == 8
    assert (got[1].direction, got[1].confidence, got[1].score) == ("neutral", 0.0, 0.0)
    levels = [("A", START, tf, "up" if tf in ("4h", "1d") else "down", s, 0.7, 0.6, 60.0) for tf, s in (("15m", -0.5), ("1h", -0.5), ("4h", 0.5), ("1d", 0.5))]
    h = state.hierarchy(spark.createDataFrame(levels, "asset string, as_of timestamp_ntz, timeframe string, direction string, score double, strength double, confidence double, volatility_pct double")).first()
    assert h.alignment == "pullback_in_uptrend" and h.timeframes == 4 and len(h.conflicts) == 4


def test_feeds_titles_and_sentiment(spark):
    rss = "<rss><channel><item><title>Bitcoin &amp; co <b>surge</b></title><link>http://x/1</link><pubDate>Mon, 02 Jun 2025 10:00:00 GMT</pubDate><description><![CDATA[<p>not approved</p>]]></description></item><item><title>no link</title></item></channel></rss>"
    atom = '<feed><entry><title>T</title><link href="http://x/2"/><updated>2025-06-02T11:00:00Z</updated></entry></feed>'
    df = spark.createDataFrame([("a", rss), ("b", atom), ("c", "not xml")], "source string, body string").withColumn("now", F.current_timestamp())
    got = {r.url: r for r in news.parse_feed(df).collect()}
    assert set(got) == {"http://x/1", "http://x/2"} and got["http://x/1"].title == "Bitcoin & co surge" and got["http://x/1"].published_at.hour == 10
    row = spark.createDataFrame([("Bitcoin surges after approval - CoinDaily", "it was not approved, link in bio", 2, 0.8)], "title string, body string, coverage int, source_weight double")
    r = news.classified(row).first()
    assert r.sentiment == "positive" and [x.asset for x in r.relevance] == ["BTC"] and r.category == "market_move"
    assert row.select(news.title_tokens(F.col("title")).alias("t")).first().t == ["bitcoin", "surges", "after", "approval"]


def test_stories_gather_and_recycle(spark):
    t = lambda h: START + timedelta(hours=h)
    items = [(1, "a", "exchange halts bitcoin withdrawals today", t(1)), (2, "b", "bitcoin withdrawals halted at exchange", t(2)), (3, "a", "senate passes budget bill quickly", t(3)), (4, "c", "Exchange halts bitcoin withdrawals today!", t(49)), (5, "c", "", t(3))]
    told = news.stories(spark.createDataFrame(items, "item_id long, source string, title string, published_at timestamp_ntz"))
    ev = news.recycled(news.story_events(told)).orderBy("earliest").collect()
    assert [(e.articles, e.coverage) for e in ev] == [(2, 2), (1, 1), (1, 1)] and ev[2].recycled_from is None  # an equal first title is the same story, not a re-telling


def test_reworded_stories_are_recycled_as_by_brute_force(spark):
    import math

    rng = random.Random(3)
    t = lambda h: START + timedelta(hours=h)
    items = [(1, "a", "exchange halts bitcoin withdrawals today", t(1)), (2, "b", "senate passes budget bill", t(2)), (3, "c", "withdrawals of bitcoin halted again by exchange", t(49)), (4, "c", "rain tomorrow", t(50))]
    items += [(10 + i, "d", " ".join(rng.sample([f"w{k}" for k in range(25)], 5)), t(rng.randrange(0, 24 * 6))) for i in range(60)]
    ev = news.recycled(news.story_events(news.stories(spark.createDataFrame(items, "item_id long, source string, title string, published_at timestamp_ntz")))).collect()
    cycles = {}
    for e in ev:
        cycles.setdefault(e.cycle, []).extend(e.words)
    n = {e.cycle: e.cycle_titles for e in ev}
    hits = 0
    for e in ev:
        w = {k: max(0.15, math.log((n[e.cycle] + 1) / (cycles[e.cycle].count(k) + 1))) for k in set(cycles[e.cycle])}
        mass = lambda words: sum(w.get(k, max(w.values())) for k in words)  # noqa: E731, B023
        a = set(e.words)
        older = [p.earliest for p in ev if p.cluster_id != e.cluster_id and e.earliest - p.earliest > timedelta(hours=36) and mass(a & set(p.words)) / mass(a | set(p.words)) >= 0.30]
        assert e.recycled_from == (min(older) if older else None)
        hits += bool(older)
    assert 5 < hits < len(ev) and next(e for e in ev if "halted" in e.words).recycled_from == t(1)


def test_budget_limits_and_reserve(spark):
    rows = [(f"A{i}", None, START + timedelta(minutes=i), "volume_anomaly", 20, f"t{i}", 1.0, "me") for i in range(8)]
    rows += [("A0", None, START + timedelta(minutes=9), "volume_anomaly", 20, "t0", 1.0, "me"), ("A1", None, START + timedelta(minutes=10), "volume_anomaly", 20, "other", 1.0, "me"), ("Z", None, START + timedelta(minutes=11), "super_prediction", 40, "s", 1.0, "me")]
    got = [r.held for r in alerts.admit(spark.createDataFrame(rows, alerts.ALERT + ", recipient string")).where("kind <> 'suppression_digest'").orderBy("at").collect()]
    assert got == [""] * 6 + ["hourly"] * 2 + ["duplicate", "cooldown", ""]


def test_analogues_find_planted_repeats(spark):
    rng = random.Random(9)
    rows = [("A", "s", "1h", i, 100.0 + i % 50, float(i % 50), rng.random()) for i in range(400)]
    f = spark.createDataFrame(rows, "asset string, source string, timeframe string, bar int, close double, x double, y double")
    q = f.where("bar = 399")
    out = similarity.analogues(f, q, 10, ("x", "y"), ceiling=0.6, top=20).collect()
    assert out and all(r.bar <= 389 and abs(r.bar % 50 - 49) * 1.0 <= 25 for r in out) and [r.rank for r in out] == list(range(1, len(out) + 1))


def test_analogues_see_only_their_past_below_its_own_ceiling(spark):
    from statistics import median

    rng = random.Random(4)
    rows = [("A", "s", "1h", i, 100.0 + rng.random(), rng.gauss(0, 1) * (1 if i < 300 else 40), rng.gauss(0, 1)) for i in range(600)]
    f = spark.createDataFrame(rows, "asset string, source string, timeframe string, bar int, close double, x double, y double")
    h, asked = 10, (15, 100, 250, 590)
    got = similarity.analogues(f, f.where(F.col("bar").isin(*asked)), h, ("x", "y"), top=1000).collect()
    assert got and max(r.asked for r in got) == 590
    for q in asked:
        past = [r[5:] for r in rows[: max(0, q - h)]]
        want = []
        if len(past) >= 30:
            c = [median(p[k] for p in past) for k in (0, 1)]
            m = [median(abs(p[k] - c[k]) for p in past) * 1.4826 for k in (0, 1)]
            z = [[(p[k] - c[k]) / m[k] for k in (0, 1)] for p in [*past, rows[q][5:]]]
            far = lambda a, b: (((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) / 2) ** 0.5
            some = z[:-1][:: max(1, len(past) // 200)]
            pairs = [far(some[i], some[i + 1]) for i in range(0, len(some) - 1, 2)]
            most = 1.5 if len(past) < 50 else min(1.5, 0.85 * sum(pairs) / len(pairs))
            want = [(i, far(v, z[-1])) for i, v in enumerate(z[:-1]) if far(v, z[-1]) <= most]
        mine = {r.bar: r.distance for r in got if r.asked == q}
        assert set(mine) == {i for i, _ in want} and all(abs(mine[i] - d) < 1e-9 for i, d in want)


def test_faults_are_seen(spark):
    """Dropped, swapped, tripled and flat bars of a quiet series."""
    rows = []
    for i in range(200):
        mid = 100 + 5 * math.sin(i / 9) + 0.1 * (i * 7 % 5)
        high, low = mid + 0.3, mid - 0.3
        flat = 100 <= i < 110
        rows.append(("AAA", "s", "1h", START + timedelta(hours=i), mid, mid if flat else low if i == 60 else high, mid if flat else high if i == 60 else low, mid * 3 if i == 90 else mid, 0.0 if flat else 10.0, i))
    rows = [r if r[9] != 90 else (*r[:5], r[7] + 1, *r[6:]) for r in rows if r[9] % 50 != 49]
    b = spark.createDataFrame(rows, "asset string, source string, timeframe string, open_time timestamp_ntz, open double, high double, low double, close double, volume double, arrival long")
    kept, events = quality.validated(b, "1h", "arrival")
    got = {(r.event_type, r.severity, r.n) for r in events.collect()}
    assert {("shape_invalid", "error", 1), ("impossible_move", "error", 1), ("flatline", "warning", 10), ("missing", "warning", 1)} <= got and kept.count() == 195


def test_peers_are_the_others_of_the_moment(spark):
    rng = random.Random(3)
    rows = [(f"A{a}", "s", "1h", START + timedelta(hours=h), 100.0 + rng.randint(0, 5) if not (a == 2 and h == 3) else 0.0, 1.0) for a in range(5) for h in range(8)]
    ctx = spark.createDataFrame(rows, "asset string, source string, timeframe string, open_time timestamp_ntz, close double, threshold double")
    got = {(r.asset, r.open_time): r for r in models.cross_asset(ctx, 2).collect()}
    close = {(r[0], r[3]): r[4] for r in rows}
    for (asset, at), r in got.items():
        move = {a: (close[a, at] - old) / old * 100 for a in (f"A{i}" for i in range(5)) if (old := close.get((a, at - timedelta(hours=2)), 0)) > 0}
        others = sorted(v for a, v in move.items() if a != asset)
        if asset not in move or not others:
            assert r.confidence == 0
            continue
        mid = (others[(len(others) - 1) // 2] + others[len(others) // 2]) / 2
        assert abs(r.confidence - (0.18 + min(0.25, abs(mid - move[asset]) / 3))) < 1e-9


def test_thinning(spark):
    marks = spark.createDataFrame([("a", b) for b in (0, 1, 5, 6, 7, 12, 12, 13, 30)], "k string, bar long")
    assert sorted(r.bar for r in patterns.thinned(marks, ("k",), 6).collect()) == [0, 6, 12, 30]


def test_venue_bodies(spark):
    from barloom.sources import venues

    at = int(START.timestamp()) if START.tzinfo else int((START - datetime(1970, 1, 1)).total_seconds())
    one = f'[[{at * 1000},"1","3","0.5","2","10",{at * 1000 + 3599999},"20",7]]'
    two = f"[[{at + 3600},0.5,3,1,2,10],[{at},0.4,2,1,1.5,9]]"
    three = f'{{"error":[],"result":{{"XBT":[[{at},"1","3","0.5","2","1.5","10",7]],"last":5}}}}'
    df = lambda body: spark.createDataFrame([("btc", "1h", body, START + timedelta(minutes=90))], "asset string, timeframe string, body string, fetched_at timestamp")
    a = venues.klines(df(one)).first()
    assert (a.asset, a.open_time, a.high, a.quote_volume, a.trades, a.is_final) == ("BTC", START, 3.0, 20.0, 7, True)
    assert {r.open_time: r.is_final for r in venues.candles(df(two)).collect()} == {START: True, START + timedelta(hours=1): False}
    assert venues.ohlc(df(three)).first().quote_volume == 15.0
    with pytest.raises(Exception, match="venue: bad pair"):
        venues.ohlc(df('{"error":["bad pair"],"result":null}')).collect()


def test_look_ahead_is_caught(bars):
    from pyspark.sql import Window

    from barloom.operators.universe import leaks

    moment = str(START + timedelta(hours=150))
    clean = leaks(bars, lambda b: indicators.windowed(b, "1h").select("asset", "source", "timeframe", "open_time", "sma_20", "roc_10"), moment)
    w = Window.partitionBy("asset").orderBy("open_time")
    leaky = leaks(bars, lambda b: b.select("asset", "source", "timeframe", "open_time", F.lead("close").over(w).alias("x")), moment)
    assert clean[0] == 0 and clean[1] > 0 and leaky[0] > 0


def test_written_partitions_are_replaced(spark, bars, tmp_path):
    path = f"{tmp_path}/bars"
    store.write_bars(bars, path)
    store.write_bars(bars.where("asset = 'AAA'").withColumn("timeframe", F.lit("4h")), path)
    store.write_bars(bars.limit(7), path)
    assert {r.timeframe: r["count"] for r in spark.read.parquet(path).groupBy("timeframe").count().collect()} == {"1h": 7, "4h": bars.where("asset = 'AAA'").count()}
