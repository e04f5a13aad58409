"""Streams give what the batch operators give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barloom.operators import alerts
from barloom.operators.indicators import ema, features
from barloom.streaming import bars as stream
from barloom.streaming import features as fold

T0 = datetime(2025, 6, 2)


def run(spark, frames, schema, build, tmp_path, name, mode="append"):
    """The rows that a stream of small files gives, one file a trigger."""
    src = f"{tmp_path}/{name}"
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/part={i}")
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    q = build(df).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c-{name}").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_bars_are_published_once(spark, tmp_path):
    schema = "asset string, open_time timestamp_ntz, close double, is_final boolean"
    bar = lambda h, fin: ("A", T0 + timedelta(hours=h), float(h), fin)
    got = run(spark, [[bar(0, True), bar(1, False)], [bar(0, True), bar(1, True), bar(2, False)], [bar(1, True), bar(2, True)]], schema, stream.close_once, tmp_path, "once")
    assert sorted(r.open_time.hour for r in got) == [0, 1, 2]


def test_streamed_average_is_the_batch_fold(spark, tmp_path):
    import numpy as np

    close = [100 + (i * 7 % 13) for i in range(40)]
    rows = [("A", T0 + timedelta(hours=i), float(c)) for i, c in enumerate(close)]
    got = run(spark, [rows[:5], rows[3:20], rows[20:]], "asset string, open_time timestamp_ntz, close double", stream.average_fold, tmp_path, "fold")
    want = ema(np.array(close, float), 9)
    assert len(got) == 40 and all((r.average is None) if np.isnan(w) else abs(r.average - w) < 1e-9 for r, w in zip(sorted(got, key=lambda r: r.open_time), want, strict=True))


def test_rollup_waits_for_late_ticks(spark, tmp_path):
    tick = lambda m, p, i: ("A", T0 + timedelta(minutes=m), float(p), i)
    got = run(spark, [[tick(0, 5, 1), tick(4, 9, 2)], [tick(2, 3, 3), tick(6, 8, 4)], [tick(40, 1, 5)], [tick(41, 1, 6)]], "asset string, ts timestamp_ntz, price double, tick_id long", stream.rollup, tmp_path, "roll")
    first = min(got, key=lambda r: r.open_time)
    assert (first.open, first.high, first.low, first.close, first.volume) == (5, 9, 3, 9, 3) and len(got) == 2


def test_streamed_budget_is_the_batch_budget(spark, tmp_path):
    rows = [("me", f"A{i % 7}", "1h", T0 + timedelta(minutes=i), "regime_change", 30, f"t{i % 9}", 1.0) for i in range(30)]
    schema = "recipient string, asset string, timeframe string, at timestamp_ntz, kind string, level int, title string, value double"
    got = run(spark, [rows[:10], rows[10:17], rows[17:]], schema, stream.admitted, tmp_path, "budget")
    want = alerts.admit(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["at"], r.held, r.title) for r in got) == sorted((r["at"], r.held, r.title) for r in want)
    assert [r.title for r in got if r.kind == "suppression_digest"] == ["1 alerts suppressed: 1 duplicate; most held: regime_change x1"] or sum(r.kind == "suppression_digest" for r in got) == 1


def test_upsert_sink_is_idempotent(spark, tmp_path):
    schema = "asset string, source string, timeframe string, open_time timestamp_ntz, close double, is_final boolean"
    sink = stream.upsert_sink(f"{tmp_path}/table")
    row = lambda a, close, fin: (a, "s", "1h", T0, close, fin)
    batches = [[row("A", 1.0, False)], [row("A", 2.0, True), row("B", 5.0, True)], [row("A", 3.0, False), row("B", 6.0, True), row("C", 1.0, False)], [row("C", 2.0, False)]]
    for n, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, schema), n)
    sink(spark.createDataFrame(batches[1], schema), 1)
    got = {r.asset: (r.close, r.revision) for r in stream.merged(spark.read.parquet(f"{tmp_path}/table")).collect()}
    assert got == {"A": (2.0, 1), "B": (6.0, 1), "C": (2.0, 1)} and F is not None


BAR = "asset string, open_time timestamp_ntz, open double, high double, low double, close double, volume double, is_final boolean"


def series(asset, n, seed):
    import random

    rng, close, out = random.Random(seed), 100.0, []
    for i in range(n):
        before, close = close, max(1.0, close * (1 + rng.gauss(0, 0.01))) if i % 17 else close
        out.append((asset, T0 + timedelta(hours=i), before, max(before, close) * (1 + rng.random() / 100), min(before, close) * (1 - rng.random() / 100), close, float(rng.randint(0, 50)), True))
    return out


def same(got, want, names, tolerance=1e-7):
    want = {(r.asset, r.open_time): r for r in want}
    assert len(got) == len({(r.asset, r.open_time) for r in got})
    for r in got:
        w = want[r.asset, r.open_time]
        for n in names:
            assert (r[n] is None) == (w[n] is None) and (r[n] is None or abs(r[n] - w[n]) <= tolerance * max(1.0, abs(w[n]))), (r.open_time, n, r[n], w[n])


def test_streamed_features_are_the_batch_features(spark, tmp_path):
    """Bar by bar, with repeated, late and provisional bars among them, over a restart from the checkpoint."""
    spark.conf.set(fold.STATE_STORE, fold.ROCKSDB)
    a, b = series("A", 260, 1), series("B", 230, 2)
    odd = [(*a[10][:5], 999.0, 1.0, True), (*a[-1][:5], 999.0, 1.0, False)]
    frames = [a[:120] + b[:50], a[100:210] + odd, b[50:] + a[210:]]
    src, at = f"{tmp_path}/bars", f"{tmp_path}/c-features"
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, BAR).coalesce(1).write.parquet(f"{src}/part={i}")
        df = spark.readStream.schema(BAR).parquet(src + "/*")
        q = fold.folded(df, "1h", least=1).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    from barloom.operators.indicators import recursive, windowed

    bars = spark.createDataFrame(a + b, BAR)
    want = recursive(windowed(bars, "1h", ("asset",)), ("asset",)).collect()
    assert len(got) == len(a) + len(b)
    same(got, want, [n for n in fold.FEATURES if not n.endswith("_pct") or n in ("atr_pct", "vwap_distance_pct")])
    assert max(r.refused for r in got if r.asset == "A") == 22 and {r.refused for r in got if r.asset == "B"} == {0}
    warm = [r for r in got if r.bars_seen >= 200]
    same(warm, features(bars, "1h", ("asset",)).collect(), fold.FEATURES)


def test_a_restart_from_stored_bars_is_no_restart(spark):
    spark.conf.set(fold.STATE_STORE, fold.ROCKSDB)
    rows = series("A", 700, 3)
    bars = spark.createDataFrame(rows, BAR)
    want = fold.folded(bars, "1h").collect()
    assert len(want) == 501
    cut = T0 + timedelta(hours=600)
    stored, live = bars.where(F.col("open_time") < F.lit(cut)), bars.where(F.col("open_time") >= F.lit(cut - timedelta(hours=3)))
    whole = fold.folded(live, "1h", fold.history(stored, most=None)).collect()
    assert len(whole) == 100 and {r.refused for r in whole} == {3}
    same(whole, want, fold.FEATURES, 1e-12)
    few = fold.folded(live, "1h", fold.history(stored)).collect()
    assert fold.history(stored).count() == 250 and len(few) == 100
    same(few, want, [n for n in fold.WINDOWED if n not in ("obv",)], 1e-9)
    same(few, want, ["ema_9", "ema_21", "rsi_14", "atr_14", "macd_signal"], 1e-4)
    assert len(fold.folded(live, "1h").collect()) == 0
