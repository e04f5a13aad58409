"""Queries on market state and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.grid import plus
from barloom.functions.numbers import rounded, sql_tail
from barloom.operators import patterns as p
from barloom.operators import records as rec
from barloom.operators import state as s
from barloom.operators.indicators import windowed
from barloom.plans import alerts as _alerts  # noqa: F401  its SQL is used below
from barloom.plans import bars as _bars  # noqa: F401
from barloom.plans.registry import query, registered_sql
from barloom.plans.sql import bars as sql_bars
from barloom.plans.sql import r
from barloom.sources.bars import event_bars
from barloom.sources.tables import stored

_W = f"""WITH {sql_bars()}, o AS (SELECT *, row_number() OVER w AS rn, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS t0 FROM bars WINDOW w AS (PARTITION BY asset ORDER BY open_time)),
  f AS (SELECT *, max(high) OVER p20 AS top, min(low) OVER p20 AS bottom, avg(volume) OVER p20 AS mv, avg(t0) OVER (PARTITION BY asset ORDER BY rn ROWS 13 PRECEDING) AS r14, avg(t0) OVER (PARTITION BY asset ORDER BY rn ROWS 9 PRECEDING) AS r10, avg(t0) OVER (PARTITION BY asset ORDER BY rn ROWS 4 PRECEDING) AS r5, avg(t0) OVER (PARTITION BY asset ORDER BY rn ROWS 49 PRECEDING) AS r50,
    median(volume) OVER p20 AS ctr, list(volume) OVER p20 AS vols FROM o WINDOW p20 AS (PARTITION BY asset ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
  g AS (SELECT *, volume / mv AS vr, list_median(list_transform(vols, x -> abs(x - ctr))) * 1.4826 AS sc FROM f WHERE rn >= 80)"""
_KINDS = ("breakout_up", "breakout_down", "fakeout_up", "fakeout_down", "liquidity_sweep_high", "liquidity_sweep_low", "compression", "expansion", "volume_anomaly")


@query(
    "pattern_detections",
    _W.replace("list_median(list_transform(vols, x -> abs(x - ctr)))", "list_aggregate(list_transform(vols, lambda x: abs(x - ctr)), 'median')")
    + """SELECT asset, open_time, kind, round(least(1, q), 6) AS quality FROM (
      SELECT asset, open_time, 'breakout_up' AS kind, 0.4 + (close - top) / top * 20 + (vr - 1.2) * 0.3 AS q FROM g WHERE close > top AND vr > 1.2
      UNION ALL SELECT asset, open_time, 'breakout_down', 0.4 + (bottom - close) / bottom * 20 + (vr - 1.2) * 0.3 FROM g WHERE close < bottom AND vr > 1.2
      UNION ALL SELECT asset, open_time, CASE WHEN u THEN 'fakeout_up' ELSE 'fakeout_down' END, CASE WHEN u THEN 0.35 + (high - top) / r14 * 0.3 + (high - close) / (high - low) * 0.3 ELSE 0.35 + (bottom - low) / r14 * 0.3 + (close - low) / (high - low) * 0.3 END
        FROM (SELECT *, high > top AND close < top AND (high - top) / r14 >= 0.15 AND (high - close) / (high - low) >= 0.4 AS u, low < bottom AND close > bottom AND (bottom - low) / r14 >= 0.15 AND (close - low) / (high - low) >= 0.4 AS d FROM g WHERE high > low AND r14 > 0) WHERE u OR d
      UNION ALL SELECT asset, open_time, CASE WHEN u THEN 'liquidity_sweep_high' ELSE 'liquidity_sweep_low' END, 0.45 + CASE WHEN u THEN high - greatest(open, close) ELSE least(open, close) - low END / r14 * 0.2
        FROM (SELECT *, high > top AND close < top AND high - greatest(open, close) > 0.8 * r14 AS u, low < bottom AND close > bottom AND least(open, close) - low > 0.8 * r14 AS d FROM g) WHERE u OR d
      UNION ALL SELECT asset, open_time, 'compression', 1.0 - r10 / r50 FROM g WHERE r10 > 0 AND r10 / r50 <= 0.6
      UNION ALL SELECT asset, open_time, 'expansion', 0.4 + (r5 / r50 - 1.8) * 0.2 FROM g WHERE r50 > 0 AND r5 / r50 >= 1.8
      UNION ALL SELECT asset, open_time, 'volume_anomaly', 0.4 + (z - 4) * 0.05 FROM (SELECT *, CASE WHEN sc > 0 THEN (volume - ctr) / sc WHEN volume >= 3 * ctr THEN 1 + volume / ctr END AS z FROM g WHERE ctr > 0) WHERE z >= 4)""",
)
def pattern_detections(spark, sf):
    return rounded(p.detect(event_bars(spark, sf), kinds=_KINDS).select("asset", "open_time", "kind", "quality"))


@query("pattern_scan")
def pattern_scan(spark, sf):
    """All nineteen kinds; the ones that fold are held against plain Python in the tests."""
    return rounded(p.detect(event_bars(spark, sf)).select("asset", "open_time", "kind", "direction", "quality"))


@query("pattern_evaluation")
def pattern_evaluation(spark, sf):
    b = event_bars(spark, sf)
    out = p.evaluate(b, p.detect(b))
    return rounded(out.select("asset", "kind", "horizon", "direction", "occurrences", "successes", "rate", "baseline", "edge", "low", "high", "p_value", "significant", F.col("mean_move_pct")))


@query(
    "swing_points",
    f"""WITH {sql_bars()}, w AS (SELECT *, count(*) OVER a AS n, max(high) OVER a AS h, min(low) OVER a AS l, list(high) OVER a AS hs, list(low) OVER a AS ls FROM bars WINDOW a AS (PARTITION BY asset ORDER BY open_time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT asset, open_time, high = h AND len(list_filter(hs, lambda x: x = high)) = 1 AS swing_high, low = l AND len(list_filter(ls, lambda x: x = low)) = 1 AS swing_low FROM w WHERE n = 5 AND ((high = h AND len(list_filter(hs, lambda x: x = high)) = 1) OR (low = l AND len(list_filter(ls, lambda x: x = low)) = 1))""",
)
def swing_points(spark, sf):
    return p.swings(event_bars(spark, sf)).where("swing_high OR swing_low").select("asset", "open_time", "swing_high", "swing_low")


def _two_tails(s: str, n: str, bs: str, bn: str) -> str:
    pool = f"(({s} + {bs}) / ({n} + {bn}))"
    z = f"(abs({s} / {n} - {bs} / {bn}) / sqrt({pool} * (1 - {pool}) * (1 / {n} + 1 / {bn})))"
    return f"CASE WHEN {pool} > 0 AND {pool} < 1 THEN least(1.0, 2 * {sql_tail(z)}) ELSE 1.0 END"


_STATES = "SELECT user_id, event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events"


def _wilson(s: str, n: str, sign: str) -> str:
    return f"({s} / {n} + 1.96 * 1.96 / (2 * {n}) {sign} 1.96 * sqrt({s} / {n} * (1 - {s} / {n}) / {n} + 1.96 * 1.96 / (4.0 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n})"


@query(
    "transition_matrix",
    f"""WITH p AS ({_STATES}), n AS (SELECT state, nxt AS next_state, count(*) AS n FROM p WHERE state <> nxt GROUP BY 1, 2), t AS (SELECT state, sum(n)::BIGINT AS total FROM n GROUP BY 1)
    SELECT state, next_state, n, total, round(n / total, 6) AS probability, round(greatest(0, {_wilson('n', 'total', '-').replace('1.96 * sqrt', '1.96 * sqrt')}), 6) AS low, round(least(1, {_wilson('n', 'total', '+')}), 6) AS high FROM n JOIN t USING (state) WHERE total >= 20""",
)
def transition_matrix(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("event_type", "state")
    return rounded(p.transitions(e, ("user_id",), ("ts", "event_id")))


@query(
    "event_chains",
    """WITH e AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS k1, lag(ts) OVER w AS t1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT k1 || '>' || event_type AS chain, count(*) AS n FROM e WHERE ts - t1 <= INTERVAL '2 days' AND ts > t1 GROUP BY 1 HAVING count(*) >= 25""",
)
def event_chains(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("bar"))
    c = p.chains(e, 2, 2 * 86400 * 1_000_000, ("user_id",))
    return c.groupBy(F.array_join("chain", ">").alias("chain")).agg(F.count("*").alias("n")).where("n >= 25")


@query(
    "momentum_state",
    f"""WITH {sql_bars()}, w AS (SELECT asset, open_time, close, row_number() OVER o AS rn, (close - lag(close, 10) OVER o) / lag(close, 10) OVER o * 100 AS roc, (close - open) / open * 100 AS ch,
      avg(close) OVER (PARTITION BY asset ORDER BY open_time ROWS 49 PRECEDING) AS m50 FROM bars WINDOW o AS (PARTITION BY asset ORDER BY open_time)),
    x AS (SELECT *, ((close - m50) / m50 * 100 / 4) / (1 + abs((close - m50) / m50 * 100 / 4)) AS t, (roc / 3) / (1 + abs(roc / 3)) AS m, (ch / 1.5) / (1 + abs(ch / 1.5)) * 0.5 AS v FROM w WHERE rn >= 50),
    y AS (SELECT *, (0.4 * t + 0.3 * m + 0.1 * v) / 0.8 AS s FROM x),
    z AS (SELECT *, (0.4 * CASE WHEN abs(t) > 0.05 THEN 1 ELSE 0.5 END + 0.3 * CASE WHEN abs(m) > 0.05 THEN 1 ELSE 0.5 END + 0.1 * CASE WHEN abs(v) > 0.05 THEN 1 ELSE 0.5 END) / 0.8 AS coh FROM y)
    SELECT asset, open_time, round(s, 3) AS score, CASE WHEN s >= 0.65 THEN 'strong_up' WHEN s >= 0.35 THEN 'up' WHEN s >= 0.12 THEN 'weak_up' WHEN s <= -0.65 THEN 'strong_down' WHEN s <= -0.35 THEN 'down' WHEN s <= -0.12 THEN 'weak_down' ELSE 'neutral' END AS direction,
      round(0.9 * coh * 0.8 * least(1, 0.35 + 1.6 * abs(s)), 3) AS confidence FROM z""",
)
def momentum_state(spark, sf):
    f = windowed(event_bars(spark, sf), "1h").where("bars_seen >= 50").withColumn("change_pct", (F.col("close") - F.col("open")) / F.col("open") * 100).select("asset", "open_time", "close", "sma_50", "roc_10", "change_pct")
    raw = s.groups(f.columns)
    on = f.select("asset", "open_time", *(s.group_score(raw[g]).alias(g) for g in ("trend", "momentum", "volume")), *(s.coherence(raw[g]).alias(f"{g}_c") for g in ("trend", "momentum", "volume")))
    score = (0.4 * F.col("trend") + 0.3 * F.col("momentum") + 0.1 * F.col("volume")) / 0.8
    coherent = (0.4 * F.col("trend_c") + 0.3 * F.col("momentum_c") + 0.1 * F.col("volume_c")) / 0.8
    return on.select("asset", "open_time", F.round(score, 3).alias("score"), s.direction(score).alias("direction"), F.round(0.9 * coherent * 0.8 * F.least(F.lit(1.0), 0.35 + 1.6 * F.abs(score)), 3).alias("confidence"))


FRAMES = ("15m", "1h", "4h", "1d")


def _features(spark, sf):
    """The feature vectors of all timeframes, each from its first bar on, and when they were known."""
    from barloom.operators.levels import vector

    parts = None
    for tf in FRAMES:
        f = vector(stored(event_bars(spark, sf, tf)), tf, 1).withColumn("known", plus(F.col("open_time"), tf))
        f = f.select("asset", "timeframe", "known", "close", *(c for c, t in f.dtypes if t in ("double", "bigint") and c not in ("close", "open", "high", "low", "quote_volume", "trades")))
        parts = f if parts is None else parts.unionByName(f)
    return parts


def _days(spark, sf):
    """Of each asset and day: how many of eighty events it had, at most 1, known at the day's end."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("event_type").alias("asset"), (day + F.expr("INTERVAL 1 DAY")).alias("as_of"))
    return e.agg(F.least(F.lit(1.0), F.count("*") / 80).alias("score"))


@query("market_state")
def market_state(spark, sf):
    """The state of every asset at each day's end over four timeframes, from bars and trust that were known by then, in words too."""
    days = _days(spark, sf)
    trust = days.select("asset", F.col("as_of").alias("ts"), "score", F.explode(F.array(*map(F.lit, FRAMES))).alias("timeframe"))
    return rounded(s.build(stored(_features(spark, sf)), days, trust), 4)


@query(
    "compact_states",
    f"""WITH w AS ({registered_sql("indicators_windowed")}), x AS ({registered_sql("indicators_recursive")}), t AS ({registered_sql("structure_trend")}), k AS (WITH {sql_bars()} SELECT asset, open_time, close FROM bars),
    b AS (SELECT asset, open_time, coalesce(trend, 0) AS trend, greatest(-1, least(1, (close - sma_200) / sma_200 * 10)) * 0.5 + greatest(-1, least(1, (close - ema_21) / ema_21 * 20)) * 0.3 + coalesce(trend, 0) * 0.2 AS bias FROM k JOIN w USING (asset, open_time) JOIN x USING (asset, open_time) JOIN t USING (asset, open_time) WHERE sma_200 IS NOT NULL)
    SELECT asset, open_time, round(greatest(-1, least(1, bias)), 4) AS bias_score, CASE WHEN (bias > 0) = (trend >= 0) THEN 1.0 ELSE 0.4 END::DOUBLE AS agreement, CASE WHEN bias > 0.15 AND trend >= 0 THEN 'aligned_bullish' WHEN bias < -0.15 AND trend <= 0 THEN 'aligned_bearish' WHEN abs(bias) > 0.15 THEN 'conflicted' ELSE 'rangebound' END AS alignment, 0.5::DOUBLE AS confidence FROM b""",
)
def compact_states(spark, sf):
    """A bar's state in four numbers, as the walk-forward's regime model reads it."""
    from barloom.operators.levels import vector

    f = rounded(vector(event_bars(spark, sf), "1h", 200))
    return s.compact(f).select("asset", "open_time", "bias_score", "agreement", "alignment", "confidence")


@query(
    "regime_labels",
    f"""WITH {sql_bars()}, w AS (SELECT asset, open_time, close, row_number() OVER o AS rn, count(*) OVER (PARTITION BY asset ORDER BY open_time ROWS 99 PRECEDING) AS n, first(close) OVER (PARTITION BY asset ORDER BY open_time ROWS 99 PRECEDING) AS old, abs(close - lag(close) OVER o) / lag(close) OVER o AS ret FROM bars WINDOW o AS (PARTITION BY asset ORDER BY open_time)),
    l AS (SELECT *, list_sort(list_filter(list(ret) OVER (PARTITION BY asset ORDER BY rn ROWS 98 PRECEDING), lambda x: x IS NOT NULL)) AS xs FROM w), v AS (SELECT *, xs[len(xs) // 2 + 1] AS noise FROM l), x AS (SELECT *, CASE WHEN n >= 20 AND noise > 0 THEN (close - old) / old / (noise * sqrt(n)) END AS drift FROM v)
    SELECT asset, open_time, CASE WHEN drift IS NULL THEN 'unknown' ELSE CASE WHEN abs(drift) < 0.5 THEN 'range' WHEN drift > 0 THEN 'uptrend' ELSE 'downtrend' END || CASE WHEN noise > 0.004 THEN '_high_vol' ELSE '_low_vol' END END AS regime, {r('drift', 'drift')} FROM x""",
)
def regime_labels(spark, sf):
    """Every bar; the first twenty of a series are unknown."""
    from barloom.operators.models import coarse_regime

    return rounded(coarse_regime(event_bars(spark, sf)).select("asset", "open_time", "regime", "drift"))


@query(
    "chain_statistics",
    f"""WITH RECURSIVE {sql_bars()}, b AS (SELECT asset, close, volume, row_number() OVER w - 1 AS bar, lag(close) OVER w AS last, lead(close, 6) OVER w AS e6, lead(close, 12) OVER w AS e12 FROM bars WINDOW w AS (PARTITION BY asset ORDER BY open_time)),
    d AS (SELECT asset, bar, CASE WHEN close > 1.5 * last THEN 'jump' WHEN close * 1.5 < last THEN 'fall' WHEN volume >= 5 THEN 'busy' END AS kind FROM b), g AS (SELECT asset, bar, kind, lag(kind) OVER w AS k1, lag(bar) OVER w AS b1, lag(kind, 2) OVER w AS k2, lag(bar, 2) OVER w AS b2 FROM d WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY bar)),
    c AS (SELECT asset, bar, k1 || '>' || kind AS chain FROM g WHERE bar - b1 <= 6 UNION ALL SELECT asset, bar, k2 || '>' || k1 || '>' || kind FROM g WHERE bar - b1 <= 6 AND b1 - b2 <= 6), f AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY asset, chain) >= 25),
    o AS (SELECT f.asset, chain, h, f.bar, (CASE h WHEN 6 THEN e6 ELSE e12 END - close) / close * 100 AS ret, row_number() OVER (PARTITION BY f.asset, chain, h ORDER BY f.bar) AS k FROM f JOIN b USING (asset, bar), (VALUES (6), (12)) v(h) WHERE CASE h WHEN 6 THEN e6 ELSE e12 END IS NOT NULL),
    r AS (SELECT asset, chain, h, k, bar AS last, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.asset, o.chain, o.h, o.k, CASE WHEN o.bar - r.last >= o.h THEN o.bar ELSE r.last END, o.bar - r.last >= o.h FROM r JOIN o ON o.asset = r.asset AND o.chain = r.chain AND o.h = r.h AND o.k = r.k + 1),
    m AS (SELECT asset, h, count(*) AS bn, count(*) FILTER (CASE h WHEN 6 THEN e6 ELSE e12 END > close) AS bs FROM b, (VALUES (6), (12)) v(h) WHERE bar % h = 0 AND CASE h WHEN 6 THEN e6 ELSE e12 END IS NOT NULL GROUP BY 1, 2),
    n AS (SELECT asset, chain, h, count(*) AS n, count(*) FILTER (ret > 0) AS s, list_sort(list(ret)) AS xs FROM o JOIN r USING (asset, chain, h, k) WHERE kept GROUP BY 1, 2, 3 HAVING count(*) >= 5),
    p AS (SELECT *, {_two_tails('s', 'n', 'bs', 'bn')} AS p_value FROM n JOIN m USING (asset, h)), q AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY p_value) AS i, count(*) OVER (PARTITION BY asset) AS c FROM p)
    SELECT asset, chain, h::INT AS horizon, n AS occurrences, round(s / n, 6) AS rate, round(bs / bn, 6) AS baseline, round(p_value, 6) AS p_value, round(xs[n // 2 + 1], 6) AS median_return_pct, coalesce(p_value <= max(CASE WHEN p_value <= i * 0.05 / c THEN p_value END) OVER (PARTITION BY asset), false) AS significant FROM q""",
)
def chain_statistics(spark, sf):
    """Jumps, falls and busy hours as detections; chains of two and three within six hours."""
    from pyspark.sql import Window

    w = Window.partitionBy("asset").orderBy("open_time")
    b = event_bars(spark, sf)
    last = F.lag("close").over(w)
    kind = F.when(F.col("close") > 1.5 * last, "jump").when(F.col("close") * 1.5 < last, "fall").when(F.col("volume") >= 5, "busy")
    found = b.select("asset", "source", "timeframe", (F.row_number().over(w) - 1).alias("bar"), kind.alias("kind")).where("kind IS NOT NULL")
    out = p.chain_statistics(b, found, horizons=(6, 12), within=6)
    return rounded(out.drop("source", "timeframe"))


@query(
    "ranked_statistics",
    f"""WITH s AS ({registered_sql("chain_statistics")}), e AS (SELECT *, round(rate - baseline, 6) AS edge FROM s),
    k AS (SELECT asset, chain, horizon, edge, p_value, significant AS informative, row_number() OVER (PARTITION BY asset ORDER BY p_value, asset, chain, horizon) AS place, row_number() OVER (PARTITION BY asset, significant ORDER BY CASE WHEN significant THEN -abs(edge) ELSE p_value END, asset, chain, horizon) AS place_in_group FROM e)
    SELECT asset, chain, horizon, edge, p_value, informative, place::INT AS place, place_in_group::INT AS place_in_group FROM k WHERE place <= 40""",
)
def ranked_statistics(spark, sf):
    """The measured chains of each asset in the order in which they are shown, forty at most."""
    stats = chain_statistics(spark, sf).select("asset", "chain", "horizon", F.round(F.col("rate") - F.col("baseline"), 6).alias("edge"), "p_value", F.col("significant").alias("informative"))
    return rec.ranked_statistics(stats, ("asset",), first=40)
