"""Queries on bars: roll-ups, scans, coverage, as-of and range reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.grid import expected_count, plus
from barloom.functions.numbers import rounded
from barloom.operators.indicators import recursive, windowed
from barloom.plans.registry import query
from barloom.plans.sql import bars as sql_bars
from barloom.plans.sql import r
from barloom.sources.bars import event_bars, rollup_bars

BAR = "asset, open_time, open, high, low, close, volume, quote_volume, trades"
_BAR = ", ".join([*BAR.split(", ")[:6], "volume", r("quote_volume", "quote_volume"), "trades"])


@query("bars_1h", f"WITH {sql_bars()} SELECT {_BAR} FROM bars")
def bars_1h(spark, sf):
    return rounded(event_bars(spark, sf).select(*BAR.split(", ")))


@query("bars_1d_from_1h", f"WITH {sql_bars('1d')} SELECT {_BAR} FROM bars")
def bars_1d(spark, sf):
    return rounded(rollup_bars(event_bars(spark, sf), "1d").select(*BAR.split(", ")))


@query(
    "bars_1w_of_shipments",
    """SELECT l_returnflag AS asset, time_bucket(INTERVAL '1 week', l_shipdate, TIMESTAMP '1970-01-05') AS open_time,
    round(arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)), 6) AS open, round(max(l_extendedprice / l_quantity), 6) AS high,
    round(min(l_extendedprice / l_quantity), 6) AS low, round(arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)), 6) AS close, count(*) AS trades
    FROM lineitem GROUP BY 1, 2""",
)
def bars_1w(spark, sf):
    from barloom.sources.bars import rollup_ticks

    t = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("asset"), F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_orderkey", "l_linenumber")
    return rounded(rollup_ticks(t, "1w", order=("ts", "l_orderkey", "l_linenumber")).select("asset", "open_time", "open", "high", "low", "close", "trades"))


@query(
    "coverage",
    f"""WITH {sql_bars()} SELECT asset, count(*) AS n, min(open_time) AS first, max(open_time) AS last,
    (date_diff('hour', min(open_time), max(open_time)) + 1)::BIGINT AS expected,
    round(count(*) / (date_diff('hour', min(open_time), max(open_time)) + 1), 4) AS completeness FROM bars GROUP BY asset""",
)
def coverage(spark, sf):
    b = event_bars(spark, sf).groupBy("asset").agg(F.count("*").alias("n"), F.min("open_time").alias("first"), F.max("open_time").alias("last"))
    n = expected_count(F.col("first"), plus(F.col("last"), "1h"), "1h")
    return b.withColumn("expected", n.cast("long")).withColumn("completeness", F.round(F.col("n") / F.col("expected"), 4))


@query(
    "gaps",
    f"""WITH {sql_bars()}, e AS (SELECT asset, min(open_time) AS a, max(open_time) AS b FROM bars GROUP BY asset),
    g AS (SELECT asset, unnest(generate_series(a, b, INTERVAL '1 hour')) AS t FROM e),
    m AS (SELECT g.asset, t, row_number() OVER (PARTITION BY g.asset ORDER BY t) AS k FROM g ANTI JOIN bars ON g.asset = bars.asset AND g.t = bars.open_time)
    SELECT asset, min(t) AS start, max(t) + INTERVAL '1 hour' AS stop, count(*) AS missing FROM m GROUP BY asset, t - k * INTERVAL '1 hour'""",
)
def gaps(spark, sf):
    from barloom.operators.quality import gap_runs

    return gap_runs(event_bars(spark, sf), "1h").select("asset", "start", "stop", "missing")


@query(
    "newest_bars",
    f"WITH {sql_bars()} SELECT asset, open_time, close FROM bars QUALIFY row_number() OVER (PARTITION BY asset ORDER BY open_time DESC) <= 50",
)
def newest(spark, sf):
    from barloom.operators.store import newest_n

    return newest_n(event_bars(spark, sf), 50).select("asset", "open_time", "close")


@query(
    "as_of_features",
    f"""WITH {sql_bars()}, w AS (SELECT asset, open_time, close, avg(close) OVER (PARTITION BY asset ORDER BY open_time ROWS 19 PRECEDING) AS m FROM bars)
    SELECT event_id, event_type AS asset, ts, w.open_time AS feature_time, w.close AS feature_close, round(w.m, 6) AS mean_20
    FROM events LEFT JOIN LATERAL (SELECT * FROM w WHERE w.asset = event_type AND w.open_time + INTERVAL '1 hour' <= ts ORDER BY w.open_time DESC LIMIT 1) w ON true""",
)
def as_of_features(spark, sf):
    from pyspark.sql import Window

    from barloom.operators.asof import last_before

    w = Window.partitionBy("asset").orderBy("open_time").rowsBetween(-19, 0)
    b = event_bars(spark, sf).select("asset", F.col("open_time").alias("feature_time"), F.col("close").alias("feature_close"), F.avg("close").over(w).alias("mean_20"))
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("event_type").alias("asset"), "ts")
    return rounded(last_before(e, b.withColumn("known", plus(F.col("feature_time"), "1h")), ["asset"], "ts", "known", ["feature_time", "feature_close", "mean_20"]))


@query(
    "indicators_windowed",
    f"""WITH {sql_bars()}, s AS (SELECT *, lag(close) OVER o AS p, lag(close, 10) OVER o AS p10, row_number() OVER o AS bars_seen,
      avg(close) OVER w20 AS m, stddev_pop(close) OVER w20 AS sd, min(low) OVER w14 AS lo, max(high) OVER w14 AS hi,
      sum((high + low + close) / 3 * volume) OVER d AS pv, sum(volume) OVER d AS v,
      avg(close) OVER w50 AS m50, avg(close) OVER w200 AS m200
      FROM bars WINDOW o AS (PARTITION BY asset ORDER BY open_time), w20 AS (PARTITION BY asset ORDER BY open_time ROWS 19 PRECEDING), w14 AS (PARTITION BY asset ORDER BY open_time ROWS 13 PRECEDING),
      w50 AS (PARTITION BY asset ORDER BY open_time ROWS 49 PRECEDING), w200 AS (PARTITION BY asset ORDER BY open_time ROWS 199 PRECEDING),
      d AS (PARTITION BY asset, open_time::DATE ORDER BY open_time ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT *, ln(close / p) AS lg, CASE WHEN p IS NULL THEN 0 WHEN close > p THEN volume WHEN close < p THEN -volume ELSE 0 END AS flow,
      CASE WHEN bars_seen >= 14 THEN CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 ELSE 50 END END AS k FROM s),
    u AS (SELECT *, sum(flow) OVER (PARTITION BY asset ORDER BY open_time ROWS UNBOUNDED PRECEDING) AS obv, stddev_pop(lg) OVER w20 AS rv, avg(k) OVER w3 AS kd, count(k) OVER w3 AS kn
      FROM t WINDOW w20 AS (PARTITION BY asset ORDER BY open_time ROWS 19 PRECEDING), w3 AS (PARTITION BY asset ORDER BY open_time ROWS 2 PRECEDING))
    SELECT asset, open_time, round(CASE WHEN p IS NULL THEN high - low ELSE greatest(high - low, abs(high - p), abs(low - p)) END, 6) AS true_range,
      round(CASE WHEN bars_seen >= 20 THEN m END, 6) AS sma_20, round(CASE WHEN bars_seen >= 50 THEN m50 END, 6) AS sma_50, round(CASE WHEN bars_seen >= 200 THEN m200 END, 6) AS sma_200,
      round(CASE WHEN bars_seen >= 21 THEN rv * sqrt(8760) * 100 END, 6) AS realised_vol_20,
      round(CASE WHEN bars_seen >= 20 THEN m + 2 * sd END, 6) AS bb_upper, round(CASE WHEN bars_seen >= 20 THEN (close - m + 2 * sd) / (4 * sd) END, 6) AS bb_percent_b,
      round(CASE WHEN bars_seen >= 20 THEN 4 * sd / m * 100 END, 6) AS bb_bandwidth,
      round(CASE WHEN kn = 3 THEN k END, 6) AS stoch_k, round(CASE WHEN kn = 3 THEN kd END, 6) AS stoch_d, obv,
      CASE WHEN bars_seen > 20 THEN obv - lag(obv, 20) OVER (PARTITION BY asset ORDER BY open_time) END AS obv_change_20,
      round(pv / v, 6) AS vwap, round((close - pv / v) / (pv / v) * 100, 6) AS vwap_distance_pct, round((close - p10) / p10 * 100, 6) AS roc_10 FROM u""",
)
def indicators_windowed(spark, sf):
    out = windowed(event_bars(spark, sf), "1h")
    return rounded(out.select("asset", "open_time", "true_range", "sma_20", "sma_50", "sma_200", "realised_vol_20", "bb_upper", "bb_percent_b", "bb_bandwidth", "stoch_k", "stoch_d", "obv", "obv_change_20", "vwap", "vwap_distance_pct", "roc_10"))


@query(
    "indicators_recursive",
    f"""WITH RECURSIVE {sql_bars()}, o AS (SELECT asset, open_time, high, low, close, row_number() OVER w AS rn, close - lag(close) OVER w AS d,
      coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr FROM bars WINDOW w AS (PARTITION BY asset ORDER BY open_time)),
    s AS (SELECT *, avg(close) OVER (PARTITION BY asset ORDER BY rn ROWS 8 PRECEDING) AS c9, avg(close) OVER (PARTITION BY asset ORDER BY rn ROWS 20 PRECEDING) AS c21,
      avg(tr) OVER w AS t14, avg(greatest(d, 0)) OVER w AS g14, avg(greatest(-d, 0)) OVER w AS l14 FROM o WINDOW w AS (PARTITION BY asset ORDER BY rn ROWS 13 PRECEDING)),
    f AS (SELECT asset, rn, NULL::DOUBLE AS e9, NULL::DOUBLE AS e21, NULL::DOUBLE AS a, NULL::DOUBLE AS g, NULL::DOUBLE AS l FROM s WHERE rn = 1
      UNION ALL SELECT s.asset, s.rn, CASE WHEN s.rn = 9 THEN c9 ELSE e9 + 2.0 / 10 * (close - e9) END, CASE WHEN s.rn = 21 THEN c21 ELSE e21 + 2.0 / 22 * (close - e21) END,
        CASE WHEN s.rn = 14 THEN t14 ELSE a + (tr - a) / 14 END, CASE WHEN s.rn = 15 THEN g14 ELSE g + (greatest(d, 0) - g) / 14 END, CASE WHEN s.rn = 15 THEN l14 ELSE l + (greatest(-d, 0) - l) / 14 END
        FROM f JOIN s ON s.asset = f.asset AND s.rn = f.rn + 1)
    SELECT s.asset, s.open_time, round(e9, 6) AS ema_9, round(e21, 6) AS ema_21, round(a, 6) AS atr_14, round(a / close * 100, 6) AS atr_pct,
      round(CASE WHEN g IS NOT NULL THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END, 6) AS rsi_14 FROM s JOIN f USING (asset, rn)""",
)
def indicators_recursive(spark, sf):
    return rounded(recursive(event_bars(spark, sf)).select("asset", "open_time", "ema_9", "ema_21", "atr_14", "atr_pct", "rsi_14"))


@query(
    "asset_grid",
    f"""WITH {sql_bars()}, w AS (SELECT *, lag(close, 24) OVER (PARTITION BY asset ORDER BY open_time) AS old, abs(close - lag(close) OVER (PARTITION BY asset ORDER BY open_time)) / lag(close) OVER (PARTITION BY asset ORDER BY open_time) * 100 AS ret,
      row_number() OVER (PARTITION BY asset ORDER BY open_time DESC) AS k, count(*) OVER (PARTITION BY asset) AS n FROM bars)
    SELECT asset, max(CASE WHEN k = 1 THEN open_time END) AS open_time, round(max(CASE WHEN k = 1 THEN close END), 6) AS price, round(max(CASE WHEN k = 1 THEN (close - old) / old * 100 END), 6) AS change_24,
      round(median(CASE WHEN k <= 200 THEN ret END), 6) AS median_move, max(n) AS bars FROM w GROUP BY asset""",
)
def asset_grid(spark, sf):
    from pyspark.sql import Window

    o = Window.partitionBy("asset").orderBy("open_time")
    last = F.lag("close").over(o)
    w = event_bars(spark, sf).select(
        "asset", "open_time", "close", F.lag("close", 24).over(o).alias("old"), (F.abs(F.col("close") - last) / last * 100).alias("ret"),
        F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("open_time"))).alias("k"),
    )
    newest = F.col("k") == 1
    out = w.groupBy("asset").agg(
        F.max(F.when(newest, F.col("open_time"))).alias("open_time"),
        F.max(F.when(newest, F.col("close"))).alias("price"),
        F.max(F.when(newest, (F.col("close") - F.col("old")) / F.col("old") * 100)).alias("change_24"),
        F.percentile(F.when(F.col("k") <= 200, F.col("ret")), F.lit(0.5)).alias("median_move"),
        F.count("*").alias("bars"),
    )
    return rounded(out)
