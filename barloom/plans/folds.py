"""Queries that fold series bar by bar with the streams' own state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.numbers import rounded
from barloom.operators.levels import vector
from barloom.plans import alerts as _alerts
from barloom.plans import bars as _bars  # noqa: F401  its SQL is used below
from barloom.plans.registry import query, registered_sql
from barloom.plans.sql import bars as sql_bars
from barloom.sources.bars import event_bars
from barloom.streaming import features

_SHOWN = (
    "true_range", "sma_20", "sma_50", "sma_200", "realised_vol_20", "bb_upper", "bb_percent_b", "bb_bandwidth", "stoch_k", "stoch_d", "obv", "obv_change_20", "vwap", "vwap_distance_pct", "roc_10", "ema_9", "ema_21", "atr_14", "atr_pct", "rsi_14",
)
#: Bars that are delivered again after the warm-up, and refused.
_AGAIN = 10


@query(
    "folded_features",
    f"""WITH w AS ({registered_sql("indicators_windowed")}), r AS ({registered_sql("indicators_recursive")}), n AS (WITH {sql_bars()} SELECT asset, open_time, row_number() OVER (PARTITION BY asset ORDER BY open_time) AS bars_seen, count(*) OVER (PARTITION BY asset) AS n FROM bars)
    SELECT asset, open_time, bars_seen, least({_AGAIN}, n // 2)::BIGINT AS refused, {", ".join(_SHOWN)} FROM n JOIN w USING (asset, open_time) JOIN r USING (asset, open_time) WHERE bars_seen > n // 2 AND bars_seen >= 200""",
)
def folded_features(spark, sf):
    """The second half of each series through the streaming fold, warmed up from the first half."""
    spark.conf.set(features.STATE_STORE, features.ROCKSDB)
    series = Window.partitionBy("asset")
    b = event_bars(spark, sf).withColumn("is_final", F.lit(True)).withColumn("at", F.row_number().over(series.orderBy("open_time"))).withColumn("half", F.floor(F.count("*").over(series) / 2))
    stored = features.history(b.where("at <= half"), most=None)
    out = features.folded(b.where(F.col("at") > F.col("half") - _AGAIN), "1h", stored)
    return rounded(out.select("asset", "open_time", "bars_seen", "refused", *_SHOWN))


@query(
    "feature_columns",
    f"""WITH v AS ({registered_sql("feature_vectors")}), w AS ({registered_sql("indicators_windowed")}), r AS ({registered_sql("indicators_recursive")})
    SELECT asset, open_time, {", ".join(_SHOWN)}, range_pct, change_pct, structure_trend FROM v JOIN w USING (asset, open_time) JOIN r USING (asset, open_time)""".replace(", sma_20,", ", w.sma_20,"),
)
def feature_columns(spark, sf):
    """The columns of a stored feature vector that SQL can say, of every bar from the two hundredth on."""
    out = _alerts.unguarded(vector(event_bars(spark, sf), "1h"))
    return rounded(out.select("asset", "open_time", *_SHOWN, "range_pct", "change_pct", "structure_trend"))
