"""Queries on structure, analogues and alerts."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from barloom.functions.numbers import divided, rounded
from barloom.operators import alerts as a
from barloom.operators import levels, similarity
from barloom.operators.indicators import recursive, windowed
from barloom.operators.models import coarse_regime
from barloom.plans.registry import query, registered_sql
from barloom.plans.sql import bars as sql_bars
from barloom.plans.stored import _PANEL
from barloom.sources.bars import event_bars
from barloom.sources.tables import stored


@query("market_structure")
def market_structure(spark, sf):
    out = levels.structure(event_bars(spark, sf))
    return rounded(out.select("asset", "open_time", "trend", F.size("levels").alias("n_levels"), "support", "resistance", "support_pct", "resistance_pct", "poc", "value_low", "value_high"))


@query(
    "price_levels",
    f"""WITH RECURSIVE {sql_bars()}, w AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY open_time) - 1 AS bar, count(*) OVER a AS n, list(high) OVER a AS hs, list(low) OVER a AS ls FROM bars WINDOW a AS (PARTITION BY asset ORDER BY open_time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    s AS (SELECT asset, bar, high AS price FROM w WHERE n = 5 AND high = list_max(hs) AND len(list_filter(hs, lambda x: x = high)) = 1 UNION ALL SELECT asset, bar, low FROM w WHERE n = 5 AND low = list_min(ls) AND len(list_filter(ls, lambda x: x = low)) = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY price, bar) AS k FROM s),
    c AS (SELECT asset, k, price, price AS first FROM o WHERE k = 1 UNION ALL SELECT o.asset, o.k, o.price, CASE WHEN (o.price - c.first) / c.first * 100 <= 0.5 THEN c.first ELSE o.price END FROM c JOIN o ON o.asset = c.asset AND o.k = c.k + 1)
    SELECT asset, round(avg(price), 6) AS price, count(*)::INT AS touches FROM c GROUP BY asset, first HAVING count(*) >= 2""",
)
def price_levels(spark, sf):
    """All swings of a series as levels."""
    from pyspark.sql import Window

    from barloom.operators.patterns import swings

    b = swings(event_bars(spark, sf)).withColumn("bar", F.row_number().over(Window.partitionBy("asset").orderBy("open_time")) - 1)
    points = F.concat(F.collect_list(F.when(F.col("swing_high"), F.struct(F.col("high").alias("price"), "bar"))), F.collect_list(F.when(F.col("swing_low"), F.struct(F.col("low").alias("price"), "bar"))))
    found = b.groupBy("asset").agg(points.alias("p")).select("asset", F.inline(levels.clusters(F.col("p"))))
    return rounded(found.select("asset", "price", "touches"))


@query("analogues")
def analogues(spark, sf):
    """Every bar divisible by 50, and the newest bar of every asset, against all earlier ones, for two horizons."""
    b = event_bars(spark, sf)
    f = recursive(windowed(b, "1h")).withColumn("bar", F.col("bars_seen") - 1)
    asked = f.groupBy(*similarity.KEY).agg(F.max("bar").alias("bar")).unionByName(f.where("bar % 50 = 0").select(*similarity.KEY, "bar"))
    out = None
    for h in (12, 48):
        v = similarity.verdicts(similarity.analogues(f, asked, h), b, h).withColumn("horizon", F.lit(h))
        out = v if out is None else out.unionByName(v)
    return rounded(out.drop("source", "timeframe"))


@query(
    "volume_alerts",
    f"""WITH {sql_bars()}, v AS (SELECT asset, open_time, volume, list(volume) OVER w AS xs, median(volume) OVER w AS c FROM bars WHERE volume > 0 WINDOW w AS (PARTITION BY asset ORDER BY open_time ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)),
    z AS (SELECT asset, open_time, (volume - c) / nullif(list_aggregate(list_transform(xs, lambda x: abs(x - c)), 'median') * 1.4826, 0) AS z FROM v WHERE len(xs) >= 30) SELECT asset, open_time AS at, 'volume_anomaly' AS kind, 20 AS level, round(z, 6) AS value FROM z WHERE z >= 2.5""",
)
def volume_alerts(spark, sf):
    return rounded(a.volume_rule(event_bars(spark, sf), 2.5).select("asset", "at", "kind", "level", "value"))


@query(
    "volatility_alerts",
    f"""WITH {sql_bars()}, t AS (SELECT asset, open_time, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS t FROM bars WINDOW w AS (PARTITION BY asset ORDER BY open_time)),
    r AS (SELECT asset, open_time, count(t) OVER h AS n, median(t) OVER f / median(t) OVER h AS q FROM t WINDOW f AS (PARTITION BY asset ORDER BY open_time ROWS 13 PRECEDING), h AS (PARTITION BY asset ORDER BY open_time ROWS 99 PRECEDING))
    SELECT asset, open_time AS at, CASE WHEN q >= 1.3 THEN 'volatility_expansion' ELSE 'volatility_compression' END AS kind, round(q, 6) AS value FROM r WHERE n >= 100 AND (q >= 1.3 OR q <= 0.7)""",
)
def volatility_alerts(spark, sf):
    return rounded(a.volatility_rule(event_bars(spark, sf), 1.3, 0.7).select("asset", "at", "kind", "value"))


def _rules(spark, sf):
    """All rules over the given tables, by name; each is planned when it is called."""
    from barloom.operators.ensemble import gate
    from barloom.operators.models import contexts

    b = event_bars(spark, sf)
    calls = cache(lambda: stored(_calls(spark, sf)))  # two rules read the panel
    return {
        "volume": lambda: a.volume_rule(b, 2.5),
        "volatility": lambda: a.volatility_rule(b, 1.3, 0.7),
        "regime": lambda: a.regime_rule(coarse_regime(b).withColumnRenamed("open_time", "at")),
        "correlation": lambda: a.correlation_rule(a.rolling_pairs(contexts(b, 1)), 0.05),
        "liquidation": lambda: a.liquidation_rule(_interest(spark, sf), 30.0, 60.0),
        "data quality": lambda: a.quality_rule(_day_scores(spark, sf)),
        "disagreement": lambda: a.disagreement_rule(calls()),
        "news": lambda: a.news_rule(_big_news(spark, sf)),
        "predictions": lambda: a.prediction_rules(gate(calls())),
        "invalidation": lambda: a.invalidation_rule(_open_calls(spark, sf)),
    }


def _run(spark, sf):
    """Who follows an asset is one recipient; news goes to sixteen desks."""
    desk = F.when(F.col("kind") == "major_news", F.concat(F.lit("desk "), F.pmod(F.crc32(F.col("asset").cast("binary")), F.lit(16)).cast("string"))).otherwise(F.concat(F.lit("follower of "), "asset"))
    return a.run(_rules(spark, sf), desk, spark)


@query("admitted_alerts")
def admitted_alerts(spark, sf):
    """All rules' alerts through the rate budget, with the digests of what was held."""
    return rounded(_run(spark, sf)[0])


@query("suppression_digests")
def suppression_digests(spark, sf):
    """What each recipient was told of the alerts that were held."""
    return _run(spark, sf)[0].where("kind = 'suppression_digest'").select("recipient", "at", "title", "value")


@query(
    "regime_alerts",
    f"""WITH {sql_bars()}, w AS (SELECT asset, open_time, close, row_number() OVER o AS rn, count(*) OVER (PARTITION BY asset ORDER BY open_time ROWS 99 PRECEDING) AS n, first(close) OVER (PARTITION BY asset ORDER BY open_time ROWS 99 PRECEDING) AS old, abs(close - lag(close) OVER o) / lag(close) OVER o AS ret FROM bars WINDOW o AS (PARTITION BY asset ORDER BY open_time)),
    l AS (SELECT *, list_sort(list_filter(list(ret) OVER (PARTITION BY asset ORDER BY rn ROWS 98 PRECEDING), lambda x: x IS NOT NULL)) AS xs FROM w), v AS (SELECT *, xs[len(xs) // 2 + 1] AS noise FROM l), x AS (SELECT *, (close - old) / old / (noise * sqrt(n)) AS drift FROM v),
    g AS (SELECT asset, open_time, CASE WHEN n < 20 THEN 'unknown' ELSE CASE WHEN abs(drift) < 0.5 THEN 'range' WHEN drift > 0 THEN 'uptrend' ELSE 'downtrend' END || CASE WHEN noise > 0.004 THEN '_high_vol' ELSE '_low_vol' END END AS regime FROM x),
    p AS (SELECT *, lag(regime) OVER (PARTITION BY asset ORDER BY open_time) AS b FROM g) SELECT asset, open_time AS at, asset || ': ' || b || ' to ' || regime AS title FROM p WHERE b <> regime AND b <> 'unknown' AND regime <> 'unknown'""",
)
def regime_alerts(spark, sf):
    states = coarse_regime(event_bars(spark, sf)).withColumnRenamed("open_time", "at")
    return a.regime_rule(states).select("asset", "at", "title")


@query(
    "correlation_alerts",
    f"""WITH {sql_bars()}, x AS (SELECT asset, open_time, (close - lag(close) OVER w) / lag(close) OVER w * 100 AS ret FROM bars WINDOW w AS (PARTITION BY asset ORDER BY open_time)), j AS (SELECT p.asset, q.asset AS peer, p.open_time AS t, p.ret AS x, q.ret AS y FROM x p JOIN x q ON p.open_time = q.open_time AND p.asset <> q.asset WHERE p.ret IS NOT NULL AND q.ret IS NOT NULL),
    c AS (SELECT asset, peer, t, corr(x, y) OVER (PARTITION BY asset, peer ORDER BY t ROWS 23 PRECEDING) AS a, corr(x, y) OVER (PARTITION BY asset, peer ORDER BY t ROWS 167 PRECEDING) AS b, row_number() OVER (PARTITION BY asset, peer ORDER BY t) AS n FROM j)
    SELECT asset, t AS "at", round(b - a, 4) AS value FROM c WHERE n >= 168 AND b >= 0.05 AND b - a >= 0.35""",
)
def correlation_alerts(spark, sf):
    from barloom.operators.models import contexts

    pairs = a.rolling_pairs(contexts(event_bars(spark, sf), 1))
    return a.correlation_rule(pairs, 0.05).select("asset", "at", F.round("value", 4).alias("value"))


@query(
    "liquidation_alerts",
    f"""WITH {sql_bars()}, d AS (SELECT asset, open_time AS t, close, trades::DOUBLE * 10 + 100 AS oi, row_number() OVER (PARTITION BY asset ORDER BY open_time) AS n FROM bars), w AS (SELECT *, max(oi) OVER (PARTITION BY asset ORDER BY t ROWS 23 PRECEDING) AS peak, first(close) OVER (PARTITION BY asset ORDER BY t ROWS 5 PRECEDING) AS old FROM d)
    SELECT asset, t AS "at", round((peak - oi) / peak * 100, 6) AS value FROM w WHERE n >= 6 AND (peak - oi) / peak * 100 >= 30 AND abs(close - old) / old * 100 >= 60""",
)
def liquidation_alerts(spark, sf):
    return rounded(a.liquidation_rule(_interest(spark, sf), 30.0, 60.0).select("asset", "at", "value"))


@query("data_quality_alerts", "WITH s AS (SELECT event_type AS asset, date_trunc('day', ts)::TIMESTAMP AS t, count(*) / 80 AS score FROM events GROUP BY 1, 2) SELECT asset, t AS \"at\", printf('data quality degraded to %.2f', score) AS title FROM s WHERE score < 0.7")
def data_quality_alerts(spark, sf):
    return a.quality_rule(_day_scores(spark, sf)).select("asset", "at", "title")


def _interest(spark, sf):
    return event_bars(spark, sf).select("asset", F.col("open_time").alias("at"), "close", (F.col("trades") * 10 + 100).cast("double").alias("open_interest"))


def _day_scores(spark, sf):
    """Days with few events have a low score."""
    return spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("event_type").alias("asset"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at")).agg((F.count("*") / 80).alias("score"))


def _calls(spark, sf):
    from barloom.plans.stored import _panel

    return _panel(spark, sf).withColumnRenamed("as_of", "at").withColumn("at", F.col("at"))


@query("disagreement_alerts", f"WITH {_PANEL} SELECT asset, as_of AS \"at\", round(consensus, 4) AS value FROM pp WHERE split AND votes >= 4")
def disagreement_alerts(spark, sf):
    return a.disagreement_rule(_calls(spark, sf)).select("asset", "at", F.round("value", 4).alias("value"))


@query("prediction_alerts", f"WITH {_PANEL} SELECT asset, as_of AS \"at\", 'strong_prediction' AS kind, 30 AS level FROM pp WHERE published")
def prediction_alerts(spark, sf):
    from barloom.operators.ensemble import gate

    return a.prediction_rules(gate(_calls(spark, sf))).select("asset", "at", "kind", "level")


@query(
    "invalidation_alerts",
    f"""WITH {sql_bars()}, c AS (SELECT asset, open_time AS t, close, lag(close, 12) OVER w AS entry, open >= lag(open, 12) OVER w AS up FROM bars WINDOW w AS (PARTITION BY asset ORDER BY open_time))
    SELECT asset, t AS "at", CASE WHEN up THEN 'a published up call has been invalidated' ELSE 'a published down call has been invalidated' END AS title, round(CASE WHEN up THEN entry * 0.5 ELSE entry * 1.5 END, 6) AS value FROM c WHERE entry IS NOT NULL AND CASE WHEN up THEN close <= entry * 0.5 ELSE close >= entry * 1.5 END""",
)
def invalidation_alerts(spark, sf):
    return rounded(a.invalidation_rule(_open_calls(spark, sf)).select("asset", "at", "title", "value"))


def _open_calls(spark, sf):
    """Every bar is a call of twelve bars earlier that is still open, wrong when the price has halved or risen by half."""
    from pyspark.sql import Window

    w = Window.partitionBy("asset").orderBy("open_time")
    b = event_bars(spark, sf).select("asset", F.col("open_time").alias("at"), "close", F.lag("close", 12).over(w).alias("entry"), F.when(F.col("open") >= F.lag("open", 12).over(w), "up").otherwise("down").alias("direction"))
    return b.where("entry IS NOT NULL").withColumn("level", F.when(F.col("direction") == "up", F.col("entry") * 0.5).otherwise(F.col("entry") * 1.5))


@query("news_alerts", "SELECT doc_id AS item, substr(regexp_extract(text, '^([^.\\n]*)', 1), 1, 180) AS title FROM documents WHERE n_chars % 100 >= 75")
def news_alerts(spark, sf):
    return a.news_rule(_big_news(spark, sf)).select(F.col("asset").cast("long").alias("item"), "title")


def _big_news(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select(F.col("doc_id").cast("string").alias("asset"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("at"), (F.col("n_chars") % 100 / 100).alias("importance"), F.regexp_extract("text", r"^([^.\n]*)", 1).alias("title"))


_STRUCT = f"""WITH {sql_bars()}, n AS (SELECT asset, open_time, high, low, close, row_number() OVER w - 1 AS bar, count(*) OVER a AS c, list(high) OVER a AS hs, list(low) OVER a AS ls FROM bars WINDOW w AS (PARTITION BY asset ORDER BY open_time), a AS (PARTITION BY asset ORDER BY open_time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  s AS (SELECT *, CASE WHEN c = 5 AND high = list_max(hs) AND len(list_filter(hs, lambda x: x = high)) = 1 THEN high END AS sh, CASE WHEN c = 5 AND low = list_min(ls) AND len(list_filter(ls, lambda x: x = low)) = 1 THEN low END AS sl FROM n),
  w AS (SELECT asset, open_time, bar, close, list_filter(list(sh) OVER i, lambda x: x IS NOT NULL) AS h, list_filter(list(sl) OVER i, lambda x: x IS NOT NULL) AS l FROM s WINDOW i AS (PARTITION BY asset ORDER BY bar ROWS BETWEEN 117 PRECEDING AND 2 PRECEDING)),
  t AS (SELECT asset, open_time, bar, CASE WHEN len(h) < 2 OR len(l) < 2 THEN 0 WHEN h[-1] > h[-2] AND l[-1] > l[-2] THEN 1 WHEN h[-1] <= h[-2] AND l[-1] <= l[-2] THEN -1 ELSE 0 END AS trend FROM w WHERE bar >= 119 AND bar % 5 = 4)"""


@query("structure_trend", f"{_STRUCT} SELECT b.asset, b.open_time, last(t.trend IGNORE NULLS) OVER (PARTITION BY b.asset ORDER BY b.open_time ROWS UNBOUNDED PRECEDING) AS trend FROM bars b LEFT JOIN t USING (asset, open_time)")
def structure_trend(spark, sf):
    """Every bar with the trend of the newest analysis."""
    b = event_bars(spark, sf)
    return levels.carried(b, levels.structure(b)).select("asset", "open_time", "trend")


@query(
    "feature_vectors",
    f"""{_STRUCT}, c AS (SELECT b.asset, b.open_time, b.high, b.low, b.open, b.close, last(t.trend IGNORE NULLS) OVER w AS trend, row_number() OVER w AS n, avg(b.close) OVER (PARTITION BY b.asset ORDER BY b.open_time ROWS 19 PRECEDING) AS m FROM bars b LEFT JOIN t USING (asset, open_time) WINDOW w AS (PARTITION BY b.asset ORDER BY b.open_time ROWS UNBOUNDED PRECEDING))
    SELECT asset, open_time, round(m, 6) AS sma_20, round((high - low) / low * 100, 6) AS range_pct, round((close - open) / open * 100, 6) AS change_pct, trend::DOUBLE AS structure_trend FROM c WHERE n >= 200""",
)
def feature_vectors(spark, sf):
    return rounded(unguarded(levels.vector(event_bars(spark, sf), "1h")).select("asset", "open_time", "sma_20", "range_pct", "change_pct", "structure_trend"))


def unguarded(vectors):
    """Feature vectors whose range and change are divided as the SQL does, by a price of 0 too; the operator has 0 there."""
    pct = lambda x, of: divided(F.col(x) - F.col(of), F.col(of)) * 100
    return vectors.withColumn("range_pct", pct("high", "low")).withColumn("change_pct", pct("close", "open"))


@query(
    "budget_left",
    f"""WITH v AS ({registered_sql("volume_alerts")}), s AS (SELECT asset, "at", epoch("at") AS s FROM v),
    c AS (SELECT asset, "at", count(*) OVER (PARTITION BY asset ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS h, count(*) OVER (PARTITION BY asset ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS d FROM s)
    SELECT asset AS recipient, "at", greatest(0, 6 - h)::INT AS hour_left, greatest(0, 30 - d)::INT AS day_left FROM c""",
)
def budget_left(spark, sf):
    """What is left of the hour's and the day's budget after each alert, were all volume alerts sent to whoever follows the asset."""
    sent = a.volume_rule(event_bars(spark, sf), 2.5).select(F.col("asset").alias("recipient"), "at", F.lit("").alias("held"))
    return a.capacity(sent).select("recipient", "at", F.col("hour_left").cast("int").alias("hour_left"), F.col("day_left").cast("int").alias("day_left"))
