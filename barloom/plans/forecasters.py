"""Queries on forecasters whose inputs are stored: funding, states, moods, measured patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.numbers import rounded
from barloom.operators import evaluation as e
from barloom.operators import models as m
from barloom.plans.news import _CAT, _stored_news
from barloom.plans.reads import _DER, derivatives
from barloom.plans.registry import query
from barloom.plans.stored import _FC, _WEIGHTS, forecasts, scored


def _up(edge: str) -> str:
    return f"0.66 * (0.5 + greatest(-1, least(1, {edge})) / 2)"


@query(
    "order_flow_forecasts",
    f"""WITH {_DER}, w AS (SELECT asset, ts, rate, list(rate) OVER o AS xs, median(rate) OVER o AS c FROM der WINDOW o AS (PARTITION BY asset ORDER BY ts ROWS 59 PRECEDING)), s AS (SELECT *, list_aggregate(list_transform(xs, lambda x: abs(x - c)), 'median') * 1.4826 AS sc FROM w), z AS (SELECT *, CASE WHEN len(xs) >= 10 AND sc > 0 THEN (rate - c) / sc END AS z FROM s)
    SELECT asset, ts, round(CASE WHEN abs(z) >= 1.5 THEN {_up('-tanh(z / 3) * 0.4')} ELSE 1 / 3.0 END, 6) AS up, round(CASE WHEN abs(z) >= 1.5 THEN 0.18 + least(0.25, (abs(z) - 1.5) / 6) ELSE 0 END, 4) AS confidence FROM z""",
)
def order_flow_forecasts(spark, sf):
    out = m.built(m.order_flow(derivatives(spark, sf).select("asset", "ts", "rate")).withColumn("threshold", F.lit(1.0)))
    return rounded(out.select("asset", "ts", "p.up", "confidence"))


@query(
    "regime_forecasts",
    f"""WITH {_FC}, r AS (SELECT model, asset, as_of, (pu - pd) * (0.4 + 0.6 * confidence) AS e, regime = 'range' AS torn, confidence AS c, quality FROM fc)
    SELECT model, asset, as_of, round(CASE WHEN torn THEN 0.6 / 3 + 0.4 * {_up('e * 0.2')} ELSE {_up('e * 0.55')} END, 6) AS up, round(CASE WHEN torn THEN 0.15 ELSE 0.2 + 0.4 * c END * quality, 4) AS confidence FROM r""",
)
def regime_forecasts(spark, sf):
    """Stored statements as states: their edge is the bias, their confidence the agreement, ranges are conflicted."""
    f = forecasts(spark, sf).withColumn("bias_score", F.col("p.up") - F.col("p.down")).withColumn("agreement", F.col("confidence")).withColumn("alignment", F.when(F.col("regime") == "range", "conflicted").otherwise("aligned"))
    return rounded(m.built(m.regime_model(f), F.col("data_quality")).select("model", "asset", "as_of", "p.up", "confidence"))


@query(
    "sentiment_forecasts",
    f"""WITH {_CAT}, g AS (SELECT category, sum(w * s) / sum(w) AS x FROM (SELECT category, n_chars % 10 / 10 AS w, (n_chars % 21 - 10) / 10 AS s FROM cat) GROUP BY 1) SELECT category, round({_up('tanh(x * 1.5) * 0.35')}, 6) AS up, round(least(0.25, 0.1 + abs(x) * 0.3), 4) AS confidence FROM g""",
)
def sentiment_forecasts(spark, sf):
    from barloom.operators.news import mood

    sizes = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("item_id"), "n_chars")
    news = _stored_news(spark, sf).join(sizes, "item_id").withColumn("confidence", F.lit(1.0)).withColumn("sentiment_score", (F.col("n_chars") % 21 - 10) / 10)
    out = m.built(m.sentiment_model(mood(news, ("category",)).withColumn("threshold", F.lit(1.0))))
    return rounded(out.select("category", "p.up", "confidence"))


@query(
    "sequence_forecasts",
    f"""WITH {_WEIGHTS}, d AS (SELECT asset, as_of, model FROM fc WHERE confidence > 0.3 AND model <> 'baseline_climatology'), g AS (SELECT d.asset, d.as_of, sum(skill) AS e, count(skill) AS n FROM d LEFT JOIN (SELECT * FROM w4 WHERE slice = 'all' AND weight > 0) k ON k.asset = d.asset AND k.model = d.model GROUP BY 1, 2)
    SELECT asset, as_of, n AS measured, round(CASE WHEN n > 0 THEN {_up('tanh(e * 3) * 0.5')} ELSE 1 / 3.0 END, 6) AS up, round(CASE WHEN n > 0 THEN 0.2 + least(0.3, n * 0.1) ELSE 0 END, 4) AS confidence FROM g""",
)
def sequence_forecasts(spark, sf):
    """Sure statements as detections; the models that earned a weight over all have a measured edge."""
    found = forecasts(spark, sf).where("confidence > 0.3 AND model <> 'baseline_climatology'").select("asset", "as_of", "model")
    measured = e.learned_weights(scored(spark, sf)).where("slice = 'all' AND weight > 0").select("asset", "model", F.col("skill").alias("edge"))
    out = m.built(m.sequence_model(found, measured, ("asset", "as_of"), ("asset", "model")).withColumn("threshold", F.lit(1.0)))
    return rounded(out.select("asset", "as_of", "measured", "p.up", "confidence"))


@query(
    "admitted_patterns",
    f"""WITH {_WEIGHTS} SELECT f.asset, count(*) AS admitted FROM fc f JOIN (SELECT asset, model FROM w4 WHERE slice = 'all' AND weight > 0) k ON k.asset = f.asset AND k.model = f.model GROUP BY 1""",
)
def admitted_patterns(spark, sf):
    """Of the stored statements those of models whose statistics were found informative."""
    from barloom.operators.records import admitted

    stats = e.learned_weights(scored(spark, sf)).where("slice = 'all'").select("asset", "model", (F.col("weight") > 0).alias("informative"))
    return admitted(forecasts(spark, sf), stats, ("asset", "model")).groupBy("asset").agg(F.count("*").alias("admitted"))


@query(
    "distribution_measures",
    f"""WITH {_FC}, b AS (SELECT *, list_transform([pu, pf, pd], lambda x: CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END) AS h FROM fc)
    SELECT model, asset, as_of, round(h[1] + h[2] + h[3], 6) AS entropy, CASE WHEN pu >= pf AND pu >= pd THEN 'up' WHEN pf >= pd THEN 'flat' ELSE 'down' END AS most_likely, CASE WHEN confidence < 0.15 THEN 'very_low' WHEN confidence < 0.3 THEN 'low' WHEN confidence < 0.55 THEN 'normal' WHEN confidence < 1 THEN 'high' ELSE 'very_high' END AS bucket FROM b""",
)
def distribution_measures(spark, sf):
    f = forecasts(spark, sf)
    return rounded(f.select("model", "asset", "as_of", m.entropy(F.col("p")).alias("entropy"), m.most_likely(F.col("p")).alias("most_likely"), m.volatility_bucket(F.col("confidence")).alias("bucket")))
