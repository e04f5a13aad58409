"""Small predicates and summaries over stored rows: derivatives, scores, forecasts, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event types that are faults of the pipeline and not of the market.
PIPELINE_FAULTS = ("provider_error", "empty_response", "provider_failover", "stale_data", "missing_bars")


def funding_annualised(rate: Column, interval_hours: Column) -> Column:
    """A funding rate as percent a year."""
    return rate * (8760 / interval_hours) * 100


def stablecoin_share(dominance: Column, coins: tuple[str, ...]) -> Column:
    """The summed shares of some coins in a map of coin to share; a missing coin has none."""
    return F.aggregate(F.transform(F.array(*map(F.lit, coins)), lambda c: F.coalesce(F.try_element_at(dominance, c), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)


def actionable(confidence: Column, p: Column) -> Column:
    """Whether a forecast says enough to act on."""
    return (confidence >= 0.35) & (F.abs(p["up"] - p["down"]) >= 0.08)


def state_usable(confidence: Column) -> Column:
    return confidence >= 0.25


def state_actionable(confidence: Column, conflicted: Column) -> Column:
    return (confidence >= 0.4) & ~conflicted


def score_summary(scores: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Mean and least score of each group, and which of its scopes (asset, timeframe) are degraded or unusable. Without `by` all scores are one group, none too."""
    scope = F.struct("asset", "timeframe")
    below = lambda x: F.transform(F.array_sort(F.collect_list(F.when(F.col("score") < x, scope))), lambda s: F.concat_ws("/", s["asset"], s["timeframe"]))
    return scores.groupBy(*by).agg(F.round(F.avg("score"), 4).alias("mean"), F.min("score").alias("least"), F.count("*").alias("n"), below(0.75).alias("degraded"), below(0.35).alias("unusable"))


def batch_verdicts(events: DataFrame, batch: tuple[str, ...]) -> DataFrame:
    """Of each batch the number of events, whether one is an error, and whether one is a fault of the pipeline."""
    return events.groupBy(*batch).agg(F.count("*").alias("events"), F.max((F.col("severity") == "error").cast("int")).cast("boolean").alias("has_errors"), F.max(F.col("event_type").isin(*PIPELINE_FAULTS).cast("int")).cast("boolean").alias("pipeline_fault"))


def bin_flags(bins: DataFrame, key: tuple[str, ...], least: int = 20, tolerance: float = 0.05) -> DataFrame:
    """Of each key: whether all bins with at least `least` rows hold their stated mean within the interval, and within the tolerance."""
    inside = (F.col("low") <= F.col("mean_stated")) & (F.col("mean_stated") <= F.col("high"))
    near = F.abs(F.col("observed") - F.col("mean_stated")) <= tolerance
    return bins.where(F.col("n") >= least).groupBy(*key).agg(F.count("*").alias("bins"), F.every(inside).alias("calibrated"), F.every(near).alias("within_tolerance"))


def active(listings: DataFrame, moment: str | None = None) -> DataFrame:
    """The enabled assets (asset, enabled, delisted_at), and of a moment those that were not delisted by then."""
    rows = listings.where("enabled")
    return rows if moment is None else rows.where(F.col("delisted_at").isNull() | (F.lit(moment).cast("timestamp_ntz") < F.col("delisted_at")))


def source_weight(events: DataFrame, weights: DataFrame, other: float = 0.5) -> DataFrame:
    """events (outlets) with source_weight, the largest weight of their outlets; an unknown outlet weighs `other`."""
    each = events.select("*", F.explode_outer("outlets").alias("source")).join(weights, "source", "left")
    keys = [c for c in events.columns]
    return each.groupBy(*keys).agg(F.max(F.coalesce("weight", F.lit(other))).alias("source_weight"))


def relevant(events: DataFrame, asset: str, least: float = 0.5) -> DataFrame:
    """The events whose relevance (asset to score) for an asset is high enough, the most important and then the newest first."""
    own = F.try_element_at("relevance", F.lit(asset))
    return events.where(F.coalesce(own, F.lit(0.0)) >= least).orderBy(F.desc("importance"), F.desc("published_at"))


def admitted(detections: DataFrame, stats: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """The detections whose measured statistics are informative; what was never measured is not admitted."""
    return detections.join(stats.where("informative").select(*on).distinct(), list(on), "left_semi")


def directional_faults(alerts: DataFrame) -> DataFrame:
    """alerts (kind, confidence, invalidation) with fault: why a directional one may not be raised."""
    directional = F.col("kind").isin("strong_prediction", "super_prediction")
    named = F.exists(F.coalesce("invalidation", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return alerts.withColumn("fault", F.when(directional, F.when(F.coalesce(F.col("confidence") <= 0, F.lit(True)), "no confidence").when(~named, "no invalidation")))


def rendered() -> Column:
    """The one text of an alert (level, asset, timeframe, title, confidence, invalidation)."""
    label = F.upper(F.element_at(F.create_map(*(F.lit(x) for p in {10: "info", 20: "notice", 30: "warning", 40: "critical"}.items() for x in p)), F.col("level")))
    head = F.concat(F.lit("["), label, F.lit("] "), F.concat_ws(" ", F.upper("asset"), "timeframe"), F.lit(": "), F.col("title"))
    call = F.when(F.col("confidence") > 0, F.concat(F.format_string("confidence %.0f%%", F.col("confidence") * 100), F.lit("; invalidated if: "), F.array_join("invalidation", "; ")))
    return F.concat_ws("\n", head, call)


def failover_events(attempts: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Events of trying sources in order: attempts (key, source, priority, rows, error) up to the first that gave rows; the one that answered after others is a failover."""
    first = attempts.where("error IS NULL AND rows > 0").groupBy(*key).agg(F.min(F.struct("priority", "source")).alias("_won"))
    tried = attempts.join(first, list(key), "left").where(F.col("_won").isNull() | (F.struct("priority", "source") <= F.col("_won")))
    kind = F.when(F.col("error").isNotNull(), "provider_error").when(F.col("rows") == 0, "empty_response")
    before = tried.where(kind.isNotNull()).select(*key, "source", kind.alias("event_type"))
    moved = tried.where(kind.isNull()).join(before.select(*key).distinct(), list(key), "left_semi").select(*key, "source", F.lit("provider_failover").alias("event_type"))
    return before.unionByName(moved)


def candidates(capabilities: DataFrame, asset: str, timeframe: str, preferred: str | None = None) -> DataFrame:
    """Sources (source, priority, assets, timeframes) that serve a series, by priority and name; a preferred one alone or none."""
    able = capabilities.where(F.array_contains("assets", asset) & F.array_contains("timeframes", timeframe))
    able = able if preferred is None else able.where(F.col("source") == preferred)
    return able.orderBy("priority", "source").select("source", "priority")


def symbols(assets: Column, style: str, overrides: dict[str, str] | None = None, quote: str = "USDT") -> Column:
    """The venue's symbol of an asset: an override, else the venue's own way."""
    own = {"joined": F.concat(assets, F.lit(quote)), "dashed": F.concat(assets, F.lit("-USD")), "plain": F.concat(assets, F.lit("USD"))}[style]
    if not overrides:
        return own
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in overrides.items() for x in p)), assets), own)


def quote_of(symbol: Column, asset: Column) -> Column:
    """What a symbol is quoted in: what follows the asset, by default USDT."""
    rest = F.when(F.startswith(symbol, asset), F.substr(symbol, F.length(asset) + 1))
    return F.coalesce(F.nullif(rest, F.lit("")), F.lit("USDT"))


def ranked_statistics(stats: DataFrame, by: tuple[str, ...] = (), informative_only: bool = False, first: int | None = None, **where: str) -> DataFrame:
    """Measured statistics (p_value, edge, informative, and `by`) of a scope, with their place: by p first, and within the admitted by the size of their edge, within the rejected by p.

    first keeps so many of each value of `by`.
    """
    for c, v in where.items():
        stats = stats.where(F.col(c) == v)
    rest = [c for c in stats.columns if c not in ("p_value", "edge", "informative")]
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    admitted = F.when(F.col("informative"), -F.abs("edge")).otherwise(F.col("p_value"))
    df = stats.where("informative") if informative_only else stats
    df = df.withColumn("place", F.row_number().over(w.orderBy("p_value", *rest))).withColumn("place_in_group", F.row_number().over(w.partitionBy(*by, "informative").orderBy(admitted, *rest) if by else Window.partitionBy("informative").orderBy(admitted, *rest)))
    return df if first is None else df.where(F.col("place") <= first)


def passing(scores: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Of each `by`: the models that beat the baseline in some slice, and those that do in none."""
    best = scores.groupBy(*by, "model").agg(F.max("beats_baseline").alias("_w"))
    names = lambda w: F.array_sort(F.collect_list(F.when(w, F.col("model"))))
    return best.groupBy(*by).agg(names(F.col("_w")).alias("passing"), names(~F.col("_w")).alias("failing"))


def watch_list(assets: DataFrame, timeframes: tuple[str, ...]) -> DataFrame:
    """What is polled: each of assets (asset, tier) at each live timeframe, but for the one of a minute below the first tier."""
    each = assets.select("*", F.explode(F.array(*map(F.lit, timeframes))).alias("timeframe"))
    return each.where((F.col("tier") <= 1) | (F.col("timeframe") != "1m"))
