"""Validation of bars and trust in their sources.

A batch is rejected row by row (shape, grid), repaired (order, duplicates) and flagged
(moves, flat lines, staleness, gaps), in this order. Each check is one expression or
one window over a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.grid import floor_to, plus, seconds
from barloom.functions.numbers import mad_scale, median

KEY = ("asset", "source", "timeframe")
#: Largest plausible move of one bar, in percent.
MAX_MOVE = {"1m": 12.0, "5m": 20.0, "15m": 25.0, "30m": 30.0, "1h": 35.0, "4h": 50.0, "12h": 60.0, "1d": 75.0, "1w": 150.0}
#: Weight of an event by severity.
SEVERITY = {"info": 0.0, "warning": 0.15, "error": 0.5}
OUTLIER_SIGMAS, OUTLIER_SAMPLES = 25.0, 30
FLAT_BARS = 8
#: Shares of a series' grid that are missing.
GAP_ERROR, GAP_WARNING = 0.10, 0.01
STALE_BARS = 3


def shape_fault() -> Column:
    """The first thing that is wrong with a bar's own numbers, else null."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    any_of = lambda test: test(prices[0]) | test(prices[1]) | test(prices[2]) | test(prices[3])
    o, h, low, c = prices
    return (
        F.when(any_of(lambda x: x.isNull() | F.isnan(x)), "not a number")
        .when(any_of(lambda x: F.abs(x) == float("inf")), "infinite")
        .when(any_of(lambda x: x <= 0), "not positive")
        .when(F.isnan("volume") | (F.col("volume") < 0), "volume")
        .when(h < low, "high below low")
        .when(h < F.greatest(o, c), "high below body")
        .when(low > F.least(o, c), "low above body")
    )


def off_grid(timeframe: str) -> Column:
    return floor_to(F.col("open_time"), timeframe) != F.col("open_time")


def last_arrivals(bars: DataFrame, arrival: str, key=KEY) -> DataFrame:
    """One row for each series and time: the last to arrive."""
    cols = [c for c in bars.columns if c not in (*key, "open_time")]
    return bars.groupBy(*key, "open_time").agg(F.max_by(F.struct(*cols), arrival).alias("_r"), F.count("*").alias("copies")).select(*key, "open_time", "_r.*", "copies")


def out_of_order(bars: DataFrame, arrival: str, key=KEY) -> DataFrame:
    """bars with late: it arrived after a bar of a later time."""
    before = Window.partitionBy(*key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return bars.withColumn("late", F.coalesce(F.col("open_time") < F.max("open_time").over(before), F.lit(False)))


def moves(bars: DataFrame, timeframe: str, key=KEY) -> DataFrame:
    """bars with change_pct, robust_z and move: impossible, outlier or null. Centre and scale are those of the whole series, in the same sort as the changes."""
    order, whole = Window.partitionBy(*key).orderBy("open_time"), Window.partitionBy(*key)
    last = F.lag("close").over(order)
    out = bars.withColumn("change_pct", F.when(last > 0, (F.col("close") - last) / last * 100))
    out = out.withColumn("_centre", F.percentile("change_pct", F.lit(0.5)).over(whole)).withColumn("_samples", F.count("change_pct").over(whole))
    out = out.withColumn("_away", F.abs(F.col("change_pct") - F.col("_centre")))
    out = out.withColumn("_scale", F.percentile("_away", F.lit(0.5)).over(whole) * 1.4826)
    z = F.when((F.col("_samples") >= OUTLIER_SAMPLES) & (F.col("_scale") > 0), F.col("_away") / F.col("_scale"))
    kind = F.when(F.abs("change_pct") > MAX_MOVE.get(timeframe, 100.0), "impossible").when(z > OUTLIER_SIGMAS, "outlier")
    return out.select(*bars.columns, "change_pct", z.alias("robust_z"), kind.alias("move"))


def runs(df: DataFrame, flag: Column, key=KEY, ts: str = "open_time") -> DataFrame:
    """Consecutive rows of a series for which flag holds: start, stop (last row) and n."""
    order = Window.partitionBy(*key).orderBy(ts)
    numbered = df.select(*key, ts, flag.alias("_f"), F.row_number().over(order).alias("_n")).where("_f")
    group = F.col("_n") - F.row_number().over(order)
    return numbered.withColumn("_g", group).groupBy(*key, "_g").agg(F.min(ts).alias("start"), F.max(ts).alias("stop"), F.count("*").alias("n")).drop("_g")


def flat_lines(bars: DataFrame, key=KEY) -> DataFrame:
    """Runs of at least FLAT_BARS bars without volume or without range."""
    return runs(bars, (F.col("volume") <= 0) | (F.col("high") == F.col("low")), key).where(F.col("n") >= FLAT_BARS)


def gap_runs(bars: DataFrame, timeframe: str, key=KEY) -> DataFrame:
    """Missing stretches of the grid, half-open, with the number of missing bars: a look at the next bar instead of a join with the grid."""
    order = Window.partitionBy(*key).orderBy("open_time")
    start, stop = plus(F.col("open_time"), timeframe), F.lead("open_time").over(order)
    missing = F.floor(F.timestamp_diff("SECOND", start, stop) / seconds(timeframe))
    return bars.select(*key, start.alias("start"), stop.alias("stop"), missing.cast("long").alias("missing")).where("missing > 0")


def coverage_gaps(bars: DataFrame, timeframe: str, tolerance: float = 0.0, key=KEY) -> DataFrame:
    """Of each series the bars missing inside its stored stretch, their share of the grid, and whether that is beyond the tolerance."""
    stored = bars.groupBy(*key).agg(F.count("*").alias("_n"))
    missing = gap_runs(bars, timeframe, key).groupBy(*key).agg(F.sum("missing").alias("missing"))
    out = stored.join(missing, list(key), "left").withColumn("missing", F.coalesce("missing", F.lit(0).cast("long")))
    out = out.withColumn("ratio", F.col("missing") / (F.col("missing") + F.col("_n")))
    return out.withColumn("reported", F.col("ratio") > tolerance).drop("_n")


def staleness(bars: DataFrame, timeframe: str, now: str, key=KEY) -> DataFrame:
    """Of each series its newest close, age in seconds and severity: warning beyond 3 bars, error beyond 9."""
    newest = bars.groupBy(*key).agg(plus(F.max("open_time"), timeframe).alias("newest_close"))
    age = F.timestamp_diff("SECOND", F.col("newest_close"), F.lit(now).cast("timestamp_ntz"))
    limit = STALE_BARS * seconds(timeframe)
    return newest.withColumn("age_s", age).withColumn("severity", F.when(age > 3 * limit, "error").when(age > limit, "warning"))


def validated(batch: DataFrame, timeframe: str, arrival: str, key=KEY) -> tuple[DataFrame, DataFrame]:
    """(accepted bars, events) of a batch: event_type, severity, key, window_start, n.

    A pass over the rows as delivered and one over the accepted bars give all events; the
    missing stretches of a series are as severe as its whole missing share.
    """

    def event(when, kind, severity, n=None):
        return F.when(when, F.struct(F.lit(kind).alias("event_type"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), (F.lit(1) if n is None else n).cast("long").alias("n"), F.col("_at").alias("window_start")))

    def told(df, *events):
        return df.select(*key, F.inline(F.filter(F.array(*events), F.isnotnull))).select("event_type", "severity", *key, "window_start", "n")

    marked = batch.withColumn("_fault", shape_fault()).withColumn("_off", off_grid(timeframe))
    fine = F.col("_fault").isNull() & ~F.col("_off")
    kept = last_arrivals(marked.where(fine).drop("_fault", "_off"), arrival, key)
    before = Window.partitionBy(*key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    delivered = marked.withColumn("_at", F.col("open_time")).withColumn("_late", fine & (F.col("open_time") < F.max(F.when(fine, F.col("open_time"))).over(before)))
    events = told(delivered, event(F.col("_fault").isNotNull(), "shape_invalid", "error"), event(F.col("_fault").isNull() & F.col("_off"), "misaligned", "error"), event(F.col("_late"), "out_of_order", "warning"))

    order, whole = Window.partitionBy(*key).orderBy("open_time"), Window.partitionBy(*key)
    step = plus(F.col("open_time"), timeframe)
    seen = moves(kept, timeframe, key).withColumn("_next", F.floor(F.timestamp_diff("SECOND", step, F.lead("open_time").over(order)) / seconds(timeframe)))
    seen = seen.withColumn("_gaps", F.sum("_next").over(whole) / (F.sum("_next").over(whole) + F.count("*").over(whole)))
    flat = (F.col("volume") <= 0) | (F.col("high") == F.col("low"))
    seen = seen.withColumn("_flat", flat).withColumn("_run", F.sum((~flat).cast("int")).over(order))
    run = Window.partitionBy(*key, "_run")
    seen = seen.withColumn("_flats", F.sum(F.col("_flat").cast("int")).over(run)).withColumn("_first", F.min(F.when(F.col("_flat"), F.col("open_time"))).over(run)).withColumn("_at", F.col("open_time"))
    many = F.when(F.col("_gaps") >= GAP_ERROR, "error").when(F.col("_gaps") >= GAP_WARNING, "warning").otherwise("info")
    found = (
        event(F.col("copies") > 1, "duplicate", "warning", F.col("copies") - 1),
        event(F.col("move") == "impossible", "impossible_move", "error"),
        event(F.col("move") == "outlier", "outlier", "warning"),
        event((F.col("_flats") >= FLAT_BARS) & (F.col("open_time") == F.col("_first")), "flatline", "warning", F.col("_flats")),
        event(F.col("_next") > 0, "missing", many, F.col("_next")),
    )
    late = told(seen, *found)
    missing = F.col("event_type") == "missing"
    late = late.withColumn("window_start", F.when(missing, plus(F.col("window_start"), timeframe)).otherwise(F.col("window_start")))
    return kept.drop("copies"), events.unionByName(late)


def trust(events: DataFrame, coverage: DataFrame, timeframe: str, now: str, window_hours: int = 24, tolerance: float = 8.0, least: float = 0.1, exposure: int = 50, key=KEY) -> DataFrame:
    """score, events_in_window, penalty and staleness of each series of coverage (key, assessed, last_at).

    events has severity and detected_at. Weights halve each quarter of the window and count against the bars assessed.
    """
    at = F.lit(now).cast("timestamp_ntz")
    age = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("detected_at"), at))
    weight = F.coalesce(F.create_map(*(F.lit(x) for p in SEVERITY.items() for x in p))[F.col("severity")], F.lit(0.0))
    inside = events.withColumn("age", age).where(F.col("age") <= window_hours * 3600)
    mass = inside.groupBy(*key).agg(F.sum(weight * F.pow(F.lit(2.0), -F.col("age") / (window_hours * 900))).alias("mass"), F.count("*").alias("events_in_window"))
    out = coverage.join(mass, list(key), "left").fillna(0, ["mass", "events_in_window"])
    rate = 1000 * F.col("mass") / F.greatest(F.lit(exposure), F.coalesce("assessed", F.lit(0)))
    penalty = F.when(F.col("mass") > 0, F.least(F.lit(0.95), 1 - F.exp(-rate / max(0.1, tolerance)))).otherwise(0.0)
    behind = F.timestamp_diff("SECOND", F.col("last_at"), at) / (seconds(timeframe) * STALE_BARS)
    stale = F.when(F.col("last_at").isNull(), 0.5).when(behind <= 1, 0.0).otherwise(F.least(F.lit(0.7), 0.3 * F.log2(behind + 1)))
    score = F.bround(F.greatest(F.lit(least), F.least(F.lit(1.0), 1 - penalty - stale)), 4)
    return out.select(*key, score.alias("score"), "events_in_window", penalty.alias("penalty"), stale.alias("staleness")).withColumn("degraded", F.col("score") < 0.75).withColumn("unusable", F.col("score") < 0.35)


def audit(left: DataFrame, right: DataFrame, tolerance_pct: float = 0.5, on: tuple[str, ...] = ("asset", "timeframe", "open_time")) -> DataFrame:
    """Bars of two sources whose closes are further apart than the tolerance; errors beyond four times that."""
    both = left.select(*on, F.col("close").alias("left_close")).join(right.select(*on, F.col("close").alias("right_close")), list(on))
    off = F.abs(F.col("left_close") - F.col("right_close")) / F.col("left_close") * 100
    return both.withColumn("deviation_pct", off).where(off > tolerance_pct).withColumn("severity", F.when(off > 4 * tolerance_pct, "error").otherwise("warning"))


def robust_z(window: Column, current: Column) -> Column:
    """Distance of current from the median of an array, in robust sigmas; 0 without spread."""
    centre = median(window)
    scale = mad_scale(window, centre)
    return F.when(scale > 0, (current - centre) / scale).otherwise(0.0)
