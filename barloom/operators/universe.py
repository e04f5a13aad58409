"""Which sources and assets count when: failover, listings as of a moment, event studies, look-ahead probes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numbers import two_proportion_p, wilson
from barloom.operators.patterns import benjamini_hochberg


def failover(bars: DataFrame, priorities: DataFrame, key: tuple[str, ...] = ("asset", "timeframe")) -> DataFrame:
    """Of each key the bars of its first source, by (priority, source), that delivered any. priorities: one row a source."""
    ranked = bars.join(priorities, "source")
    chosen = ranked.groupBy(*key).agg(F.min(F.struct("priority", "source")).alias("_best"))
    return ranked.join(chosen, list(key)).where(F.col("source") == F.col("_best.source")).drop("_best")


def listed(listings: DataFrame, moments: DataFrame) -> DataFrame:
    """moment, asset for each asset (listed_at, delisted_at; null is open) that was listed at a moment."""
    m = F.col("moment")
    on = (F.coalesce(F.col("listed_at") <= m, F.lit(True))) & (F.coalesce(m < F.col("delisted_at"), F.lit(True)))
    return listings.join(moments, on).select("moment", "asset")


def survivorship(listings: DataFrame, moments: DataFrame) -> DataFrame:
    """Of each moment: assets then listed, those no longer listed now, and their share."""
    then = listed(listings, moments)
    alive = listings.where("delisted_at IS NULL").select("asset").distinct().withColumn("alive", F.lit(1))
    g = then.join(alive, "asset", "left").groupBy("moment").agg(F.count("*").alias("as_of"), F.count(F.when(F.col("alive").isNull(), 1)).alias("missing"))
    return g.withColumn("bias", F.round(F.col("missing") / F.col("as_of"), 4))


#: Volatility multiple, direction and hours that an event of a category is expected to bring, before anything is measured.
IMPACT_PRIORS = {
    "security_incident": (1.8, -0.35, 12.0),
    "etf": (1.6, 0.25, 24.0),
    "regulation": (1.5, 0.0, 24.0),
    "enforcement": (1.5, -0.25, 18.0),
    "macro": (1.6, 0.0, 12.0),
    "exchange": (1.4, -0.15, 12.0),
    "protocol": (1.2, 0.10, 24.0),
    "listing": (1.3, 0.20, 6.0),
    "adoption": (1.1, 0.10, 24.0),
    "partnership": (1.1, 0.10, 12.0),
    "funding": (1.0, 0.0, 12.0),
    "market_move": (1.2, 0.0, 6.0),
    "other": (1.0, 0.0, 6.0),
}
#: What counts as elevated, bars before an event, events that a test and a finding need, slots that an event looks ahead for a bar.
ELEVATED, BEFORE, LEAST_EVENTS, EVIDENCE, SLOTS = 1.5, 48, 5, 25, 8
#: The asset of measurements over all assets.
ANY = "ANY"


def first_bars(events: DataFrame, bars: DataFrame, timeframe: str) -> DataFrame:
    """events (asset, at) with the first bar that opens at or after them within SLOTS slots: open_time and its columns. Each slot is an equal join."""
    from barloom.functions.grid import ceil_to, seconds

    s = seconds(timeframe)
    cols = [c for c in events.columns if c != "open_time"]
    asked = events.select(*cols, ceil_to(F.col("at"), timeframe).alias("_slot"), F.posexplode(F.array_repeat(F.lit(0), SLOTS)).alias("_k", "_z")).drop("_z")
    asked = asked.withColumn("open_time", F.timestamp_add("SECOND", (F.col("_k") * s).cast("int"), F.col("_slot")))
    own = [c for c in bars.columns if c not in ("asset", "open_time")]
    met = asked.join(bars, ["asset", "open_time"])
    return met.groupBy(*cols).agg(F.min_by(F.struct("open_time", *own), "_k").alias("_b")).select(*cols, "_b.*")


def _greedy(marks: DataFrame, by: tuple[str, ...], hours: int) -> DataFrame:
    """by and at of the marks that follow the last one kept by at least so many hours."""
    from barloom.operators.patterns import thinned

    micros = marks.withColumn("t", F.unix_micros(F.col("at").cast("timestamp")))
    kept = thinned(micros, by, hours * 3_600_000_000, "t")
    return micros.join(kept, [*by, "t"], "left_semi").drop("t").dropDuplicates([*by, "at"])


def impact(bars: DataFrame, events: DataFrame, timeframe: str = "1h", horizons: tuple[int, ...] = (6, 24), priors: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """Of each asset, category and horizon in hours: events, volatility ratios after and before, how often it is elevated and how often the expected direction follows, against the same of any moment.

    events: asset, category, at, relevance, is_recycled; only relevant fresh ones count. Kept events of a category follow each other by the horizon at least.
    Both kinds of test of an asset are one family.
    """
    from barloom.functions.grid import seconds

    priors = IMPACT_PRIORS if priors is None else priors
    order = Window.partitionBy("asset").orderBy("open_time")
    last = F.lag("close").over(order)
    logs = bars.where("is_final").select("asset", "open_time", "close").withColumn("_l", F.when((last > 0) & (F.col("close") > 0), F.log(F.col("close") / last))).withColumn("bar", F.row_number().over(order) - 1)
    events = events.where("relevance >= 0.5 AND NOT is_recycled").select("asset", "category", F.col("at").cast("timestamp_ntz").alias("at")).distinct()
    lean = F.create_map(*(F.lit(x) for c, p in priors.items() for x in (c, p[1])))
    out = None
    for h in horizons:
        n = max(1, h * 3600 // seconds(timeframe))
        b = logs.withColumn("before", F.stddev_pop("_l").over(order.rowsBetween(1 - BEFORE, -1))).withColumn("after", F.when(F.lead("close", n).over(order).isNotNull(), F.stddev_pop("_l").over(order.rowsBetween(1, n))))
        b = b.withColumn("ret", (F.lead("close", n).over(order) - F.col("close")) / F.col("close") * 100).withColumn("ratio", F.when((F.col("bar") >= BEFORE) & (F.col("before") > 0) & (F.col("after") > 0), F.col("after") / F.col("before")))
        b = b.select("asset", "open_time", "bar", "ratio", "ret")
        some = b.where(F.col("ret").isNotNull())
        moments = some.where((F.col("bar") >= BEFORE) & ((F.col("bar") - BEFORE) % n == 0) & F.col("ratio").isNotNull()).groupBy("asset").agg(F.count("*").alias("bn"), F.count(F.when(F.col("ratio") >= ELEVATED, 1)).alias("bs"))
        ways = some.where(F.col("bar") % n == 0).groupBy("asset").agg(F.count("*").alias("dn"), F.count(F.when(F.col("ret") > 0, 1)).alias("du"))
        met = first_bars(events, b, timeframe).where("ratio IS NOT NULL")
        kept = _greedy(met, ("asset", "category"), h)
        prior = F.coalesce(lean[F.col("category")], F.lit(0.0))
        g = kept.groupBy("asset", "category").agg(
            F.count("*").alias("events"), F.median("ratio").alias("median_ratio"), F.avg("ratio").alias("mean_ratio"), F.count(F.when(F.col("ratio") >= ELEVATED, 1)).alias("s"),
            F.count(F.when((F.col("ret") > 0) == (prior > 0), 1)).alias("ds"), F.median("ret").alias("median_return_pct"),
        ).where(F.col("events") >= LEAST_EVENTS)
        g = g.join(moments, "asset", "left").join(ways, "asset", "left").withColumn("horizon", F.lit(h)).withColumn("_prior", prior)
        part = g.withColumn("db", F.when(F.col("_prior") > 0, F.col("du")).otherwise(F.col("dn") - F.col("du")))
        out = part if out is None else out.unionByName(part)
    rate = lambda s, n: F.when(n > 0, s / n).otherwise(0.5)
    c = F.col
    tests = F.array(
        F.struct(F.lit("elevated").alias("test"), c("s").alias("hits"), c("bs").alias("base_hits"), c("bn").alias("base_n")),
        F.when(F.abs("_prior") > 0.05, F.struct(F.lit("directional").alias("test"), c("ds").alias("hits"), c("db").alias("base_hits"), c("dn").alias("base_n"))),
    )
    long = out.select("asset", "category", "horizon", "events", "median_ratio", "mean_ratio", "median_return_pct", F.inline(F.filter(tests, F.isnotnull)))
    long = long.withColumn("rate", c("hits") / c("events")).withColumn("baseline", rate(c("base_hits"), c("base_n"))).withColumn("p_value", two_proportion_p(c("hits"), c("events"), c("base_hits"), c("base_n")))
    long = benjamini_hochberg(long, family=("asset",)).withColumn("_i", wilson(c("hits"), c("events")))
    sure = (c("events") >= EVIDENCE) & c("significant") & ((c("_i.low") > c("baseline")) | (c("_i.high") < c("baseline")))
    verdict = F.when(sure & (c("rate") > c("baseline")), F.when(c("test") == "elevated", "moves volatility").otherwise("moves direction")).when(sure & (c("test") == "elevated"), "suppresses volatility")
    return long.withColumn("verdict", verdict).drop("_i", "hits", "base_hits", "base_n")


def impact_verdicts(measured: DataFrame) -> DataFrame:
    """Of each asset, category and horizon of impact's tests, what they come to in words. The texts are fixed values."""
    said = lambda v: F.max((F.coalesce(F.col("verdict"), F.lit("")) == v).cast("int")) == 1
    g = measured.groupBy("asset", "category", "horizon").agg(F.first("events").alias("events"), said("moves direction").alias("_d"), said("moves volatility").alias("_v"), said("suppresses volatility").alias("_c"))
    few = F.format_string(f"insufficient evidence (%d events, need {EVIDENCE})", "events")
    words = F.when(F.col("events") < EVIDENCE, few).when(F.col("_d"), "moves price directionally").when(F.col("_v"), "precedes elevated volatility, direction unpredictable").when(F.col("_c"), "followed by calmer-than-usual conditions").otherwise("no measurable impact")
    return g.select("asset", "category", "horizon", "events", words.alias("verdict"))


def impact_estimates(events: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """events (category, importance, confidence, asset) with what they may bring: the category's prior, or what was measured for it with evidence on the asset, else on ANY, scaled by importance."""
    prior = F.create_map(*(x for c, p in IMPACT_PRIORS.items() for x in (F.lit(c), F.struct(F.lit(p[0]).alias("vol"), F.lit(p[1]).alias("dir"), F.lit(p[2]).alias("hours")))))
    df = events.withColumn("_p", F.coalesce(prior[F.col("category")], F.struct(F.lit(1.0).alias("vol"), F.lit(0.0).alias("dir"), F.lit(6.0).alias("hours"))))
    if measured is None:
        df = df.withColumn("_m", F.lit(None).cast("struct<ratio:double,horizon:int,moves:boolean>"))
    else:
        each = measured.where(F.col("events") >= EVIDENCE).groupBy("asset", "category", "horizon").agg(F.first("median_ratio").alias("ratio"), F.max(F.coalesce("verdict", F.lit("")) == "moves direction").alias("moves"))
        one = each.groupBy("asset", "category").agg(F.max_by(F.struct("ratio", "horizon", "moves"), "horizon").alias("_m"))
        anywhere = one.where(F.col("asset") == ANY).select("category", F.col("_m").alias("_any"))
        df = df.join(one, ["asset", "category"], "left").join(anywhere, "category", "left").withColumn("_m", F.coalesce("_m", "_any")).drop("_any")
    scale, known = 0.6 + 0.8 * F.col("importance"), F.col("_m").isNotNull()
    return df.select(
        *events.columns,
        F.round(1 + (F.when(known, F.col("_m.ratio")).otherwise(F.col("_p.vol")) - 1) * scale, 3).alias("volatility_multiple"),
        F.round(F.when(known & ~F.col("_m.moves"), 0.0).otherwise(F.col("_p.dir")) * F.col("importance"), 3).alias("direction_bias"),
        F.when(known, F.col("_m.horizon").cast("double")).otherwise(F.col("_p.hours")).alias("expected_hours"),
        F.round(F.when(known, F.least(F.lit(0.8), 0.3 + 0.5 * F.col("confidence"))).otherwise(F.least(F.lit(0.35), 0.15 + 0.2 * F.col("confidence"))), 3).alias("sureness"),
        known.alias("measured"),
    )


def corrupted(bars: DataFrame, moment: str, after: bool = True) -> DataFrame:
    """Bars whose prices on one side of a moment are replaced by implausible ones of valid shape."""
    at = F.lit(moment).cast("timestamp_ntz")
    side = F.col("open_time") >= at if after else F.col("open_time") < at
    wild = 1 + 4 * (F.crc32(F.col("open_time").cast("string").cast("binary")) % 7)
    cols = {c: F.when(side, F.col(c) * wild).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}
    return bars.withColumns(cols)


def leaks(bars: DataFrame, features: Callable[[DataFrame], DataFrame], moment: str, key: tuple[str, ...] = ("asset", "source", "timeframe")) -> tuple[int, int]:
    """(rows before the moment that change when its future does, rows from it on that change when the past does); clean is (0, more)."""
    cols = [c for c, t in features(bars).dtypes if c not in (*key, "open_time") and t in ("double", "int", "bigint")]
    digest = lambda df: df.select(*key, "open_time", F.xxhash64(*(F.round(c, 6) for c in cols)).alias("h"))
    whole = digest(features(bars))
    at = F.lit(moment).cast("timestamp_ntz")
    differ = lambda other, side: whole.join(digest(features(other)).withColumnRenamed("h", "g"), [*key, "open_time"]).where(side & (F.col("h") != F.col("g"))).count()
    return differ(corrupted(bars, moment), F.col("open_time") < at), differ(corrupted(bars, moment, False), F.col("open_time") >= at)
