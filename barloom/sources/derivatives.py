"""Bodies of derivative and market-wide endpoints as typed points, and the first provider of each scope that could answer.

Fetching is left to the caller: bodies has provider, asset, body, fetched_at. A body that isn't what the endpoint promises gives an
error and no points, so that one bad answer neither fails a job nor hides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.records import stablecoin_share

#: The coins that count as stable, hours between fundings.
STABLECOINS = ("usdt", "usdc", "dai", "fdusd", "usde", "tusd", "usds", "pyusd")
INTERVAL_HOURS = 8.0


def _moment(ms: Column) -> Column:
    return F.timestamp_millis(ms.try_cast("long")).cast("timestamp_ntz")


def _checked(bodies: DataFrame, schema: str, point, needs: tuple[str, ...], what: str) -> DataFrame:
    """bodies with points and error; every row of a body needs the named fields."""
    rows = F.when(F.ltrim("body").startswith("["), F.from_json("body", f"array<struct<{schema}>>"))
    points = F.transform(rows, point)
    bad = F.exists(points, lambda p: F.greatest(*(p[n].isNull().cast("int") for n in needs)) == 1)
    error = F.when(rows.isNull(), f"unexpected {what} payload").when(F.exists(rows, F.isnull) | bad, f"malformed {what} row")
    return bodies.withColumn("error", error).withColumn("points", F.when(error.isNull(), points))


def funding(bodies: DataFrame) -> DataFrame:
    """[{fundingTime ms, fundingRate, markPrice or ""}]: points of ts, rate, interval_hours, mark_price."""

    def point(r):
        return F.struct(_moment(r["fundingTime"]).alias("ts"), r["fundingRate"].try_cast("double").alias("rate"), F.lit(INTERVAL_HOURS).alias("interval_hours"), F.nullif(r["markPrice"], F.lit("")).try_cast("double").alias("mark_price"))

    return _checked(bodies, "fundingTime:string,fundingRate:string,markPrice:string", point, ("ts", "rate"), "funding")


def open_interest(bodies: DataFrame) -> DataFrame:
    """[{timestamp ms, sumOpenInterest, sumOpenInterestValue}]: points of ts, open_interest, open_interest_value."""

    def point(r):
        return F.struct(_moment(r["timestamp"]).alias("ts"), r["sumOpenInterest"].try_cast("double").alias("open_interest"), r["sumOpenInterestValue"].try_cast("double").alias("open_interest_value"))

    return _checked(bodies, "timestamp:string,sumOpenInterest:string,sumOpenInterestValue:string", point, ("ts", "open_interest", "open_interest_value"), "open interest")


def global_metrics(bodies: DataFrame) -> DataFrame:
    """{data: {market_cap_percentage: {coin: share}, total_market_cap: {usd}, total_volume: {usd}, updated_at s}}: one point; without a time it is that of the fetch."""
    data = F.from_json(F.get_json_object("body", "$.data"), "struct<market_cap_percentage:map<string,double>,total_market_cap:map<string,double>,total_volume:map<string,double>,updated_at:long>")
    shares = F.coalesce(data["market_cap_percentage"], F.create_map().cast("map<string,double>"))
    usd = lambda name: F.try_element_at(data[name], F.lit("usd"))
    point = F.struct(
        F.coalesce(F.when(data["updated_at"] != 0, F.timestamp_seconds(data["updated_at"]).cast("timestamp_ntz")), F.col("fetched_at").cast("timestamp_ntz")).alias("ts"),
        F.try_element_at(shares, F.lit("btc")).alias("btc_dominance"), F.try_element_at(shares, F.lit("eth")).alias("eth_dominance"),
        usd("total_market_cap").alias("total_market_cap_usd"), usd("total_volume").alias("total_volume_24h_usd"), F.nullif(stablecoin_share(shares, STABLECOINS), F.lit(0.0)).alias("stablecoin_share"),
    )
    whole = F.ltrim(F.get_json_object("body", "$.data")).startswith("{")
    error = F.when(~F.coalesce(whole, F.lit(False)), "unexpected global payload")
    return bodies.withColumn("error", error).withColumn("points", F.when(error.isNull(), F.array(point)))


def first_capable(parsed: DataFrame, order: tuple[str, ...], scope: tuple[str, ...] = ("asset",)) -> tuple[DataFrame, DataFrame]:
    """(points of each scope from the first provider in `order` that answered, with source; attempts: scope, provider, error, chosen).

    Providers outside the order aren't capable and aren't asked. A scope in which all fail has attempts only.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("provider"))
    asked = parsed.withColumn("_rank", rank).where(F.col("_rank") > 0)
    best = asked.groupBy(*scope).agg(F.min(F.when(F.col("error").isNull(), F.col("_rank"))).alias("_best"))
    met = asked.join(best, list(scope))
    chosen = F.coalesce(F.col("_rank") == F.col("_best"), F.lit(False))
    # what comes after the one that answered was never asked
    attempts = met.where(F.col("_best").isNull() | (F.col("_rank") <= F.col("_best"))).select(*scope, "provider", "error", chosen.alias("chosen"))
    points = met.where(chosen).select(*scope, F.col("provider").alias("source"), F.inline("points"))
    return points, attempts
