"""Stored tables: keyed upserts without a row-level catalogue, and the usual reads.

An upsert is a union of stored and incoming rows from which the best row of each key
stays. Tables are Parquet partitioned by timeframe; writes replace the partitions that
the batch touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAR_KEY = ("asset", "source", "timeframe", "open_time")


def upsert_bars(stored: DataFrame, incoming: DataFrame, key: tuple[str, ...] = BAR_KEY, arrival: str = "ingested_at") -> DataFrame:
    """Stored rows replaced by incoming ones unless that would turn a final bar into a provisional one; counts revisions.

    stored has a revision column. Of several incoming rows of a key the last to arrive counts, final ones first.
    """
    newest = F.struct(F.col("is_final"), F.col(arrival))
    cols = [c for c in incoming.columns if c not in key]
    new = incoming.groupBy(*key).agg(F.max_by(F.struct(*cols), newest).alias("new"))
    old = stored.select(*key, F.struct(*cols, "revision").alias("old"))
    both = old.join(new, list(key), "full")
    takes = F.col("old").isNull() | (F.col("new").isNotNull() & (~F.col("old.is_final") | F.col("new.is_final")))
    picked = [F.when(takes, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in cols]
    revision = F.when(F.col("old").isNull(), 0).when(takes, F.col("old.revision") + 1).otherwise(F.col("old.revision"))
    return both.select(*key, *picked, revision.cast("long").alias("revision"))


def upsert(stored: DataFrame, incoming: DataFrame, key: tuple[str, ...], fixed: tuple[str, ...] = ()) -> DataFrame:
    """Incoming rows win over stored ones of the same key, but for the fixed columns, which are never updated."""
    cols = [c for c in stored.columns if c not in key]
    both = stored.select(*key, F.struct(*cols).alias("old")).join(incoming.select(*key, F.struct(*cols).alias("new")), list(key), "full")
    keep = lambda c: F.coalesce(F.when(F.col("old").isNotNull(), F.col(f"old.{c}")), F.col(f"new.{c}"))
    return both.select(*key, *((keep(c) if c in fixed else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))).alias(c) for c in cols))


def append_new(stored: DataFrame, incoming: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The incoming rows whose key isn't stored yet, once each: what an append-only ledger adds."""
    return incoming.join(stored.select(*key), list(key), "left_anti").dropDuplicates(list(key))


def delete_range(stored: DataFrame, where: dict[str, str], start: str, end: str, ts: str = "open_time") -> DataFrame:
    """stored without the rows of a key in the half-open [start, end)."""
    own = F.lit(True)
    for c, v in where.items():
        own = own & (F.col(c) == v)
    inside = (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    return stored.where(~F.coalesce(own & inside, F.lit(False)))


def fetch_range(df: DataFrame, start: str | None = None, end: str | None = None, final_only: bool = True, ts: str = "open_time", **where: str) -> DataFrame:
    """Rows of a scope in the half-open [start, end); all conditions reach the scan."""
    for c, v in where.items():
        df = df.where(F.col(c) == v)
    if start:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    return df.where("is_final") if final_only and "is_final" in df.columns else df


def newest_n(df: DataFrame, n: int, key: tuple[str, ...] = ("asset", "source", "timeframe"), ts: str = "open_time") -> DataFrame:
    """The newest n rows of each key. The rank limit is pushed below the shuffle."""
    w = Window.partitionBy(*key).orderBy(F.desc(ts))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def latest(df: DataFrame, key: tuple[str, ...], ts: str, *order: Column) -> DataFrame:
    """The newest row of each key, combined before the shuffle."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), F.struct(F.col(ts), *order)).alias("_r")).select(*key, "_r.*")


def write_bars(bars: DataFrame, path: str) -> None:
    """Replaces the timeframe partitions that bars has, clustered by series and time; a series is spread by month, so that a long one isn't one task."""
    out = bars.repartition("timeframe", "asset", F.date_trunc("month", "open_time")).sortWithinPartitions("asset", "source", "open_time")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("timeframe").parquet(path)


def earliest_n(df: DataFrame, n: int, ts: str = "open_time") -> DataFrame:
    """The earliest n rows, ascending: what a limited range scan gives."""
    return df.orderBy(ts).limit(n)


def recent(df: DataFrame, ts: str, since: str, n: int, newest_first: bool = True, **where: str) -> DataFrame:
    """At most n rows of a scope from `since` on. Filters come before the limit, so that a scope's rows aren't cut off by others."""
    rows = fetch_range(df, since, None, False, ts, **where)
    return rows.orderBy(F.desc(ts) if newest_first else F.col(ts)).limit(n)


def looked_up(scopes: DataFrame, scores: DataFrame, key: tuple[str, ...], score: str = "score", missing: float = 1.0) -> DataFrame:
    """scopes with their score; a scope that was never scored is trusted."""
    return scopes.join(scores.select(*key, score), list(key), "left").withColumn(score, F.coalesce(score, F.lit(missing)))


def resolved_flags(predictions: DataFrame, outcomes: DataFrame, key: str = "prediction_id") -> DataFrame:
    """predictions with resolved: whether an outcome exists. Derived, so that nothing stored is changed."""
    done = outcomes.select(key).distinct().withColumn("_done", F.lit(True))
    return predictions.join(done, key, "left").withColumn("resolved", F.coalesce("_done", F.lit(False))).drop("_done")


def due(predictions: DataFrame, now: str, n: int = 5000) -> DataFrame:
    """The oldest unresolved predictions whose time has come, n at most."""
    return predictions.where(~F.col("resolved") & (F.col("resolves_at") <= F.lit(now).cast("timestamp_ntz"))).orderBy("resolves_at", "prediction_id").limit(n)


def retained(df: DataFrame, ts: str, now: str, days: int = 365) -> DataFrame:
    """Rows that are not older than the retention."""
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def create_table(spark, name: str, schema: str, partitions: tuple[str, ...] = ()) -> None:
    """Creates an empty Parquet table unless it exists."""
    by = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{by}")


def append_events(events: DataFrame, path: str, most: int = 2000) -> None:
    """Appends an event log, partitioned by day, with messages cut to `most` characters."""
    out = events.withColumn("message", F.substring("message", 1, most)).withColumn("day", F.to_date("detected_at"))
    out.write.mode("append").partitionBy("day").parquet(path)
