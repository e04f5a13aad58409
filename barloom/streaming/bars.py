"""Bars from a stream of ticks, published once each, and features folded bar by bar."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rollup(ticks: DataFrame, duration: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Final bars of a stream (asset, ts, price, tick_id): a bar is emitted once, when the watermark has passed its end."""
    at = F.struct("ts", "tick_id")
    ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time with a zone: UTC sessions
    bars = ticks.withWatermark("ts", late).groupBy("asset", F.window("ts", duration).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("asset", F.col("w.start").cast("timestamp_ntz").alias("open_time"), "open", "high", "low", "close", "volume")


def close_once(polled: DataFrame, key: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Of bars that are polled again and again (key, open_time, close, is_final) each final one the first time it is seen, in time order."""
    kinds = ", ".join(f"{k} string" for k in key)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames))
        rows = rows[rows.is_final].drop_duplicates("open_time", keep="last").sort_values("open_time")
        if last is not None:
            rows = rows[rows.open_time > pd.Timestamp(last, unit="us")]
        if len(rows):
            state.update((int(rows.open_time.max().value // 1000),))
            yield rows[[*key, "open_time", "close"]]

    out = f"{kinds}, open_time timestamp_ntz, close double"
    return polled.groupBy(*key).applyInPandasWithState(step, out, "last long", "append", GroupStateTimeout.NoTimeout)


def average_fold(bars: DataFrame, n: int = 9, key: tuple[str, ...] = ("asset",)) -> DataFrame:
    """The seeded exponential average of closes as a stream: refuses bars that aren't newer than the last. Equal to the batch fold over the same bars."""
    kinds = ", ".join(f"{k} string" for k in key)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen, value = state.get if state.exists else (-(1 << 62), 0, 0.0)
        rows = pd.concat(list(frames)).sort_values("open_time")
        out = []
        for t, close in zip(rows.open_time, rows.close, strict=True):
            us = int(pd.Timestamp(t).value // 1000)
            if us <= last:
                continue
            last, seen = us, seen + 1
            value = value + (close - value) / seen if seen <= n else value + 2 / (n + 1) * (close - value)
            out.append((*k, t, value if seen >= n else None))
        state.update((last, seen, value))
        yield pd.DataFrame(out, columns=[*key, "open_time", "average"])

    return bars.groupBy(*key).applyInPandasWithState(step, f"{kinds}, open_time timestamp_ntz, average double", "last long, seen long, value double", "append", GroupStateTimeout.NoTimeout)


def admitted(alerts: DataFrame, recipient: str = "recipient") -> DataFrame:
    """The rate budget as a stream's state: alerts (recipient, at, kind, asset, level, title, timeframe, value) with held, and the digests that fall due."""
    import json

    from barloom.operators.alerts import Budget, dedup_key, folded

    cols = [recipient, "at", "kind", "asset", "level", "title", "value"]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Budget(state=json.loads(state.get[0]) if state.exists else None)
        rows = folded(pd.concat(list(frames)), b, cols, recipient)
        state.update((json.dumps(b.state()),))
        yield rows

    return alerts.withColumn("_key", dedup_key()).groupBy(recipient).applyInPandasWithState(step, f"{recipient} string, at timestamp_ntz, kind string, asset string, level int, title string, value double, held string", "budget string", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str):
    """A foreachBatch function that adds a batch of bars to the table at path, one partition a batch; a replayed batch replaces its own partition.

    Nothing stored is rewritten: `merged` makes the upsert when the table is read.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("ingested_at", F.current_timestamp()) if "ingested_at" not in batch.columns else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def merged(batches: DataFrame, key: tuple[str, ...] = ("asset", "source", "timeframe", "open_time"), arrival: str = "ingested_at") -> DataFrame:
    """What upserts of the batches, in order, would have left of each key, and its revision: the last final row, else the last row; a final one is never replaced by a provisional one."""
    cols = [c for c in batches.columns if c not in (*key, "batch")]
    newest = F.struct("is_final", arrival)
    each = batches.groupBy(*key, "batch").agg(F.max_by(F.struct(*cols), newest).alias("row"), F.max("is_final").alias("final"))
    g = each.groupBy(*key).agg(F.max_by("row", F.struct("final", "batch")).alias("row"), F.count("*").alias("_n"), F.min(F.when(F.col("final"), F.col("batch"))).alias("_first"), F.array_sort(F.collect_list(F.struct("batch", "final"))).alias("_b"))
    # Every batch up to the first final one counts, then final ones only; the first makes the row, the others revise it.
    counted = F.size(F.filter("_b", lambda x: F.col("_first").isNull() | (x["batch"] <= F.col("_first")) | x["final"]))
    return g.select(*key, "row.*", (counted - 1).cast("long").alias("revision"))


def feed_sink(path: str, least: int = 0):
    """A foreachBatch function that appends a batch's sent alerts of a level to a feed of JSON lines, one partition a batch; a replayed batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where((F.col("held") == "") & (F.col("level") >= least)) if "held" in batch.columns else batch.where(F.col("level") >= least)
        rows.write.mode("overwrite").json(f"{path}/batch={number}")

    return write


def recorded(sink, runs: str, accepted: str = "true", **about: str):
    """A foreachBatch function that passes a batch to `sink` and records the run once: when it began and ended, rows read, accepted and rejected, error.

    The rows are counted while the sink writes them. A run is a partition named by its batch, so a replay adds none. A batch that
    fails is recorded as failed, and fails still.
    """
    from datetime import UTC, datetime

    from pyspark.sql import Observation

    def write(batch: DataFrame, number: int) -> None:
        spark, began, seen = batch.sparkSession, datetime.now(UTC), Observation()
        counted = batch.observe(seen, F.count(F.lit(1)).alias("read"), F.count(F.when(F.expr(accepted), 1)).alias("accepted"))
        error = None
        try:
            sink(counted, number)
        except Exception as e:
            error = str(e)[:500]
            raise
        finally:
            got = seen.get if error is None else {}
            ended = datetime.now(UTC)
            row = (began, ended, (ended - began).total_seconds(), got.get("read"), got.get("accepted"), None if error else got["read"] - got["accepted"], error, *about.values())
            kinds = "began timestamp, ended timestamp, seconds double, read long, accepted long, rejected long, error string" + "".join(f", {c} string" for c in about)
            spark.createDataFrame([row], kinds).coalesce(1).write.mode("overwrite").parquet(f"{runs}/batch={number}")

    return write
