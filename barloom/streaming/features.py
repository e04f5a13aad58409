"""The indicators of closed bars as a stream: one typed state a series, warmed up from stored bars."""

from __future__ import annotations

from collections.abc import Iterator
from math import log, sqrt
from statistics import fmean

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from barloom.functions.grid import bars_per_year
from barloom.operators.indicators import RECURSIVE, WARMUP

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ("asset",)
#: Stored bars beyond those that the averages need, by which a restarted average has forgotten where it began.
EXTRA = 50
WINDOWED = (
    "true_range", "sma_20", "sma_50", "sma_200", "realised_vol_20", "bb_mid", "bb_upper", "bb_lower", "bb_percent_b", "bb_bandwidth", "obv", "vwap", "vwap_distance_pct", "roc_10", "stoch_k", "stoch_d", "obv_change_20",
)
FEATURES = (*WINDOWED, *RECURSIVE, "change_pct", "range_pct")
#: The recursive averages: bars of the seed, and the weight of a bar after it.
AVERAGES = {
    "ema_9": (9, 2 / 10), "ema_21": (21, 2 / 22), "ema_50": (50, 2 / 51), "fast": (12, 2 / 13), "slow": (26, 2 / 27), "signal": (9, 2 / 10),
    "gain": (14, 1 / 14), "loss": (14, 1 / 14), "range": (14, 1 / 14), "later": (14, 1 / 14), "rise": (14, 1 / 14), "fall": (14, 1 / 14), "adx": (14, 1 / 14),
}
#: How many of the newest values are held.
HELD = {"close": 200, "high": 14, "low": 14, "step": 20, "k": 3, "obv": 21}
STATE = ", ".join(["last long", "seen long", "refused long", "day long", "pv double", "traded double", "counts array<long>", "averages array<double>", *(f"{n} array<double>" for n in HELD)])


class Fold:
    """What has to be known of a series' past to take in its next bar: a few averages and at most 200 values each of a few columns."""

    def __init__(self, timeframe: str, state: tuple | None = None):
        self.year = sqrt(bars_per_year(timeframe)) * 100
        self.last, self.seen, self.refused, self.day, self.pv, self.traded, counts, averages, *held = state or (-(1 << 62), 0, 0, -(1 << 62), 0.0, 0.0, [0] * len(AVERAGES), [0.0] * len(AVERAGES), *([] for _ in HELD))
        self.counts, self.averages = dict(zip(AVERAGES, counts, strict=True)), dict(zip(AVERAGES, averages, strict=True))
        self.held = {n: [None if x is None or x != x else float(x) for x in xs] for n, xs in zip(HELD, held, strict=True)}

    def state(self) -> tuple:
        return (self.last, self.seen, self.refused, self.day, self.pv, self.traded, list(self.counts.values()), list(self.averages.values()), *self.held.values())

    def _hold(self, name: str, x: float | None) -> list:
        own = self.held[name]
        own.append(x)
        del own[: -HELD[name]]
        return own

    def _average(self, name: str, x: float | None) -> float | None:
        n, weight = AVERAGES[name]
        if x is None:
            return self.averages[name] if self.counts[name] >= n else None
        self.counts[name] += 1
        seen, value = self.counts[name], self.averages[name]
        self.averages[name] = value + (x - value) / seen if seen <= n else value + weight * (x - value)
        return self.averages[name] if seen >= n else None

    def update(self, at: int, final: bool, open_: float, high: float, low: float, close: float, volume: float) -> dict | None:
        """The features of a bar that opens at `at` (microseconds); None, and nothing else changed, if it isn't final or not newer than the last."""
        if not final or at <= self.last:
            self.refused += 1
            return None
        before = self.held["close"][-1] if self.seen else None
        old_high, old_low = (self.held["high"][-1], self.held["low"][-1]) if self.seen else (None, None)
        self.last, self.seen = at, self.seen + 1
        closes, highs, lows = self._hold("close", close), self._hold("high", high), self._hold("low", low)
        out = {}

        span = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
        out["true_range"] = span
        for n in (20, 50, 200):
            out[f"sma_{n}"] = fmean(closes[-n:]) if self.seen >= n else None
        steps = self._hold("step", log(close / before) if before is not None and before > 0 and close > 0 else None)
        if len(steps) == 20 and None not in steps:
            mean = fmean(steps)
            out["realised_vol_20"] = sqrt(fmean([(x - mean) ** 2 for x in steps])) * self.year
        if self.seen >= 20:
            mid = fmean(closes[-20:])
            sd = sqrt(fmean([(x - mid) ** 2 for x in closes[-20:]]))
            out |= {"bb_mid": mid, "bb_upper": mid + 2 * sd, "bb_lower": mid - 2 * sd, "bb_percent_b": (close - mid + 2 * sd) / (4 * sd) if 4 * sd > 1e-9 else 0.5, "bb_bandwidth": 4 * sd / mid * 100 if mid else None}
        if self.seen >= 14:
            top, bottom = max(highs), min(lows)
            k = self._hold("k", (close - bottom) / (top - bottom) * 100 if top > bottom else 50.0)
            if len(k) == 3:
                out |= {"stoch_k": k[-1], "stoch_d": fmean(k)}
        flow = 0.0 if before is None or close == before else volume if close > before else -volume
        obv = self._hold("obv", (self.held["obv"][-1] if self.held["obv"] else 0.0) + flow)
        out["obv"] = obv[-1]
        if self.seen > 20:
            out["obv_change_20"] = obv[-1] - obv[0]
        if at // 86_400_000_000 != self.day:
            self.day, self.pv, self.traded = at // 86_400_000_000, 0.0, 0.0
        self.pv, self.traded = self.pv + (high + low + close) / 3 * volume, self.traded + volume
        if self.traded > 0:
            vwap = self.pv / self.traded
            out |= {"vwap": vwap, "vwap_distance_pct": (close - vwap) / vwap * 100 if vwap > 0 else None}
        if self.seen > 10 and closes[-11] > 0:
            out["roc_10"] = (close - closes[-11]) / closes[-11] * 100

        for n in ("ema_9", "ema_21", "ema_50"):
            out[n] = self._average(n, close)
        fast, slow = self._average("fast", close), self._average("slow", close)
        if slow is not None:
            signal = self._average("signal", fast - slow)
            if signal is not None:
                out |= {"macd": fast - slow, "macd_signal": signal, "macd_histogram": fast - slow - signal}
        out["atr_14"] = atr = self._average("range", span)
        out["atr_pct"] = atr / close * 100 if atr is not None and close > 0 else None
        if before is not None:
            gain, loss = self._average("gain", max(close - before, 0.0)), self._average("loss", max(before - close, 0.0))
            if gain is not None:
                out["rsi_14"] = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
            up, down = high - old_high, old_low - low
            rise, fall = self._average("rise", up if up > down and up > 0 else 0.0), self._average("fall", down if down > up and down > 0 else 0.0)
            later = self._average("later", span)
            if later:
                plus, minus = 100 * rise / later, 100 * fall / later
                out |= {"plus_di": plus, "minus_di": minus, "adx": self._average("adx", 100 * abs(plus - minus) / (plus + minus) if plus + minus > 0 else 0.0)}
            else:
                out["adx"] = None
        out["change_pct"] = (close - open_) / open_ * 100 if open_ > 0 else 0.0
        out["range_pct"] = (high - low) / low * 100 if low > 0 else 0.0
        return out


class _Folded(StatefulProcessor):
    def __init__(self, timeframe: str, key: tuple[str, ...], least: int):
        self.timeframe, self.key, self.least, self.kind = timeframe, key, least, StructType.fromDDL(STATE)

    def init(self, handle) -> None:
        self.value = handle.getValueState("fold", self.kind)

    def _folded(self, rows: pd.DataFrame) -> list[tuple]:
        fold, out = Fold(self.timeframe, self.value.get() if self.value.exists() else None), []
        for r in rows.sort_values("open_time", kind="stable").itertuples(index=False):
            values = fold.update(int(pd.Timestamp(r.open_time).value // 1000), bool(r.is_final), r.open, r.high, r.low, r.close, r.volume)
            if values is not None and fold.seen >= self.least:
                out.append((r.open_time, r.close, fold.seen, fold.refused, *(values.get(n) for n in FEATURES)))
        self.value.update(fold.state())
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = self._folded(pd.concat(list(rows)))
        yield pd.DataFrame([(*key, *r) for r in got], columns=[*self.key, "open_time", "close", "bars_seen", "refused", *FEATURES])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self._folded(initialState)

    def close(self) -> None:
        pass


def history(bars: DataFrame, key: tuple[str, ...] = KEY, most: int | None = WARMUP + EXTRA) -> DataFrame:
    """The newest final stored bars of each series that a restart replays; all of them if most is None."""
    rows = bars.where("is_final")
    if most is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("open_time")))).where(F.col("_n") <= most).drop("_n")
    return rows


def folded(bars: DataFrame, timeframe: str, stored: DataFrame | None = None, key: tuple[str, ...] = KEY, least: int = WARMUP) -> DataFrame:
    """Of a stream of bars (key, open_time, open, high, low, close, volume, is_final) the features of each from the series' bar `least` on, and how many bars were refused so far.

    Bars that are provisional or not newer than their series' last are refused. stored (see history) warms up series that the
    stream has no state of. Needs the RocksDB state store (STATE_STORE = ROCKSDB). Also runs over a table, as one batch.
    """
    cols = [*key, "open_time", "open", "high", "low", "close", "volume", "is_final"]
    kinds = StructType([bars.schema[c] for c in key])
    out = StructType([*kinds, *StructType.fromDDL("open_time timestamp_ntz, close double, bars_seen long, refused long, " + ", ".join(f"{n} double" for n in FEATURES))])
    begin = None if stored is None else stored.select(*cols).groupBy(*key)
    bars.sparkSession.streams.active  # noqa: B018  a batch run, too, needs the coordinator of states that this starts
    return bars.select(*cols).groupBy(*key).transformWithStateInPandas(_Folded(timeframe, key, least), out, "Append", "None", begin)
