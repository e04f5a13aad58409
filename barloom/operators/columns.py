"""A user's own indicators beside the library's: column builders that declare inputs and warm-up, in the one-sort plan of the windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

KEY = ("asset", "source", "timeframe")


@dataclass(frozen=True)
class Indicator:
    """build(order) gives the column, order being the series' window; it is null before `warmup` bars."""

    name: str
    inputs: tuple[str, ...]
    warmup: int
    build: Callable[[WindowSpec], Column]


_KNOWN: dict[str, Indicator] = {}


def indicator(name: str, inputs: tuple[str, ...], warmup: int = 1) -> Callable[[Callable[[WindowSpec], Column]], Callable[[WindowSpec], Column]]:
    """Registers the decorated builder."""

    def add(build: Callable[[WindowSpec], Column]) -> Callable[[WindowSpec], Column]:
        if name in _KNOWN:
            raise ValueError(f"an indicator named {name} is registered")
        _KNOWN[name] = Indicator(name, inputs, warmup, build)
        return build

    return add


def registered() -> dict[str, Indicator]:
    return dict(_KNOWN)


def warmup(*names: str) -> int:
    """Bars that a series needs before all of the named are defined."""
    return max((_KNOWN[n].warmup for n in names), default=0)


def with_indicators(bars: DataFrame, *names: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """bars with the named indicators, those that read others after them; columns of one step share one sort of the series."""
    order = Window.partitionBy(*key).orderBy("open_time")
    out = bars.withColumn("_seen", F.row_number().over(order))
    left = list(dict.fromkeys(names))
    while left:
        ready = [n for n in left if all(i in out.columns for i in _KNOWN[n].inputs)]
        if not ready:
            missing = sorted({i for n in left for i in _KNOWN[n].inputs if i not in out.columns and i not in left})
            raise ValueError(f"unknown inputs: {', '.join(missing) or 'indicators that need each other'}")
        out = out.withColumns({n: F.when(F.col("_seen") >= _KNOWN[n].warmup, _KNOWN[n].build(order)) for n in ready})
        left = [n for n in left if n not in ready]
    return out.drop("_seen")


@indicator("range_share", ("high", "low", "close"), 20)
def _range_share(order: WindowSpec) -> Column:
    """Where the close lies between the lowest low and the highest high of 20 bars."""
    top, bottom = F.max("high").over(order.rowsBetween(-19, 0)), F.min("low").over(order.rowsBetween(-19, 0))
    return F.when(top > bottom, (F.col("close") - bottom) / (top - bottom)).otherwise(0.5)


@indicator("range_share_mean", ("range_share",), 24)
def _range_share_mean(order: WindowSpec) -> Column:
    return F.avg("range_share").over(order.rowsBetween(-4, 0))


def register_folds(spark: SparkSession, folds: dict[str, tuple[Callable[[], object], str]]) -> None:
    """Makes folds over a series table functions of SQL: SELECT * FROM name(TABLE(bars) PARTITION BY asset ORDER BY open_time).

    folds: name -> (make, schema). make() gives an object with update(row), which returns a tuple of the schema or None; each series
    has its own, and Spark deals and sorts the series.
    """
    for name, (make, schema) in folds.items():
        spark.udtf.register(name, udtf(_handler(make), returnType=schema))


def _handler(make: Callable[[], object]) -> type:
    class Folded:
        def __init__(self):
            self.fold = make()

        def eval(self, row):
            out = self.fold.update(row)
            if out is not None:
                yield out

        def terminate(self):
            return
            yield

    return Folded
