"""Scalar expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles rounded, as sums differ in their last digits with the order of rows."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def ratio(a: Column, b: Column, other: float | None = 0.0) -> Column:
    """a / b, or the other value where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(other).cast("double"))


def divided(a: Column, b: Column) -> Column:
    """a / b as DuckDB divides doubles: infinite where only b is 0, NaN where both are. Spark's own division fails there."""
    odd = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b != 0, a / b).when(b == 0, odd)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def squash(x: Column, scale: float) -> Column:
    """x / scale, drawn into (-1, 1)."""
    return x / scale / (1 + F.abs(x / scale))


def let(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is referred to: also inside lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def median(xs: Column) -> Column:
    """The median of an array, the mean of the two middle values if their number is even; null if empty."""

    def middle(s):
        n = F.size(s)
        mid = F.floor(n / 2).cast("int")
        return F.when(n == 0, None).when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2)

    return let(F.array_sort(xs), middle)


def mad_scale(xs: Column, centre: Column) -> Column:
    """1.4826 times the median distance from the centre: sigma, for normal data."""
    return let(centre, lambda c: median(F.transform(xs, lambda x: F.abs(x - c)))) * 1.4826


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """Struct (low, high) of the Wilson interval; (0, 1) without trials."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.struct(
        F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0).alias("low"),
        F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0).alias("high"),
    )


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 by Abramowitz and Stegun 26.2.17: absolute error below 7.5e-8. Neither Spark nor DuckDB has erf."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def two_proportion_p(s1: Column, n1: Column, s2: Column, n2: Column) -> Column:
    """Two-sided p of the pooled z-test; 1 without trials or without variance."""
    pooled = (s1 + s2) / (n1 + n2)
    z = (s1 / n1 - s2 / n2) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return F.when((n1 > 0) & (n2 > 0) & (pooled > 0) & (pooled < 1), F.least(F.lit(1.0), 2 * normal_tail(F.abs(z)))).otherwise(1.0)


#: SQL of normal_tail for z >= 0, for the queries' DuckDB text.
def sql_tail(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * ({z})))"
    return f"(exp(-({z}) * ({z}) / 2) * 0.3989422804014327 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
