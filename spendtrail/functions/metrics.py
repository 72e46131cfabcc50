"""Error metrics and simple least squares as aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def rmse(actual: Column, predicted: Column) -> Column:
    """Over pairs that are both finite; null if there are none."""
    ok = finite(actual) & finite(predicted)
    return F.sqrt(F.avg(F.when(ok, F.pow(actual - predicted, F.lit(2.0)))))


def mae(actual: Column, predicted: Column) -> Column:
    ok = finite(actual) & finite(predicted)
    return F.avg(F.when(ok, F.abs(actual - predicted)))


def ols(x: Column, y: Column) -> Column:
    """struct(n, intercept, slope) of y on x by centred sums; a constant x has slope 0 and the mean as intercept."""
    pair = x.isNotNull() & y.isNotNull()
    sxx = F.regr_sxx(F.when(pair, y), F.when(pair, x))
    scale = F.sum(F.when(pair, x * x))
    flat = F.coalesce(sxx <= EPS * scale, F.lit(True))
    slope = F.when(flat, 0.0).otherwise(F.try_divide(F.regr_sxy(y, x), sxx))
    return F.struct(F.count_if(pair).alias("n"), (F.avg(F.when(pair, y)) - slope * F.avg(F.when(pair, x))).alias("intercept"), slope.alias("slope"))
