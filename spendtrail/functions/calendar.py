"""Seasonal terms and holiday flags."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fourier_terms(df: DataFrame, index: str, harmonics: int = 2, cycle: float | None = None, prefix: str = "fourier") -> DataFrame:
    """``df`` with sin and cos columns for each harmonic: of the year for dates, of ``cycle`` for a numeric index."""
    if harmonics < 1:
        raise ValueError("harmonics must be at least 1")
    kind = df.schema[index].dataType.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        if cycle is not None:
            raise ValueError("cycle is for a numeric index")
        t = (F.dayofyear(index) - 1) / F.lit(365.25)
    else:
        if not cycle or cycle <= 0:
            raise ValueError("a numeric index needs a positive cycle")
        t = F.col(index) / F.lit(float(cycle))
    terms = {}
    for k in range(1, harmonics + 1):
        terms[f"{prefix}_sin{k}"] = F.sin(F.lit(2 * math.pi * k) * t)
        terms[f"{prefix}_cos{k}"] = F.cos(F.lit(2 * math.pi * k) * t)
    return df.withColumns(terms)


def steps_of(df: DataFrame, index: str) -> DataFrame:
    """One row: period, the median step in days between the distinct days of ``index`` (null for fewer than two), and close, how
    many steps are shorter, so that periods of that length overlap and a holiday within an overlap is flagged twice."""
    days = df.select(F.unix_date(F.col(index).cast("date")).alias("day")).where("day is not null").distinct()  # as many as the calendar has
    steps = days.select((F.col("day") - F.lag("day").over(Window.orderBy("day"))).alias("step"))
    period = steps.agg(F.median("step").alias("period"))
    return period.crossJoin(F.broadcast(steps.groupBy().agg(F.collect_list("step").alias("steps")))).select("period", F.size(F.filter("steps", lambda x: x < F.col("period"))).alias("close"))


def holiday_flags(df: DataFrame, index: str, holidays: dict[str, list[dt.date]], period: float | None = None, align: str = "start", prefix: str = "holiday") -> DataFrame:
    """``df`` with a 0/1 column for each named holiday: whether one of its dates falls within the row's period.

    align start: the period is [date, date + period); end: (date - period, date]. Without a ``period``, of days, it is the median
    step of the index (``steps_of`` tells it, and whether periods overlap), joined as one row; an index of a single day is refused
    when it is run. The lists are literals in the plan.
    """
    if align not in ("start", "end") or (period is not None and not period >= 1):
        raise ValueError("align must be start or end, and period at least 1 day")
    span, rows = F.lit(period), df
    if period is None:
        inferred = steps_of(df, index).select(F.coalesce("period", F.raise_error(F.lit("period can't be inferred from fewer than two days")).cast("double")).alias("_period"))
        rows, span = df.crossJoin(F.broadcast(inferred)), F.col("_period")
    day = F.col(index).cast("date")

    def flag(dates: list[dt.date]) -> Column:
        at = F.array(*[F.lit(d) for d in sorted(set(dates))]) if dates else F.array().cast("array<date>")
        within = (lambda h: (h >= day) & (F.date_diff(h, day) < span)) if align == "start" else (lambda h: (h <= day) & (F.date_diff(day, h) < span))
        return F.exists(at, within).cast("int")

    return rows.withColumns({f"{prefix}_{name}": flag(dates) for name, dates in holidays.items()}).select(*df.columns, *[f"{prefix}_{name}" for name in holidays])
