"""Journey diagnostics and path strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrail.operators.credit import _frame
from spendtrail.operators.journeys import Journeys


def path_summary(paths: Journeys) -> DataFrame:
    """One row: counts of construction, and mean, median and largest journey length."""
    lengths = paths.df.where("touch_rank = 1").agg(F.avg("touch_n").alias("mean_length"), F.median("touch_n").alias("median_length"), F.max("touch_n").alias("max_length"))
    both = paths.counts().unionByName(lengths, allowMissingColumns=True)
    front = ["events_in", "events_out", "journeys", "converting_journeys", "mean_length", "median_length", "max_length", "direct_events", "conversion_events", "conversions_observed", "conversions_unattributable", "journeys_before_filtering", "duplicate_events", "multi_conversion_journeys", "conversions_merged"]
    return both.agg(*[F.max(c).alias(c) for c in front])


def path_lengths(paths) -> DataFrame:
    journeys = _frame(paths).where("touch_rank = 1")
    out = journeys.groupBy(F.col("touch_n").alias("length")).agg(F.count("*").alias("journeys"), F.count_if("converted").alias("converting"))
    return out.withColumn("conversion_rate", F.col("converting") / F.col("journeys")).orderBy("length")


def channel_positions(paths, converting_only: bool = True) -> DataFrame:
    """How often each channel is a journey's only, first, middle or last touch."""
    df = _frame(paths).where("converted") if converting_only else _frame(paths)
    only, first, last = F.col("touch_n") == 1, F.col("touch_rank") == 1, F.col("touch_rank") == F.col("touch_n")
    out = df.groupBy("channel").agg(
        F.count_if(only).alias("only"), F.count_if(~only & first).alias("first"), F.count_if(~first & ~last).alias("middle"), F.count_if(~only & last).alias("last"), F.count("*").alias("touches")
    )
    return out.withColumn("first_last_ratio", F.try_divide(F.col("first").cast("double"), F.col("last"))).orderBy(F.desc("touches"), "channel")


def assisted_conversions(paths, normalise: bool = False) -> DataFrame:
    """(assisting, assisted, n): converting journeys in which the one comes somewhere before the other.

    Only each channel's first and last rank in a journey matter, so a journey makes at most the square of its distinct
    channels, however long it is. Pairs that never occur are absent. ``normalise``: share of the converting journeys that
    hold the assisting channel.
    """
    df = _frame(paths).where("converted")
    spans = df.groupBy("path_id", "channel").agg(F.min("touch_rank").alias("first"), F.max("touch_rank").alias("last"))
    held = spans.groupBy("path_id").agg(F.collect_list(F.struct("channel", "first", "last")).alias("s"))
    pair = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: a.first < b.last), lambda b: F.struct(a.channel.alias("assisting"), b.channel.alias("assisted")))))
    counts = held.select(F.explode(pair).alias("p")).groupBy("p.assisting", "p.assisted").agg(F.count("*").alias("n"))
    if not normalise:
        return counts
    present = spans.groupBy(F.col("channel").alias("assisting")).agg(F.count("*").alias("present"))
    return counts.join(present, "assisting").select("assisting", "assisted", (F.col("n") / F.col("present")).alias("n"))


def path_strings(paths, sep: str = " > ") -> DataFrame:
    """(path_id, path, converted, conversion_value): channels in rank order; a channel that holds the separator raises."""
    if not sep.strip():
        raise ValueError("the separator can't be blank")
    clash = F.when(F.contains(F.col("channel"), F.lit(sep)), F.raise_error(F.lit(f"a channel holds the separator {sep!r}")).cast("string")).otherwise(F.col("channel"))
    df = _frame(paths).select("path_id", "touch_rank", clash.alias("channel"), "converted", "conversion_value")
    rows = df.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("touch_rank", "channel"))).alias("t"), F.first("converted").alias("converted"), F.first("conversion_value").alias("conversion_value"))
    return rows.select("path_id", F.array_join(F.transform("t", lambda x: x.channel), sep).alias("path"), "converted", "conversion_value")


def top_paths(paths, n: int = 10, sep: str = " > ", converting_only: bool = False) -> DataFrame:
    rows = path_strings(paths, sep)
    rows = rows.where("converted") if converting_only else rows
    out = rows.groupBy("path").agg(F.count("*").alias("journeys"), F.count_if("converted").alias("conversions"))
    return out.withColumn("conversion_rate", F.col("conversions") / F.col("journeys")).orderBy(F.desc("journeys"), "path").limit(n)


def as_channel_paths(paths, sep: str = " > ") -> DataFrame:
    """(path, total_conversions, total_null, total_conversion_value), most conversions first."""
    out = path_strings(paths, sep).groupBy("path").agg(
        F.count_if("converted").cast("double").alias("total_conversions"), F.count_if(~F.col("converted")).cast("double").alias("total_null"), F.sum(F.when(F.col("converted"), F.coalesce("conversion_value", F.lit(0.0))).otherwise(0.0)).alias("total_conversion_value")
    )
    return out.orderBy(F.desc("total_conversions"), F.desc("total_null"), "path")


def conversion_lag(paths, probs: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99, 1.0)) -> DataFrame:
    """(quantile, lag): type-7 quantiles of each converting journey's longest time to conversion."""
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probs are probabilities between 0 and 1")
    lags = _frame(paths).where("converted").groupBy("path_id").agg(F.max("time_to_conversion").alias("lag")).where("lag is not null")
    at = F.array(*[F.lit(float(p)) for p in probs])
    got = lags.agg(F.percentile("lag", at).alias("lags"))
    both = F.arrays_zip(at.alias("quantile"), F.coalesce("lags", F.array_repeat(F.lit(None).cast("double"), len(probs))).alias("lag"))
    return got.select(F.explode(both).alias("x")).select(F.col("x.quantile").alias("quantile"), F.col("x.lag").alias("lag"))


def path_diagnostics(paths: Journeys, n: int = 10) -> dict[str, DataFrame]:
    """All diagnostics of one journey table; cache ``paths.df`` before and release it after if all are to be run."""
    return {
        "summary": path_summary(paths),
        "lengths": path_lengths(paths),
        "positions": channel_positions(paths),
        "assists": assisted_conversions(paths, normalise=True),
        "top_paths": top_paths(paths, n),
        "lag": conversion_lag(paths),
    }
