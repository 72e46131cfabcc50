"""Block bootstrap of time series and panels."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendtrail.validate import require_columns, require_number


def draws(positions: int, times: int, block_length: int, seed: int, circular: bool, spark, by: DataFrame | None = None) -> DataFrame:
    """(replicate[, by...], pos, source): positions 1..n of each replicate and where they come from.

    A block's start is a hash of seed, replicate, block and group, so draws don't depend on partitions.
    """
    blocks = math.ceil(positions / block_length)
    starts = positions if circular else positions - block_length + 1
    base = spark.range(1, times + 1).select(F.col("id").cast("int").alias("replicate"))
    keys = []
    if by is not None:
        keys = by.columns
        base = by.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("replicate"))
    block = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    block = block.withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "replicate", "block", *keys), F.lit(starts)))
    rows = block.select(*keys, "replicate", (F.col("block") * block_length).alias("first"), "start", F.explode(F.sequence(F.lit(0), F.lit(block_length - 1))).alias("k"))
    rows = rows.select(*keys, "replicate", (F.col("first") + F.col("k") + 1).alias("pos"), (F.pmod(F.col("start") + F.col("k"), F.lit(positions)) + 1).cast("int").alias("source"))
    return rows.where(F.col("pos") <= positions)


def resampled(df: DataFrame, index: str, times: int = 200, block_length: int | None = None, by: Sequence[str] = (), seed: int = 1, circular: bool = False, shared: bool = True) -> DataFrame:
    """Rows of ``df`` for each replicate, with ``replicate`` and ``_pos``. ``shared``: groups of a panel draw the same periods."""
    keyed = df.withColumn("_source", F.dense_rank().over(Window.partitionBy(*by).orderBy(index)))
    n = int(keyed.agg(F.max("_source")).first()[0])
    length = block_length or math.ceil(n ** (1 / 3))
    if not 1 <= length <= n:
        raise ValueError("block_length must be between 1 and the number of periods")
    apart = bool(by) and not shared
    drawn = draws(n, times, length, seed, circular, df.sparkSession, df.select(*by).distinct() if apart else None)
    on = ["_source", *(by if apart else [])]
    return keyed.join(drawn.withColumnRenamed("source", "_source").withColumnRenamed("pos", "_pos"), on).drop("_source")


def block_bootstrap(df: DataFrame, statistic: Callable[[pd.DataFrame], dict[str, float]], index: str, times: int = 200, block_length: int | None = None, by: Sequence[str] = (), level: float = 0.9, seed: int = 1, circular: bool = False, shared: bool = True) -> tuple[DataFrame, DataFrame]:
    """((term, estimate, lower, upper, std_error), (replicate, term, value)).

    ``statistic`` takes one replicate's rows in order and returns named numbers; replicate 0 is the data itself. Replicates
    run side by side; values that aren't finite don't count, and fewer than two leave bounds null.
    """
    require_columns(df, [*by, index])
    require_number(times, "times", 1, whole=True)
    require_number(level, "level", 1e-9, 1 - 1e-9)
    own = df.withColumns({"replicate": F.lit(0), "_pos": F.dense_rank().over(Window.partitionBy(*by).orderBy(index))})
    rows = resampled(df, index, times, block_length, by, seed, circular, shared).unionByName(own)

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values([*by, "_pos"], ignore_index=True)
        got = statistic(one.drop(columns=["replicate", "_pos"]))
        return pd.DataFrame({"replicate": one["replicate"].iloc[0], "term": list(got), "value": [float(v) for v in got.values()]})

    values = rows.groupBy("replicate").applyInPandas(run, "replicate int, term string, value double")
    return summary(values, level), values.where("replicate > 0")


def summary(values: DataFrame, level: float = 0.9) -> DataFrame:
    tail = (1 - level) / 2
    drawn = (F.col("replicate") > 0) & ~F.isnan("value") & (F.abs("value") < float("inf"))
    x = F.when(drawn, F.col("value"))
    enough = F.count(x) > 1
    ends = F.percentile(x, F.array(F.lit(tail), F.lit(1 - tail)))
    out = values.groupBy("term").agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("estimate"), F.when(enough, ends).alias("e"), F.when(enough, F.stddev_samp(x)).alias("std_error"))
    return out.select("term", "estimate", F.col("e")[0].alias("lower"), F.col("e")[1].alias("upper"), "std_error")
