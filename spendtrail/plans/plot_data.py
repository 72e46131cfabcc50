"""Tables behind the usual charts, and the palette. Drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Eight distinct colours, in order of use.
PALETTE = ["#1b6ca8", "#e07a1f", "#3b8f4a", "#b8323a", "#7a5aa6", "#8a6a4f", "#c9609b", "#5f6b73"]


#: Neutral colours by what they are for.
INK = {"surface": "#ffffff", "primary": "#161616", "secondary": "#4d4d4d", "muted": "#8c8c8c", "grid": "#e6e6e6", "axis": "#bdbdbd"}


def ink(role: str) -> str:
    if role not in INK:
        raise ValueError(f"role is one of {', '.join(INK)}")
    return INK[role]


def palette(n: int) -> list[str]:
    if not 1 <= n <= len(PALETTE):
        raise ValueError(f"there are {len(PALETTE)} colours")
    return PALETTE[:n]


def contribution_bands(contributions: DataFrame, most: int = 8) -> DataFrame:
    """Contributions by period and channel; beyond ``most`` channels the smaller ones by absolute sum are one, Other."""
    size = contributions.groupBy("channel").agg(F.sum(F.abs("contribution")).alias("size"))
    rank = size.withColumn("n", F.row_number().over(Window.partitionBy().orderBy(F.desc("size"), "channel"))).withColumn("channels", F.count("*").over(Window.partitionBy()))
    named = rank.select("channel", F.when((F.col("channels") > most) & (F.col("n") >= most), "Other").otherwise(F.col("channel")).alias("band"))
    return contributions.join(F.broadcast(named), "channel").groupBy("period", "band").agg(F.sum("contribution").alias("contribution"))


def top_channels(attribution: DataFrame, n: int = 8) -> DataFrame:
    """Rows of the ``n`` channels of largest mean share."""
    best = attribution.groupBy("channel").agg(F.avg("share").alias("mean_share")).orderBy(F.desc("mean_share"), "channel").limit(n)
    return attribution.join(F.broadcast(best.select("channel")), "channel", "left_semi")


def allocation_changes(table: DataFrame) -> DataFrame:
    """Spend and response changes of an allocation, largest increase first."""
    return table.select("channel", (F.col("recommended_spend") - F.col("current_spend")).alias("spend_change"), (F.col("recommended_response") - F.col("current_response")).alias("response_change")).orderBy(F.desc("spend_change"), "channel")
