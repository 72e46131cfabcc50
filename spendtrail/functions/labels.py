"""Readable names of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETWEEN = " / "


def group_label(by: Sequence[str]) -> Column:
    """The values of the ``by`` columns joined by " / ", missing ones as (missing). A value that holds " / " itself is refused when
    it is run, as two groups could then have one label; a single column is taken as it is."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("(missing)")) for c in by]
    if len(values) == 1:
        return values[0]
    clash = F.raise_error(F.concat(F.lit(f"a value of {', '.join(by)} contains {BETWEEN!r}, so labels could be the same for two groups"))).cast("string")
    return F.concat_ws(BETWEEN, *[F.when(F.contains(v, F.lit(BETWEEN)), clash).otherwise(v) for v in values])


def labelled(df: DataFrame, by: Sequence[str], name: str = "group") -> DataFrame:
    return df.withColumn(name, group_label(by))
