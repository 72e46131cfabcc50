"""Media diagnostics: variation, collinearity, cost outliers and date audits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendtrail.functions.metrics import finite
from spendtrail.operators.adstock import Adstock, adstock
from spendtrail.validate import require_columns, require_distinct

MAD = 1.4826


def _long(df: DataFrame, media: Sequence[str], by: Sequence[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("x")) for c in media])
    return df.select(*by, F.explode(each).alias("m")).select(*by, "m.channel", "m.x")


def variation(df: DataFrame, media: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(channel, mean, sd, cv, distinct, zero_share): means over groups, the worst group's cv, distinct values and zeros."""
    per = _long(df, media, by).groupBy(*by, "channel").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count_distinct("x").alias("distinct"), F.avg((F.col("x") == 0).cast("double")).alias("zero_share"))
    per = per.withColumn("cv", F.try_divide(F.col("sd"), F.abs("mean")))
    return per.groupBy("channel").agg(F.avg("mean").alias("mean"), F.avg("sd").alias("sd"), F.min("cv").alias("cv"), F.min("distinct").alias("distinct"), F.max("zero_share").alias("zero_share"))


def correlations(df: DataFrame, media: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(channel, partner, r): each channel's strongest correlation with another in any group, sign kept, on whole pairs."""
    pairs = [(a, b) for i, a in enumerate(media) for b in media[i + 1 :]]
    if not pairs:
        raise ValueError("correlation needs two channels")
    per = df.groupBy(*by).agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)).cast("double"), F.when(F.col(a).isNotNull(), F.col(b)).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    both = [(a, b, i) for i, (a, b) in enumerate(pairs)] + [(b, a, i) for i, (a, b) in enumerate(pairs)]
    each = F.array(*[F.struct(F.lit(a).alias("channel"), F.lit(b).alias("partner"), F.col(f"r{i}").alias("r")) for a, b, i in both])
    rows = per.select(F.explode(each).alias("x")).select("x.*").where(finite(F.col("r")))
    return rows.groupBy("channel").agg(F.max_by(F.struct("partner", "r"), F.struct(F.abs("r"), F.col("partner"))).alias("w")).select("channel", "w.partner", "w.r")


def vif(df: DataFrame, media: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(channel, vif): the largest over groups of 1 / (1 - R2) against the other channels; infinite where R2 is 1. The largest comes
    first, channels without one last, ties by name.

    Only sums and products of channels leave Spark's aggregation, a matrix for each group.
    """
    k = len(media)
    whole = df.dropna(subset=list(media))
    centre = Window.partitionBy(*by)
    rows = whole.select(*by, *[(F.col(c).cast("double") - F.avg(c).over(centre)).alias(f"c{i}") for i, c in enumerate(media)])
    sums = rows.groupBy(*by).agg(F.array(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")) for i in range(k) for j in range(k)]).alias("g"))

    def invert(batches):
        for batch in batches:
            out = []
            for g in batch["g"]:
                s = np.asarray(g, float).reshape(k, k)
                for i, c in enumerate(media):
                    rest = [j for j in range(k) if j != i]
                    r2 = 0.0
                    if rest and s[i, i] > 0:
                        beta = np.linalg.lstsq(s[np.ix_(rest, rest)], s[rest, i], rcond=None)[0]
                        r2 = float(beta @ s[rest, i] / s[i, i])
                    out.append((c, np.nan if s[i, i] <= 0 else np.inf if r2 >= 1 - 1e-10 else 1 / (1 - r2)))
            yield pd.DataFrame(out, columns=["channel", "vif"])

    return sums.select("g").mapInPandas(invert, "channel string, vif double").groupBy("channel").agg(F.max(F.nanvl("vif", F.lit(None).cast("double"))).alias("vif")).orderBy(F.desc_nulls_last("vif"), "channel")


def cpm_outliers(df: DataFrame, spend: str, impressions: str, index: str, by: Sequence[str] = ()) -> DataFrame:
    """(index, by..., cpm, median, outlier): cost per thousand further than 5 MADs from its series' median, or, where the MAD is
    0, over twice or under half of it. Rows without impressions are left out."""
    series = Window.partitionBy(*by)
    rows = df.where(F.col(impressions) > 0).select(index, *by, (F.col(spend) / F.col(impressions) * 1000).alias("cpm"))
    rows = rows.withColumn("median", F.median("cpm").over(series)).withColumn("off", F.abs(F.col("cpm") - F.col("median")))
    rows = rows.withColumn("mad", MAD * F.median("off").over(series))
    far = F.when(F.col("mad") > 0, F.col("off") > 5 * F.col("mad")).otherwise((F.col("cpm") > 2 * F.col("median")) | (F.col("cpm") < F.col("median") / 2))
    return rows.select(index, *by, "cpm", "median", far.alias("outlier"))


def day_number(df: DataFrame, index: str):
    kind = df.schema[index].dataType.typeName()
    return F.unix_date(F.col(index).cast("date")).cast("double") if kind in ("date", "timestamp", "timestamp_ntz") else F.col(index).cast("double")


def date_audit(df: DataFrame, index: str, by: Sequence[str] = (), row_order: str | None = None) -> DataFrame:
    """(by..., rows, start, end, period, out_of_order, duplicated, missing, irregular) of each series.

    period: median step of its distinct times; missing: periods that gaps leave out; irregular: steps further than a quarter of
    a period from a multiple of it; out_of_order: rows earlier than the row before by ``row_order``, null without that.
    """
    rows = df.select(*by, day_number(df, index).alias("t"), *([F.col(row_order).alias("_row")] if row_order else []))
    if row_order:
        rows = rows.withColumn("_back", (F.col("t") < F.lag("t").over(Window.partitionBy(*by).orderBy("_row"))).cast("int"))
    counts = rows.groupBy(*by, "t").agg(F.count("*").alias("n"), *([F.sum("_back").alias("back")] if row_order else [F.lit(None).cast("long").alias("back")]))
    steps = counts.withColumn("step", F.col("t") - F.lag("t").over(Window.partitionBy(*by).orderBy("t")))
    steps = steps.withColumn("period", F.median("step").over(Window.partitionBy(*by)))
    ratio = F.try_divide(F.col("step"), F.col("period"))
    off = F.abs(ratio - F.greatest(F.lit(1.0), F.round(ratio)))
    return steps.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.min("t").alias("start"), F.max("t").alias("end"), F.max("period").alias("period"), (F.coalesce(F.sum("back"), F.lit(0)) if row_order else F.lit(None).cast("long")).alias("out_of_order"),
        F.sum(F.col("n") - 1).alias("duplicated"), F.coalesce(F.sum(F.greatest(F.round(ratio) - 1, F.lit(0.0))), F.lit(0.0)).cast("long").alias("missing"), F.count_if(off > 0.25).alias("irregular"),
    )


def carry_class(history: DataFrame, new: DataFrame, index: str, by: Sequence[str], tolerance: float = 0.25) -> DataFrame:
    """(by..., carry): how new data joins a series' history.

    unseen: it has none. overlap: the new data starts before the history, on one of its times, or a period after one of them.
    contiguous: about a period after its last time. misaligned: less than that after the time before; gap: more. The bound is
    ``tolerance`` of a period, the median step of the series; one of a single time borrows the median of the others', and without
    any the class is unknown_period.
    """
    old = history.select(*by, day_number(history, index).alias("t")).where(F.col("t").isNotNull()).distinct()
    steps = old.withColumn("step", F.col("t") - F.lag("t").over(Window.partitionBy(*by).orderBy("t")))
    own = steps.groupBy(*by).agg(F.median("step").alias("own"))
    pooled = own.agg(F.median("own").alias("pooled"))  # one row
    starts = new.select(*by, day_number(new, index).alias("t")).groupBy(*by).agg(F.min("t").alias("first"))
    joined = old.join(starts, list(by)) if by else old.crossJoin(F.broadcast(starts))
    before = joined.groupBy(*by).agg(F.max("t").alias("last"), F.max(F.when(F.col("t") < F.col("first"), F.col("t"))).alias("before"), F.count_if(F.col("t") == F.col("first")).alias("same"))
    known = before.join(own, list(by)) if by else before.crossJoin(F.broadcast(own))
    period = F.coalesce("own", "pooled")
    lead = (F.col("first") - F.col("before")) / period
    kind = (
        F.when(F.col("last").isNull(), "unseen")
        .when(F.col("before").isNull() | (F.col("same") > 0), "overlap")
        .when(period.isNull(), "unknown_period")
        .when(lead < 1 - tolerance, "misaligned")
        .when(lead > 1 + tolerance, "gap")
        .when(F.col("before") < F.col("last"), "overlap")
        .otherwise("contiguous")
    )
    met = starts.join(known, list(by), "left") if by else starts.join(known, how="left")
    return met.crossJoin(F.broadcast(pooled)).select(*by, kind.alias("carry"))


@dataclass
class Diagnosis:
    variation: DataFrame
    collinearity: DataFrame
    correlations: DataFrame | None
    dates: DataFrame | None
    cpm: DataFrame | None

    def flags(self, vif_threshold: float = 5, cv_threshold: float = 0.15, correlation_threshold: float | None = None) -> list[str]:
        """What to look at, in words; runs the tables, which have a row for each channel or series. Problems of the index come first."""
        out = []
        if self.dates is not None:
            for r in self.dates.collect():
                out += [f"the index has {r[k]} {k} rows" for k in ("out_of_order", "duplicated", "missing", "irregular") if r[k]]
        varied = self.variation.orderBy("channel").collect()
        out += [f"{r['channel']} has no usable values" for r in varied if not r["distinct"]]
        out += [f"{r['channel']} hardly varies (cv {r['cv']:.3g})" for r in varied if r["cv"] is not None and r["cv"] < cv_threshold]
        out += [f"{r['channel']} is mostly zero" for r in varied if r["zero_share"] is not None and r["zero_share"] > 0.5]
        tangled = self.collinearity.orderBy("channel").collect()
        if len(varied) > 1 and not any(r["vif"] is not None for r in tangled):
            out.append("collinearity could not be assessed, as no channel varies enough beside the others")
        out += [f"{r['channel']} is collinear (VIF {r['vif']:.3g})" for r in tangled if r["vif"] is not None and r["vif"] > vif_threshold]
        if correlation_threshold is not None and self.correlations is not None:
            found = self.correlations.where(F.abs("r") > correlation_threshold).orderBy("channel").collect()
            out += [f"{r['channel']} goes with {r['partner']} (r {r['r']:.3g})" for r in found]
        if self.cpm is not None and (odd := self.cpm.where("outlier").count()):
            out.append(f"{odd} periods have an odd cost per thousand")
        return out


def diagnose_media(
    df: DataFrame, media: Sequence[str], by: Sequence[str] = (), date: str | None = None, row_order: str | None = None, spend: str | None = None, impressions: str | None = None, decay: float | dict[str, float] | None = None
) -> Diagnosis:
    """The tables of a media diagnosis. With ``decay``, one for all channels or by name, collinearity and correlations are those
    of the carried-over series, in the order of ``date`` or ``row_order``; missing spend counts as none there."""
    require_distinct(media, "media")
    require_columns(df, [*by, *[c for c in (date, row_order) if c]], numeric=[*media, *[c for c in (spend, impressions) if c]])
    carried = df
    if decay is not None:
        decays = decay if isinstance(decay, dict) else dict.fromkeys(media, decay)
        if unknown := set(decays) - set(media):
            raise ValueError(f"decay names no channels: {sorted(unknown)}")
        if not (date or row_order):
            raise ValueError("decay needs date or row_order, which put a series in order")
        names = {f"_carried_{c}": (c, Adstock("geometric", d)) for c, d in decays.items()}
        carried = adstock(df, names, date or row_order, by, na_action="zero").drop(*decays).withColumnsRenamed({f"_carried_{c}": c for c in decays})
    return Diagnosis(
        variation(df, media, by),
        vif(carried, media, by),
        correlations(carried, media, by) if len(media) > 1 else None,
        date_audit(df, date, by, row_order) if date else None,
        cpm_outliers(df, spend, impressions, date, by) if spend and impressions and date else None,
    )
