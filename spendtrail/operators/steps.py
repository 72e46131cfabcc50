"""Fitted transformers for pipelines: carryover with remembered history, saturation with learnt reference levels."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendtrail.functions.saturation import saturate
from spendtrail.operators.adstock import Adstock, adstock, adstock_steady_state
from spendtrail.operators.diagnose import carry_class
from spendtrail.validate import require_columns

RANGES = {"decay": (0.0, 0.95), "max_lag": (1, 26), "shape": (0.5, 5.0), "scale": (0.5, 10.0), "peak": (0.0, 4.0), "half_max": (0.05, 1.0), "saturation_shape": (0.5, 3.0), "exponent": (0.1, 1.0)}
CURVE_RANGES = {"hill": {"half_max": "half_max", "shape": "saturation_shape"}, "michaelis_menten": {"half_max": "half_max"}, "exponential": {"half_max": "half_max"}, "power": {"exponent": "exponent"}}


def parameter_grid(name: str, levels: int = 5) -> list[float]:
    """Evenly spaced values of a tunable parameter's range; whole numbers for max_lag."""
    low, high = RANGES[name]
    values = [low + (high - low) * i / (levels - 1) for i in range(levels)]
    return sorted({int(round(v)) for v in values}) if name == "max_lag" else values


class AdstockStep(Estimator):
    """Learns a training table's media history, so that new rows are filtered as if the series had never been cut.

    carry_over: warm always continues, cold never does; auto continues series whose new rows overlap or follow on their history
    and starts others cold. start: zero or steady, what a series has before its first training row.
    """

    def __init__(self, channels: dict[str, Adstock], index: str, by: Sequence[str] = (), carry_over: str = "auto", start: str = "zero", prefix: str = "", keep_original: bool = True):
        super().__init__()
        if index in channels or set(by) & set(channels):
            raise ValueError("the index and the columns of a series can't be channels")
        if carry_over not in ("auto", "warm", "cold") or start not in ("zero", "steady"):
            raise ValueError("carry_over is auto, warm or cold; start zero or steady")
        if not prefix and keep_original:
            prefix = "adstock_"
        self.channels, self.index, self.by = dict(channels), index, list(by)
        self.carry_over, self.start, self.prefix, self.keep_original = carry_over, start, prefix, keep_original

    def _fit(self, dataset: DataFrame) -> AdstockModel:
        require_columns(dataset, [*self.by, self.index], "the training table", numeric=list(self.channels))
        history = dataset.select(*self.by, self.index, *self.channels)
        seed = None
        if self.start == "steady":
            for c, k in self.channels.items():
                part = adstock_steady_state(history, c, k, self.index, self.by)
                seed = part if seed is None else seed.join(part, self.by) if self.by else seed.crossJoin(part)
        return AdstockModel(self, history, seed)

    def tunable(self) -> dict[str, tuple]:
        names = {"geometric": ("decay", "max_lag"), "weibull": ("shape", "scale", "max_lag"), "delayed": ("decay", "peak", "max_lag")}
        return {f"{c}.{p}": RANGES[p] for c, k in self.channels.items() for p in names.get(k.kind, ())}


class AdstockModel(Model):
    def __init__(self, step: AdstockStep, history: DataFrame, seed: DataFrame | None):
        super().__init__()
        self.step, self.history, self.seed = step, history, seed

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Only rows of ``dataset`` come back. History strictly before a series' first new row is put ahead of it."""
        s = self.step
        names = list(s.channels)
        columns = dataset.columns
        starts = dataset.groupBy(*s.by).agg(F.min(s.index).alias("_first"))
        old = self.history.join(starts, s.by) if s.by else self.history.crossJoin(F.broadcast(starts))
        old = old.where(F.col(s.index) < F.col("_first")).drop("_first")
        if s.carry_over == "cold":
            old = old.where("false")
        elif s.carry_over == "auto":
            going = carry_class(self.history, dataset, s.index, s.by).where(F.col("carry").isin("overlap", "contiguous")).drop("carry")
            old = old.join(going, s.by, "left_semi") if s.by else (old if going.count() else old.where("false"))
        if not any(k.recursive for k in s.channels.values()):
            reach = int(max(k.lags for k in s.channels.values()))
            old = old.withColumn("_back", F.row_number().over(Window.partitionBy(*s.by).orderBy(F.desc(s.index)))).where(F.col("_back") < reach).drop("_back")
        rows = dataset.withColumn("_new", F.lit(True)).unionByName(old.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        made = adstock(rows, {f"{s.prefix}{c}" if s.prefix else f"_new_{c}": (c, k) for c, k in s.channels.items()}, s.index, s.by, state=self.seed, missing_state="cold").where("_new").drop("_new")
        if not s.prefix:
            return made.drop(*names).withColumnsRenamed({f"_new_{c}": c for c in names}).select(columns)
        return made if s.keep_original else made.drop(*names)


def adstock_channels(channels: dict[str, Adstock], index: str, by: Sequence[str] = (), **options) -> Pipeline:
    """One step for each channel."""
    return Pipeline(stages=[AdstockStep({c: k}, index, by, **options) for c, k in channels.items()])


def reference_levels(df: DataFrame, columns: Sequence[str], level: str = "max", by: Sequence[str] = ()) -> DataFrame:
    """(by..., <column>...): max, mean or type-7 quantile (q99, q95) of each column's finite values."""

    def of(c: str):
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
        if level in ("q99", "q95"):
            return F.percentile(x, F.lit(float(level[1:]) / 100))
        return {"max": F.max, "mean": F.avg}[level](x)

    if level not in ("max", "mean", "q99", "q95"):
        raise ValueError("level is max, mean, q99 or q95")
    return df.groupBy(*by).agg(*[of(c).alias(c) for c in columns])


@dataclass
class Curve:
    """half_max is a share of the reference level."""

    type: str = "hill"
    half_max: float = 0.5
    shape: float = 1.0
    exponent: float = 0.5
    extra: dict = field(default_factory=dict)

    def column(self, x, reference):
        share = F.try_divide(F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0)), reference)
        if self.type == "hill":
            return saturate(share, "hill", half_max=self.half_max, shape=self.shape)
        if self.type == "michaelis_menten":
            return saturate(share, "michaelis_menten", km=self.half_max)
        if self.type == "exponential":
            return saturate(share, "exponential", rate=math.log(2) / self.half_max)
        if self.type == "power":
            return saturate(share, "power", exponent=self.exponent)
        raise ValueError(f"unknown curve {self.type!r}")


class SaturationStep(Estimator):
    """Learns each column's reference level, per group if ``by`` is given; unseen groups use the pooled level."""

    def __init__(self, curves: dict[str, Curve], by: Sequence[str] = (), level: str = "max", prefix: str = ""):
        super().__init__()
        self.curves, self.by, self.level, self.prefix = dict(curves), list(by), level, prefix

    def _fit(self, dataset: DataFrame) -> SaturationModel:
        require_columns(dataset, self.by, "the training table", numeric=list(self.curves))
        pooled = reference_levels(dataset, list(self.curves), self.level).first().asDict()
        if not all(v and v > 0 for v in pooled.values()):
            raise ValueError("a reference level is not positive")
        groups = reference_levels(dataset, list(self.curves), self.level, self.by) if self.by else None
        return SaturationModel(self, pooled, groups)

    def tunable(self) -> dict[str, tuple]:
        return {f"{c}.{p}": RANGES[r] for c, curve in self.curves.items() for p, r in CURVE_RANGES[curve.type].items()}


class SaturationModel(Model):
    def __init__(self, step: SaturationStep, pooled: dict[str, float], groups: DataFrame | None):
        super().__init__()
        self.step, self.pooled, self.groups = step, pooled, groups

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s, rows = self.step, dataset
        if self.groups is not None:
            rows = rows.join(self.groups.withColumnsRenamed({c: f"_ref_{c}" for c in s.curves}), s.by, "left")
        for c, curve in s.curves.items():
            own = F.col(f"_ref_{c}") if self.groups is not None else F.lit(None).cast("double")
            reference = F.when(own > 0, own).otherwise(F.lit(float(self.pooled[c])))
            rows = rows.withColumn(s.prefix + c, curve.column(F.col(c), reference))
        kept = dataset.columns + [s.prefix + c for c in s.curves if s.prefix]
        return rows.select(kept)
