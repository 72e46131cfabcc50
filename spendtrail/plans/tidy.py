"""Result objects as plain tables."""

from __future__ import annotations

from functools import singledispatch

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrail.operators.diagnose import Diagnosis
from spendtrail.operators.steps import AdstockModel, SaturationModel
from spendtrail.operators.tuning import Carryover, JointCarryover
from spendtrail.plans.media import Allocation


@singledispatch
def tidy(result) -> DataFrame | pd.DataFrame:
    """One flat table of a result: Spark's where it has a row for each row, channel or series of data, pandas' where it has one for
    each candidate or setting."""
    raise TypeError(f"nothing tidy is known of {type(result).__name__}")


@tidy.register
def _(result: Allocation) -> DataFrame:
    """The table, with what changes and the step of the search."""
    changes = {"spend_change": F.col("recommended_spend") - F.col("current_spend"), "response_change": F.col("recommended_response") - F.col("current_response")}
    return result.table.withColumns({**changes, "step": F.lit(float(result.step))})


@tidy.register
def _(result: Carryover) -> pd.DataFrame:
    """The candidates, the best and the one-standard-error pick marked."""
    is_ = lambda pick: (result.results["decay"] == pick.decay) & (result.results["max_lag"] == pick.max_lag)
    return result.results.assign(best=is_(result.best), best_1se=is_(result.best_1se))


@tidy.register
def _(result: JointCarryover) -> pd.DataFrame:
    return result.chart()


@tidy.register
def _(result: Diagnosis) -> DataFrame:
    """Variation, collinearity and the strongest correlation of each channel side by side."""
    out = result.variation.join(result.collinearity, "channel", "left")
    return out if result.correlations is None else out.join(result.correlations, "channel", "left")


@tidy.register
def _(result: AdstockModel) -> pd.DataFrame:
    """Each channel's kernel; parameters that a kernel hasn't are missing."""
    has = {"geometric": ("decay", "max_lag"), "weibull": ("shape", "scale", "max_lag"), "delayed": ("decay", "peak", "max_lag"), "filter": (), "none": ()}
    rows = [{"channel": c, "kind": k.kind, **{p: getattr(k, p) if p in has[k.kind] else None for p in ("decay", "max_lag", "shape", "scale", "peak")}} for c, k in result.step.channels.items()]
    return pd.DataFrame(rows)


@tidy.register
def _(result: SaturationModel) -> pd.DataFrame:
    """Each column's curve and pooled reference level."""
    return pd.DataFrame([{"column": c, "type": k.type, "half_max": k.half_max if k.type != "power" else None, "reference": result.pooled[c]} for c, k in result.step.curves.items()])
