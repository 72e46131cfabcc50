"""Import of another modelling tool's hyper-parameters as carryover and saturation settings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrail.operators.adstock import Adstock, ChannelSpec, Saturation, adstock


def from_theta_alpha_gamma(
    df: DataFrame, x: str, order_by: str, kind: str = "geometric", theta: float | None = None, shape: float | None = None, scale: float | None = None, alpha: float = 1.0, gamma: float = 0.5, window=None, inflexion: str = "max",
) -> ChannelSpec:
    """theta: geometric decay; shape and scale: a Weibull (cdf) kernel whose scale is the ``scale`` quantile of 1..n, rounded half
    to even. Its density kernel is refused: that tool stretches it from 0 to 1, which no kernel here does. alpha is the curve's shape; its half_max is gamma of the largest carried-over value within the ``window`` condition,
    or, with inflexion range, that share of the way from the smallest to the largest.
    """
    n = df.count()
    if kind == "geometric":
        kernel = Adstock("geometric", theta, normalise=False)
    elif kind == "weibull_cdf":
        kernel = Adstock("weibull", max_lag=n, shape=shape, scale=float(round(float(np.quantile(np.arange(1, n + 1), scale)))), normalise=False)
    else:
        raise ValueError("kind is geometric or weibull_cdf; give other kernels as the weights of a filter")
    made = adstock(df, {"_a": (x, kernel)}, order_by)
    ends = (made.where(window) if window is not None else made).agg(F.min("_a").alias("low"), F.max("_a").alias("high")).first()
    half = gamma * ends["high"] if inflexion == "max" else (1 - gamma) * ends["low"] + gamma * ends["high"]
    return ChannelSpec(kernel, Saturation("hill", {"half_max": float(half), "shape": float(alpha)}))
