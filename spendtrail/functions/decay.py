"""Decay vocabulary, for numbers and for columns, and carryover kernels, which are as long as a lag window."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def check_decay(decay: float, allow_one: bool = False) -> float:
    if not (0 <= decay < 1 or (allow_one and decay == 1)):
        raise ValueError(f"decay must be in [0, 1{']' if allow_one else ')'}, not {decay!r}")
    return float(decay)


def decay_from_half_life(half_life: float, period: float = 1) -> float:
    """The per-period decay that halves what is left every ``half_life``."""
    if not half_life > 0 or not period > 0:
        raise ValueError("half_life and period must be positive")
    return 0.5 ** (period / half_life)


def half_life(decay: float, period: float = 1) -> float:
    if not 0 < decay < 1:
        raise ValueError("decay must be strictly between 0 and 1")
    return period * math.log(0.5) / math.log(decay)


def effective_window(decay: float, coverage: float = 0.9) -> int:
    """The fewest periods that hold ``coverage`` of a geometric kernel's weight."""
    check_decay(decay)
    if not 0 < coverage < 1:
        raise ValueError("coverage must be strictly between 0 and 1")
    if decay == 0:
        return 1
    n = math.ceil(math.log1p(-coverage) / math.log(decay))
    if n > 1 and decay ** (n - 1) <= (1 - coverage) * (1 + 1e-10):
        n -= 1
    if n > 2**31 - 1:
        raise ValueError("the window is longer than any series")
    return max(1, n)


def decay_column(half_life: Column, period: float = 1) -> Column:
    """``decay_from_half_life`` of a column; a half-life that isn't positive is refused when it is run."""
    wrong = F.raise_error(F.lit("half_life must be positive")).cast("double")
    return F.when(half_life <= 0, wrong).otherwise(F.pow(F.lit(0.5), F.lit(float(period)) / half_life))


def half_life_column(decay: Column, period: float = 1) -> Column:
    wrong = F.raise_error(F.lit("decay must be strictly between 0 and 1")).cast("double")
    return F.when((decay <= 0) | (decay >= 1), wrong).otherwise(F.lit(period * math.log(0.5)) / F.log(decay))


def effective_window_column(decay: Column, coverage: float = 0.9) -> Column:
    """``effective_window`` of a column of decays from 0 to less than 1."""
    if not 0 < coverage < 1:
        raise ValueError("coverage must be strictly between 0 and 1")
    wrong = F.raise_error(F.lit("decay must be in [0, 1)")).cast("long")
    n = F.ceil(F.lit(math.log1p(-coverage)) / F.log(decay))
    n = F.when((n > 1) & (F.pow(decay, n - 1) <= (1 - coverage) * (1 + 1e-10)), n - 1).otherwise(n)
    return F.when((decay < 0) | (decay >= 1), wrong).when(decay == 0, 1).otherwise(F.greatest(n, F.lit(1)))


def geometric_total(decay: float, max_lag: float) -> float:
    """Sum of the kernel decay**i, i < max_lag, in closed form."""
    if decay == 1:
        return float(max_lag)
    if math.isinf(max_lag) or decay == 0:
        return 1 / (1 - decay)
    return -math.expm1(max_lag * math.log(decay)) / (1 - decay)


def geometric_weights(max_lag: int, decay: float, normalise: bool = False, reach: int | None = None) -> np.ndarray:
    """decay**i for the lags a series can reach; normalised by the sum over the full ``max_lag``."""
    w = np.power(float(decay), np.arange(min(max_lag, reach or max_lag)))
    return w / geometric_total(decay, max_lag) if normalise else w


def weibull_weights(max_lag: int, shape: float, scale: float, kind: str = "cdf", normalise: bool = False) -> np.ndarray:
    """cdf: running product of survival probabilities; pdf: density at lags 1, 2, ... Non-finite values count as 0."""
    if not (shape > 0 and scale > 0 and max_lag >= 1) or kind not in ("cdf", "pdf"):
        raise ValueError("shape and scale must be positive, max_lag at least 1 and kind cdf or pdf")
    t = np.arange(1, max_lag + 1, dtype=float) / scale
    with np.errstate(all="ignore"):
        if kind == "cdf":
            w = np.concatenate(([1.0], np.cumprod(np.exp(-(t[:-1] ** shape)))))
        else:
            w = shape / scale * t ** (shape - 1) * np.exp(-(t**shape))
    w = np.where(np.isfinite(w), w, 0.0)
    if not w.any():
        raise ValueError("every weight of this kernel is zero")
    if normalise:
        return w / w.sum()
    return w if kind == "cdf" else w / w.max()


def delayed_weights(max_lag: int, decay: float, peak: float, normalise: bool = False) -> np.ndarray:
    """decay**((lag - peak)**2)."""
    check_decay(decay)
    w = np.power(float(decay), (np.arange(max_lag) - peak) ** 2)
    if not w.any():
        raise ValueError("every weight of this kernel is zero")
    return w / w.sum() if normalise else w
