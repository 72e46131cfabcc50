"""Saturation curves as column expressions; null stays null, negative input raises when it is evaluated."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CURVES = ("none", "hill", "exponential", "michaelis_menten", "power")


def _checked(x: Column) -> Column:
    return F.when(x < 0, F.raise_error(F.lit("saturation needs non-negative input")).cast("double")).otherwise(x)


def _positive(**named: float) -> None:
    for name, value in named.items():
        if not (value > 0 and math.isfinite(value)):
            raise ValueError(f"{name} must be positive and finite")


def saturate_hill(x: Column, half_max: float, shape: float = 1) -> Column:
    _positive(half_max=half_max, shape=shape)
    x = _checked(x)
    return F.when(x == 0, 0.0).otherwise(1 / (1 + F.pow(F.lit(float(half_max)) / F.nullif(x, F.lit(0.0)), F.lit(float(shape)))))


def saturate_exponential(x: Column, rate: float) -> Column:
    _positive(rate=rate)
    return -F.expm1(-rate * _checked(x))


def saturate_michaelis_menten(x: Column, km: float, vmax: float = 1) -> Column:
    _positive(km=km, vmax=vmax)
    x = _checked(x)
    return F.when(x == 0, 0.0).otherwise(vmax / (1 + F.lit(float(km)) / F.nullif(x, F.lit(0.0))))


def saturate_power(x: Column, exponent: float) -> Column:
    if not 0 < exponent <= 1:
        raise ValueError("exponent must be in (0, 1]")
    return F.pow(_checked(x), F.lit(float(exponent)))


def saturate(x: Column, type: str = "none", **parameters: float) -> Column:
    """Dispatch by name; ``none`` passes values on."""
    if type == "none":
        return x
    if type not in CURVES:
        raise ValueError(f"unknown curve {type!r}: one of {', '.join(CURVES)}")
    return {"hill": saturate_hill, "exponential": saturate_exponential, "michaelis_menten": saturate_michaelis_menten, "power": saturate_power}[type](x, **parameters)


def curve_value(x: float, type: str = "none", **p: float) -> float:
    """One value of a curve on the driver."""
    if x < 0:
        raise ValueError("saturation needs non-negative input")
    if type == "none":
        return x
    if type == "power":
        return x ** p["exponent"]
    if type == "exponential":
        return -math.expm1(-p["rate"] * x)
    if x == 0:
        return 0.0
    if type == "hill":
        return 1 / (1 + (p["half_max"] / x) ** p.get("shape", 1))
    return p.get("vmax", 1) / (1 + p["km"] / x)


def curve_scale(type: str, **p: float) -> float | None:
    """A spend level typical of the curve."""
    if type == "hill":
        return p["half_max"]
    if type == "michaelis_menten":
        return p["km"]
    return 1 / p["rate"] if type == "exponential" else None


def inverse_column(y: Column, type: str, **p: float) -> Column:
    """``curve_inverse`` of a column."""
    if type not in CURVES:
        raise ValueError(f"unknown curve {type!r}: one of {', '.join(CURVES)}")
    if type == "none":
        return F.greatest(y, F.lit(0.0))
    if type == "power":
        return F.when(y <= 0, 0.0).otherwise(F.pow(y, F.lit(1 / p["exponent"])))
    top = p.get("vmax", 1) if type == "michaelis_menten" else 1.0
    inside = F.when((y > 0) & (y < top), y)
    found = {
        "hill": lambda: p["half_max"] * F.pow(inside / (1 - inside), F.lit(1 / p.get("shape", 1))),
        "exponential": lambda: -F.log1p(-inside) / p["rate"],
        "michaelis_menten": lambda: p["km"] / (top / inside - 1),
    }[type]()
    return F.when(y <= 0, 0.0).when(y >= top, float("inf")).otherwise(found)


def curve_inverse(y: float, type: str, **p: float) -> float:
    """The spend at which the curve has the value ``y``; infinite where it never does."""
    if y <= 0:
        return 0.0
    if type == "none":
        return y
    if type == "power":
        return y ** (1 / p["exponent"])
    top = p.get("vmax", 1) if type == "michaelis_menten" else 1.0
    if y >= top:
        return math.inf
    if type == "hill":
        return p["half_max"] * (y / (1 - y)) ** (1 / p.get("shape", 1))
    if type == "exponential":
        return -math.log1p(-y) / p["rate"]
    return p["km"] / (top / y - 1)
