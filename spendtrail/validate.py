"""Checks of arguments when a plan is built: columns, numbers and flags, with errors that name what is wrong."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "the table", numeric: Sequence[str] = ()) -> None:
    """Raises unless ``df`` has all of ``columns`` and ``numeric``, each once, and the latter hold numbers or flags."""
    asked = list(dict.fromkeys([*columns, *numeric]))
    if lacking := [c for c in asked if c not in df.columns]:
        raise ValueError(f"{what} lacks the columns {', '.join(lacking)}; it has {', '.join(df.columns)}")
    if twice := [c for c in asked if df.columns.count(c) > 1]:
        raise ValueError(f"{what} has more than one column named {', '.join(twice)}")
    if other := [f"{c} ({df.schema[c].dataType.simpleString()})" for c in dict.fromkeys(numeric) if not isinstance(df.schema[c].dataType, T.NumericType | T.BooleanType)]:
        raise ValueError(f"columns of {what} must be numeric: {', '.join(other)}")


def require_distinct(names: Sequence[str], what: str) -> None:
    if twice := sorted({n for n in names if list(names).count(n) > 1}):
        raise ValueError(f"{what} name these more than once: {', '.join(twice)}")


def require_number(value: float, name: str, low: float = -math.inf, high: float = math.inf, whole: bool = False) -> None:
    """Raises unless ``value`` is a finite number within bounds, and a whole one where asked."""
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number, not {value!r}")
    if whole and value != int(value):
        raise ValueError(f"{name} must be a whole number, not {value!r}")
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low:g} to {high:g}, not {value:g}")
