"""Carryover filters over ordered series, their states, and chained saturation.

A series is the rows of one combination of the ``by`` columns in the order of ``order_by``. Recursions and short finite kernels
are window expressions; long finite ones run once per series for all channels together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtrail.functions.decay import check_decay, delayed_weights, effective_window, geometric_total, geometric_weights, weibull_weights
from spendtrail.functions.saturation import saturate
from spendtrail.validate import require_columns

WINDOWED = 64  # kernels up to so many lags become window expressions


@dataclass(frozen=True)
class Adstock:
    """kind: none, geometric (decay, max_lag), weibull (shape, scale, type, max_lag), delayed (decay, peak, max_lag) or filter
    (weights). A geometric kernel without max_lag is the recursion a = x + decay * before."""

    kind: str = "none"
    decay: float = 0.0
    max_lag: float = math.inf
    shape: float = 1.0
    scale: float = 1.0
    peak: float = 0.0
    type: str = "cdf"
    weights: tuple[float, ...] = ()
    normalise: bool = True

    def __post_init__(self):
        if self.kind not in ("none", "geometric", "weibull", "delayed", "filter"):
            raise ValueError(f"unknown kernel {self.kind!r}")
        if self.kind in ("geometric", "delayed"):
            check_decay(self.decay, allow_one=not math.isinf(self.max_lag))
        if self.kind in ("weibull", "delayed") and math.isinf(self.max_lag):
            raise ValueError(f"a {self.kind} kernel needs max_lag")
        if not self.max_lag >= 1:
            raise ValueError("max_lag must be at least 1")
        if self.kind == "filter" and not self.weights:
            raise ValueError("a filter needs weights")

    @property
    def recursive(self) -> bool:
        return self.kind == "geometric" and math.isinf(self.max_lag)

    @property
    def lags(self) -> float:
        return len(self.weights) if self.kind == "filter" else 1 if self.kind == "none" else self.max_lag

    def kernel(self, reach: int) -> np.ndarray:
        """Weights of the lags that a series of ``reach`` rows has."""
        if self.kind == "none":
            return np.ones(1)
        if self.kind == "geometric":
            return geometric_weights(int(min(self.max_lag, 2**31)), self.decay, self.normalise, reach)
        if self.kind == "filter":
            return np.array(self.weights[:reach], float)
        whole = weibull_weights(int(self.max_lag), self.shape, self.scale, self.type, self.normalise) if self.kind == "weibull" else delayed_weights(int(self.max_lag), self.decay, self.peak, self.normalise)
        return whole[:reach]

    def run(self, x: np.ndarray, before: np.ndarray | float | None = None) -> np.ndarray:
        """Filtered values; ``before`` is the raw accumulator of a recursion, or the raw values ahead of a finite kernel."""
        n = len(x)
        if self.recursive:
            start = float(before) if before is not None else 0.0
            raw = np.fromiter(accumulate(x.tolist(), lambda a, v: v + self.decay * a, initial=start), float, n + 1)[1:]
            return raw * (1 - self.decay) if self.normalise else raw
        head = np.array([] if before is None else before, float)
        values = np.concatenate((head, x))
        w = self.kernel(max(1, len(values)))
        return np.convolve(values, w)[len(head) : len(values)]


@dataclass(frozen=True)
class Saturation:
    type: str = "none"
    parameters: dict = field(default_factory=dict)

    def column(self, x: Column) -> Column:
        return saturate(x, self.type, **self.parameters)


@dataclass(frozen=True)
class ChannelSpec:
    """How a channel's spend becomes its effect; ``saturate_first`` turns the usual order round."""

    adstock: Adstock = Adstock()
    saturation: Saturation = Saturation()
    saturate_first: bool = False


def _cleaned(x: Column, na_action: str) -> Column:
    x = x.cast("double")
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("media values must be finite")).cast("double")).otherwise(x)
    if na_action == "zero":
        return F.coalesce(x, F.lit(0.0))
    if na_action == "keep":
        return x
    if na_action != "error":
        raise ValueError("na_action is error, zero or keep")
    return F.when(x.isNull(), F.raise_error(F.lit("media values are missing")).cast("double")).otherwise(x)


def fir(x: Column, weights: Sequence[float], window, place: Column | None = None, tail: str | None = None) -> Column:
    """Sum of weighted lags; lags before the first row are 0, or with a ``tail`` its values, the oldest first. ``place``: the
    row's number in its series, from 1."""
    total = None
    for lag, w in enumerate(weights):
        if w:
            before = F.lit(0.0)
            if tail and lag:
                at = place - lag - 1  # from the tail's end
                before = F.when((at < 0) & (-at <= F.size(tail)), F.try_element_at(tail, at)).otherwise(F.lit(0.0))
            term = F.lit(float(w)) * (x if lag == 0 else F.coalesce(F.lag(x, lag).over(window), before, F.lit(0.0)))
            total = term if total is None else total + term
    return F.lit(0.0) if total is None else total


def with_state(df: DataFrame, state: DataFrame, by: Sequence[str], missing_state: str, prefix: str) -> DataFrame:
    """``df`` with the columns of ``state``, prefixed. A series without a state is refused, or starts cold."""
    if missing_state not in ("error", "cold"):
        raise ValueError("missing_state is error or cold")
    found = f"{prefix}found"
    renamed = state.select(*by, *[F.col(c).alias(f"{prefix}{c}") for c in state.columns if c not in by], F.lit(True).alias(found))
    joined = df.join(renamed, list(by), "left") if by else df.crossJoin(F.broadcast(renamed.limit(1)))
    if missing_state == "cold":
        return joined.drop(found)
    name = F.concat_ws(" / ", *[F.col(c).cast("string") for c in by]) if by else F.lit("")
    refused = F.raise_error(F.concat(F.lit("state lacks the series "), name, F.lit('; missing_state="cold" starts such series cold')))
    # the refusal is part of every column of the state, so that no plan can leave it out
    return joined.withColumns({c: F.when(F.col(found).isNull(), refused.cast(joined.schema[c].dataType)).otherwise(F.col(c)) for c in joined.columns if c.startswith(prefix) and c != found}).drop(found)


def recursion(df: DataFrame, values: dict[str, tuple[str, float]], keys: Sequence[str], place: str) -> DataFrame:
    """``df`` with a column for each entry of ``values``, new name -> (column, decay): a = x + decay * before, from 0.

    ``place`` numbers a series' rows from 0. Powers of the decay would leave the range of numbers in one running sum, so sums run
    within blocks of rows, cut in two ways: each row takes the block in whose second half it is. What lies before that block
    would have had a weight under 1e-120. Nothing but window sums: one exchange by ``keys``.
    """
    for out, (name, decay) in values.items():
        x = F.coalesce(F.col(name), F.lit(0.0))
        if decay == 0:
            df = df.withColumn(out, x)
            continue
        half = max(1, int(125 / -math.log10(decay)))
        made = []
        for i, shift in enumerate((0, half)):
            at, block = (F.col(place) + shift) % (2 * half), f"_block{i}"
            df = df.withColumn(block, F.floor((F.col(place) + shift) / (2 * half)))
            run = Window.partitionBy(*keys, block).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
            made.append(F.sum(x * F.pow(F.lit(1 / decay), at)).over(run) * F.pow(F.lit(decay), at))
        first = (F.col(place) < half) | (F.col(place) % (2 * half) >= half)
        df = df.withColumn(out, F.when(first, made[0]).otherwise(made[1])).drop("_block0", "_block1")
    return df


def adstock(
    df: DataFrame,
    filters: dict[str, tuple[str, Adstock]],
    order_by: str | Sequence[str],
    by: Sequence[str] = (),
    state: DataFrame | None = None,
    na_action: str = "error",
    missing_state: str = "error",
    chunk_rows: int | None = None,
) -> DataFrame:
    """``df`` with a column for each entry of ``filters``: new name -> (column, kernel).

    ``state`` (by..., and for each filtered column ``<column>_acc`` or ``<column>_tail``) continues series; one that it lacks is
    refused, or with ``missing_state`` cold starts at nothing. A series with two rows of one time, or one without a time, is
    refused. Recursions and kernels of up to 64 lags are window sums over one exchange by series; longer kernels run once per
    series. With ``chunk_rows`` a recursion's series longer than that are cut by time into chunks of about so many rows, filtered
    side by side; a chunk's row count and last value give the next one's start.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    require_columns(df, [*by, *order], numeric=[name for name, _ in filters.values()])
    kernels = {out: (name, k) for out, (name, k) in filters.items() if k.kind != "none"}
    plain = df.withColumns({out: _cleaned(F.col(name), na_action) for out, (name, k) in filters.items() if k.kind == "none"})
    if not kernels:
        return plain
    keep = plain.columns
    short = {out: k for out, (_, k) in kernels.items() if not k.recursive and k.lags <= WINDOWED}
    endless = {out: k for out, (_, k) in kernels.items() if k.recursive}
    rows = plain.withColumns({f"_in_{out}": _cleaned(F.col(name), na_action) for out, (name, _) in kernels.items()})
    if state is not None:
        rows = with_state(rows, state, by, missing_state, "_state_")
    held = lambda out, suffix: f"_state_{kernels[out][0]}_{suffix}" if f"_state_{kernels[out][0]}_{suffix}" in rows.columns else None

    keys = list(by)
    if chunk_rows and endless:
        rows, keys = rows.withColumn("_chunk", time_chunk(rows, order[0], by, chunk_rows)), [*by, "_chunk"]
    series, ordered = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*keys).orderBy(*order)
    time = F.struct(*order)
    wrong = F.when((time == F.lag(time).over(ordered)) | F.greatest(*[F.col(c).isNull().cast("int") for c in order], F.lit(0)).cast("boolean"), F.raise_error(F.lit("a series has two rows of one time, or one without")).cast("int"))
    rows = rows.withColumn("_at", F.row_number().over(ordered) - 1 + F.coalesce(wrong, F.lit(0))).where("_at >= 0")  # always so; the filter keeps the check
    rows = recursion(rows, {f"_raw_{out}": (f"_in_{out}", k.decay) for out, k in endless.items()}, keys, "_at")
    starts = {out: F.coalesce(F.col(held(out, "acc")), F.lit(0.0)) if held(out, "acc") else None for out in endless}
    if "_chunk" in keys:
        rows = rows.join(chunk_starts(rows, endless, starts, by), keys)
        starts = {out: F.col(f"_start_{out}") for out in endless}
    made = {}
    for out, k in endless.items():
        raw = F.col(f"_raw_{out}") if starts[out] is None else F.col(f"_raw_{out}") + starts[out] * F.pow(F.lit(float(k.decay)), F.col("_at") + 1)
        made[out] = raw * (1 - k.decay) if k.normalise else raw
    for out, k in short.items():
        made[out] = fir(F.coalesce(F.col(f"_in_{out}"), F.lit(0.0)), k.kernel(int(k.lags)), series, F.row_number().over(series), held(out, "tail"))
    if made:
        rows = rows.withColumns({out: F.when(F.col(f"_in_{out}").isNotNull(), x) if na_action == "keep" else x for out, x in made.items()})
    rest = {out: k for out, (_, k) in kernels.items() if out not in made}
    if not rest:
        return rows.select(*keep, *kernels)
    return _by_series(rows, rest, {out: held(out, "tail") for out in rest}, order, by, [*keep, *made]).select(*keep, *kernels)


def _by_series(rows: DataFrame, kernels: dict[str, Adstock], tails: dict[str, str | None], order: Sequence[str], by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long finite kernels: every series is one task's, for all of them together."""
    schema = T.StructType([*[rows.schema[c] for c in keep], *[T.StructField(out, T.DoubleType()) for out in kernels]])
    names = schema.fieldNames()

    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values(list(order), kind="stable")
        for out, k in kernels.items():
            before = series[tails[out]].iloc[0] if tails[out] and len(series) else None
            x = series[f"_in_{out}"].to_numpy(float)
            gaps = np.isnan(x)
            series[out] = np.where(gaps, np.nan, k.run(np.where(gaps, 0, x), before)) if gaps.any() else k.run(x, before)
        return series[names]

    return rows.groupBy(*by).applyInPandas(run, schema)


def time_chunk(df: DataFrame, time: str, by: Sequence[str], chunk_rows: int) -> Column:
    """The number of the stretch of time that a row is in: stretches hold about ``chunk_rows`` rows of the longest series."""
    kind = df.schema[time].dataType.typeName()
    number = F.unix_micros(F.col(time).cast("timestamp")).cast("double") if kind in ("date", "timestamp", "timestamp_ntz") else F.col(time).cast("double")
    longest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    chunks = -(-longest // chunk_rows)
    if chunks < 2:
        return F.lit(0)
    edges = sorted(set(df.agg(F.percentile_approx(number, [i / chunks for i in range(1, chunks)], 100 * chunks)).first()[0]))
    return F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda n, e: n + (number > e).cast("int"))


def chunk_starts(rows: DataFrame, kernels: dict[str, Adstock], starts: dict[str, Column | None], by: Sequence[str]) -> DataFrame:
    """(by..., _chunk, _start_<out>...): the raw accumulators before each chunk, composed from a row a chunk."""
    first = {out: (F.lit(0.0) if starts[out] is None else F.first(starts[out])).alias(f"_first_{out}") for out in kernels}
    ends = rows.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"), *[F.max_by(f"_raw_{out}", "_at").alias(f"_end_{out}") for out in kernels], *first.values())
    schema = T.StructType([*[rows.schema[c] for c in (*by, "_chunk")], *[T.StructField(f"_start_{out}", T.DoubleType()) for out in kernels]])

    def run(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("_chunk")
        for out, k in kernels.items():
            carry, before = float(chunks[f"_first_{out}"].iloc[0]), []
            for n, end in zip(chunks["_n"].tolist(), chunks[f"_end_{out}"].tolist(), strict=True):
                before.append(carry)
                carry = end + k.decay**n * carry
            chunks[f"_start_{out}"] = before
        return chunks[schema.fieldNames()]

    return ends.groupBy(*by).applyInPandas(run, schema)


def adstock_state(df: DataFrame, columns: dict[str, Adstock], order_by: str | Sequence[str], by: Sequence[str] = (), state: DataFrame | None = None, missing_state: str = "error") -> DataFrame:
    """(by..., <column>_acc or <column>_tail...): what continues each series after its last row.

    A recursion's state is its raw accumulator, a finite kernel's the last max_lag - 1 raw values, oldest first (with zeros,
    or the values of ``state``, ahead of short series). Weights of the accumulator are at most 1, so it is one aggregate.
    ``missing_state`` as in ``adstock``.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    back = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    rows = df.withColumn("_back", F.row_number().over(back) - 1)
    sums = [F.count("*").alias("_n")]
    for name, k in columns.items():
        if k.recursive:
            sums.append(F.sum(F.col(name) * F.pow(F.lit(k.decay), F.col("_back"))).alias(f"{name}_acc"))
        else:
            last = F.when(F.col("_back") < k.lags - 1, F.struct((-F.col("_back")).alias("at"), F.col(name).cast("double").alias("x")))
            sums.append(F.transform(F.sort_array(F.collect_list(last)), lambda s: s.x).alias(f"{name}_tail"))
    out = rows.groupBy(*by).agg(*sums)
    if state is not None:
        out = with_state(out, state, by, missing_state, "_old_")
    for name, k in columns.items():
        if k.recursive and state is not None:
            out = out.withColumn(f"{name}_acc", F.col(f"{name}_acc") + F.coalesce(f"_old_{name}_acc", F.lit(0.0)) * F.pow(F.lit(k.decay), F.col("_n")))
        elif not k.recursive:
            need = int(k.lags - 1)
            head = F.array_repeat(F.lit(0.0), need)
            if state is not None:
                head = F.concat(head, F.coalesce(f"_old_{name}_tail", F.array().cast("array<double>")))
            whole = F.concat(head, F.col(f"{name}_tail"))
            out = out.withColumn(f"{name}_tail", F.slice(whole, F.size(whole) - need + 1, F.lit(need)) if need else F.array().cast("array<double>"))
    return out.select(*by, *[f"{name}_{'acc' if k.recursive else 'tail'}" for name, k in columns.items()])


def adstock_steady_state(df: DataFrame, column: str, kernel: Adstock, order_by: str | Sequence[str], by: Sequence[str] = (), periods: int | None = None) -> DataFrame:
    """The state of a series that has always run at the mean of its first ``periods`` rows (by default 90% of the kernel)."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    if periods is None:
        periods = effective_window(kernel.decay) if kernel.kind == "geometric" and kernel.decay < 1 else int(kernel.lags)
        periods = int(min(periods, kernel.lags))
    rows = df.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_at") <= periods)
    mean = rows.groupBy(*by).agg(F.avg(column).alias("_m"))
    if kernel.recursive:
        return mean.select(*by, (F.col("_m") / (1 - kernel.decay)).alias(f"{column}_acc"))
    return mean.select(*by, F.array_repeat("_m", int(kernel.lags - 1)).alias(f"{column}_tail"))


def carried_by_lag(df: DataFrame, column: str, kernel: Adstock, order_by: str | Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., lag, weight, carried): how much of a finite kernel's effect falls that many rows after the spend, within each series.

    What would fall after a series' last row is not in it, so the sum over lags is the filtered column's.
    """
    if kernel.recursive:
        raise ValueError("carried_by_lag is for kernels with max_lag")
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    require_columns(df, [*by, *order], numeric=[column])
    weights = kernel.kernel(int(kernel.lags)).tolist()
    left = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])) - 1
    rows = df.select(*by, _cleaned(F.col(column), "zero").alias("_x"), left.alias("_left"))
    lags = rows.select(*by, "_x", F.explode(F.sequence(F.lit(0), F.least(F.col("_left"), F.lit(len(weights) - 1)))).alias("lag"))
    sums = lags.groupBy(*by, "lag").agg(F.sum("_x").alias("_x"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("lag") + 1)
    return sums.select(*by, "lag", weight.alias("weight"), (weight * F.col("_x")).alias("carried"))


def media_transform(df: DataFrame, specs: dict[str, tuple[str, ChannelSpec]], order_by, by: Sequence[str] = (), na_action: str = "error") -> DataFrame:
    """``df`` with new columns: new name -> (column, spec), carried over and saturated in the spec's order."""
    early = {out: name for out, (name, s) in specs.items() if s.saturate_first}
    df = df.withColumns({f"_sat_{out}": specs[out][1].saturation.column(F.col(name).cast("double")) for out, name in early.items()}) if early else df
    made = adstock(df, {out: (f"_sat_{out}" if out in early else name, s.adstock) for out, (name, s) in specs.items()}, order_by, by, na_action=na_action)
    late = {out: s.saturation.column(F.col(out)) for out, (_, s) in specs.items() if not s.saturate_first and s.saturation.type != "none"}
    return made.withColumns(late).drop(*[f"_sat_{out}" for out in early])


def adstock_weights_total(kernel: Adstock) -> float:
    """Long-run multiplier of the kernel."""
    if kernel.kind == "geometric" and not kernel.normalise:
        return geometric_total(kernel.decay, kernel.max_lag)
    return 1.0 if kernel.kind == "geometric" or kernel.kind == "none" else float(kernel.kernel(int(kernel.lags)).sum())
