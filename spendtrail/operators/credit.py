"""Rule-based and custom credit of conversions to touches, as window expressions over journeys."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtrail.functions.decay import decay_from_half_life
from spendtrail.operators.journeys import Journeys

RULES = ("linear", "first", "last", "position", "time_decay")


def _frame(paths: Journeys | DataFrame) -> DataFrame:
    return paths.df if isinstance(paths, Journeys) else paths


def rule_weight(rule: str, first_weight: float = 0.4, last_weight: float = 0.4, decay: float | None = None, period: float = 1) -> Column:
    """The touch's weight by the rule, before null journeys are set to zero; weights of a journey sum to 1."""
    n, rank = F.col("touch_n"), F.col("touch_rank")
    journey = Window.partitionBy("path_id")
    if rule == "linear":
        return F.lit(1.0) / n
    if rule in ("first", "last"):
        return F.when(rank == (1 if rule == "first" else n), 1.0).otherwise(0.0)
    if rule == "position":
        if not (0 <= first_weight <= 1 and 0 <= last_weight <= 1 and first_weight + last_weight <= 1):
            raise ValueError("first_weight and last_weight are shares that sum to at most 1")
        middle = 1 - first_weight - last_weight
        two = F.when(rank == 1, first_weight + middle / 2).otherwise(last_weight + middle / 2)
        inner = F.try_divide(F.lit(middle), (n - 2).cast("double"))
        raw = F.when(n == 1, 1.0).when(n == 2, two).otherwise(F.when(rank == 1, first_weight).when(rank == n, last_weight).otherwise(inner))
        total = F.sum(raw).over(journey)
        return F.when(total > 0, raw / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    if rule != "time_decay":
        raise ValueError(f"unknown rule {rule!r}: one of {', '.join(RULES)}")
    decay = decay_from_half_life(7) if decay is None else decay
    if not 0 <= decay < 1 or not period > 0:
        raise ValueError("decay must be in [0, 1) and period positive")
    recency = F.col("time_to_conversion")
    unknown = F.max(F.when(recency.isNull(), 1).otherwise(0)).over(journey) == 1
    if decay == 0:
        latest = (recency == F.min(recency).over(journey)).cast("double")
        weight = latest / F.sum(latest).over(journey)
    else:
        log_weight = recency / period * math.log(decay)
        e = F.exp(log_weight - F.max(log_weight).over(journey))
        weight = e / F.sum(e).over(journey)
    return F.when(unknown, F.lit(1.0) / n).otherwise(weight)


def _scored(df: DataFrame, weight: Column) -> DataFrame:
    credit = F.when(F.col("converted"), weight).otherwise(0.0)
    return df.withColumn("credit", credit).withColumn("credit_value", F.col("credit") * F.coalesce("conversion_value", F.lit(0.0)))


def credit(paths: Journeys | DataFrame, rule: str, **parameters) -> DataFrame:
    """``paths`` with credit (sums to 1 in converting journeys, 0 in others) and credit_value."""
    return _scored(_frame(paths), rule_weight(rule, **parameters))


def credit_linear(paths):
    return credit(paths, "linear")


def credit_first(paths):
    return credit(paths, "first")


def credit_last(paths):
    return credit(paths, "last")


def credit_position(paths, first_weight: float = 0.4, last_weight: float = 0.4):
    return credit(paths, "position", first_weight=first_weight, last_weight=last_weight)


def credit_time_decay(paths, decay: float | None = None, period: float = 1):
    return credit(paths, "time_decay", decay=decay, period=period)


def credit_custom(paths: Journeys | DataFrame, fn: Callable, normalise: bool = True) -> DataFrame:
    """Credit by ``fn``: either a Column made from columns (rank, n, recency), or a function of their arrays in a journey.

    The function is called once for each converting journey, in rank order; weights must be finite, not negative and as
    many as touches. ``normalise`` scales them to sum to 1; a journey of weights that are all zero gets no credit.
    """
    df = _frame(paths)
    try:
        made = fn(F.col("touch_rank"), F.col("touch_n"), F.col("time_to_conversion"))
    except Exception:  # a function of arrays need not take columns
        made = None
    if isinstance(made, Column):
        made = F.when(made.isNull() | F.isnan(made) | (made < 0), F.raise_error(F.lit("weights must be finite and not negative")).cast("double")).otherwise(made.cast("double"))
        if normalise:
            total = F.sum(made).over(Window.partitionBy("path_id"))
            made = F.coalesce(F.try_divide(made, total), F.lit(0.0))
        return _scored(df, made)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_journeys(batches):
            begins = journey_begins(table["path_id"])
            ends = np.append(begins[1:], len(table))
            rank, n, recency, value = (table[c].to_numpy().copy() for c in ("touch_rank", "touch_n", "time_to_conversion", "conversion_value"))
            converted = table["converted"].cast(pa.bool_()).fill_null(False).to_numpy()[begins]
            weights = np.zeros(len(table))
            for begin, end in zip(begins[converted].tolist(), ends[converted].tolist(), strict=True):
                made = np.asarray(fn(rank[begin:end], n[begin:end], recency[begin:end]), float)
                if made.shape != (end - begin,):
                    raise ValueError("weights must be finite, not negative and one for each touch")
                weights[begin:end] = made
            if not np.isfinite(weights).all() or (weights < 0).any():
                raise ValueError("weights must be finite, not negative and one for each touch")
            if normalise:
                total = np.add.reduceat(weights, begins)
                weights = weights / np.repeat(np.where(total > 0, total, 1.0), ends - begins)
            value = value.astype(float)
            values = weights * np.where(np.isnan(value), 0.0, value)
            yield from table.append_column("credit", pa.array(weights)).append_column("credit_value", pa.array(values)).to_batches()

    schema = T.StructType([*df.schema.fields, T.StructField("credit", T.DoubleType()), T.StructField("credit_value", T.DoubleType())])
    return df.repartition("path_id").sortWithinPartitions("path_id", "touch_rank").mapInArrow(score, schema)


def journey_begins(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Where a journey begins in sorted path ids; missing ones are one journey."""
    here, before = ids.slice(1), ids.slice(0, len(ids) - 1)
    other = pc.coalesce(pc.not_equal(here, before), pc.xor(pc.is_null(here), pc.is_null(before)))
    return np.flatnonzero(np.append(True, np.asarray(other)))


def whole_journeys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole journeys from a sorted partition's batches: the last journey of a batch waits for its other touches."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("path_id")
        last = int(journey_begins(ids)[-1])
        if held and not last and held[-1].column("path_id")[-1].equals(ids[0]):
            held.append(batch)
            continue
        if held or last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)
