"""Attribution by several rules at once, per segment, with bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrail.operators.credit import RULES, _frame, rule_weight
from spendtrail.operators.markov import removal_effects, removal_with_touches, solve_chain, transition_counts
from spendtrail.validate import require_number

ALL_RULES = (*RULES, "markov")


def _rule_credits(df: DataFrame, rules: Sequence[str], first_weight, last_weight, decay, period) -> DataFrame:
    """``df`` with a column for each rule's credit: all windows share one exchange by journey."""
    out = df
    for rule in rules:
        weight = rule_weight(rule, first_weight, last_weight, decay, period)
        out = out.withColumn(f"_{rule}", F.when(F.col("converted"), weight).otherwise(0.0))
    return out


def _stacked(df: DataFrame, rules: Sequence[str], others: Sequence[Column | str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_{r}").alias("credit")) for r in rules])
    return df.select(*others, F.explode(each).alias("x")).select("*", "x.rule", "x.credit").drop("x")


def attribute(
    paths,
    rules: Sequence[str] = ALL_RULES,
    first_weight: float = 0.4,
    last_weight: float = 0.4,
    decay: float | None = None,
    period: float = 1,
    by: Sequence[str] = (),
    times: int = 0,
    level: float = 0.9,
    seed: int = 1,
) -> DataFrame:
    """(by..., rule, channel, conversions, share, value, touches[, lower, upper]).

    ``by`` columns must be present and constant within a journey, which is checked as the table is run (``check_segments`` does it
    at once). value is 0 where journeys carry none. With ``times``
    bootstrap replicates lower and upper bound the share at ``level``. Rows of a rule are not ordered: sort on
    conversions and channel as wanted.
    """
    if bad := set(rules) - set(ALL_RULES):
        raise ValueError(f"unknown rules: {', '.join(sorted(bad))}")
    by = [by] if isinstance(by, str) else list(by)
    if clash := set(by) & {"rule", "channel", "conversions", "share", "value", "touches", "lower", "upper", "path_id"}:
        raise ValueError(f"segments can't be named {', '.join(sorted(clash))}")
    df = _frame(paths)
    if by:
        df = _constant_within(df, by)
    plain = [r for r in rules if r != "markov"]
    parts = []
    if plain:
        scored = _stacked(_rule_credits(df, plain, first_weight, last_weight, decay, period), plain, [*by, "channel", "conversion_value"])
        sums = scored.groupBy(*by, "rule", "channel").agg(
            F.sum("credit").alias("conversions"), F.sum(F.col("credit") * F.coalesce("conversion_value", F.lit(0.0))).alias("value"), F.count("*").alias("touches")
        )
        whole = F.sum("conversions").over(Window.partitionBy(*by, "rule"))
        parts.append(sums.withColumn("share", F.coalesce(F.try_divide(F.col("conversions"), whole), F.lit(0.0))))
    if "markov" in rules:
        parts.append(removal_with_touches(df, by).withColumns({"rule": F.lit("markov"), "value": F.coalesce("value", F.lit(0.0))}))
    columns = [*by, "rule", "channel", "conversions", "share", "value", "touches"]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    if not times:
        return out
    bounds = share_intervals(df, rules, first_weight, last_weight, decay, period, by, times, level, seed)
    return out.join(bounds, [*by, "rule", "channel"], "left")


def _constant_within(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df``, refused when it is run if a ``by`` column is missing or differs within a journey. Windows are over the journey, as
    those of the rules are, so this costs no exchange of its own there."""
    journey = Window.partitionBy("path_id")
    refuse = lambda c: F.raise_error(F.lit(f"column {c} is missing or differs within a journey"))
    return df.withColumns({c: F.when(F.col(c).isNull() | (F.min(c).over(journey) != F.max(c).over(journey)), refuse(c).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in by})


def check_segments(paths, by: Sequence[str]) -> None:
    """Raises unless every ``by`` column is present and constant within each journey: one job."""
    df = _frame(paths)
    for c in by:
        mixed = df.groupBy("path_id").agg(F.min(c).alias("a"), F.max(c).alias("b"), F.count_if(F.col(c).isNull()).alias("n")).where("n > 0 or a <> b")
        if not mixed.isEmpty():
            raise ValueError(f"column {c} is missing or differs within a journey")


def poisson_draws(journeys: np.ndarray, times: int) -> np.ndarray:
    """How often each journey, given by a 64-bit hash, is drawn in each replicate: Poisson(1) from a mix of hash and replicate."""
    chances = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])
    with np.errstate(over="ignore"):
        z = journeys.astype(np.uint64)[:, None] + np.arange(1, times + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.searchsorted(chances, (z >> np.uint64(11)) / 2.0**53, side="right")


def replicate_sums(rows: DataFrame, keys: Sequence[str], times: int, seed: int) -> DataFrame:
    """(keys..., replicate, total): sums of ``amount`` over the journeys drawn in each replicate, of rows (path_id, keys, amount).

    A batch of rows becomes one row of sums for each of its keys, and these are summed again before they are shuffled: what is
    shuffled are keys times replicates, whatever the number of journeys.
    """
    keys = list(keys)

    def run(parts):
        for part in parts:
            code = part.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            draws = poisson_draws(part["journey"].to_numpy()[order], times) * part["amount"].to_numpy()[order][:, None]
            out = part.iloc[order[starts]][keys].copy()
            out["sums"] = list(np.add.reduceat(draws, starts, axis=0)) if len(part) else []
            yield out

    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    hashed = rows.select(*keys, F.col("amount").cast("double").alias("amount"), F.xxhash64("path_id", F.lit(seed)).alias("journey"))
    sums = hashed.mapInPandas(run, kinds + "sums array<double>").groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("sums")))).alias("sums"))
    return sums.select(*keys, F.posexplode("sums").alias("at", "total")).select(*keys, (F.col("at") + 1).alias("replicate"), "total")


def share_replicates(paths, rules, first_weight=0.4, last_weight=0.4, decay=None, period=1, by: Sequence[str] = (), times: int = 200, seed: int = 1) -> DataFrame:
    """(by..., replicate, rule, channel, share) of journeys drawn with replacement; replicates without conversions are absent.

    Credit and transitions of a journey are counted once, in rows that don't depend on ``times``, and weighted by its draws, as
    shares are functions of their sums. Draws are Poisson rather than multinomial: the same intervals, without a table of draws.
    """
    df = _frame(paths)
    parts = []
    plain = [r for r in rules if r != "markov"]
    if plain:
        held = _stacked(_rule_credits(df.where("converted"), plain, first_weight, last_weight, decay, period), plain, [*by, "path_id", "channel"])
        per_journey = held.groupBy(*by, "path_id", "rule", "channel").agg(F.sum("credit").alias("amount"))
        sums = replicate_sums(per_journey, [*by, "rule", "channel"], times, seed)
        whole = F.sum("total").over(Window.partitionBy(*by, "replicate", "rule"))
        parts.append(sums.withColumn("share", F.try_divide(F.col("total"), whole)).where("share is not null").select(*by, "replicate", "rule", "channel", "share"))
    if "markov" in rules:
        per_journey = transition_counts(df, [*by, "path_id"]).withColumnRenamed("n", "amount")
        moves = replicate_sums(per_journey, [*by, "source", "target", "ends"], times, seed).where("total > 0").withColumnRenamed("total", "n")

        def solve(segment: pd.DataFrame) -> pd.DataFrame:
            channels, without, base = solve_chain(segment)
            _, share = removal_effects(channels, without, base)
            out = pd.DataFrame({"rule": "markov", "channel": channels, "share": share})
            for name in (*by, "replicate"):
                out[name] = segment[name].iloc[0]
            return out if base > 0 else out.iloc[:0]

        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + "replicate int, rule string, channel string, share double"
        parts.append(moves.groupBy(*by, "replicate").applyInPandas(solve, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def share_intervals(paths, rules, first_weight=0.4, last_weight=0.4, decay=None, period=1, by: Sequence[str] = (), times: int = 200, level: float = 0.9, seed: int = 1) -> DataFrame:
    """(by..., rule, channel, lower, upper): type-7 percentiles over replicates, null for fewer than two."""
    require_number(level, "level", 1e-9, 1 - 1e-9)
    require_number(times, "times", 2, whole=True)
    tail = (1 - level) / 2
    got = share_replicates(paths, rules, first_weight, last_weight, decay, period, by, times, seed)
    ends = F.percentile("share", F.array(F.lit(tail), F.lit(1 - tail)))
    return got.groupBy(*by, "rule", "channel").agg(F.when(F.count("*") > 1, ends).alias("ends")).select(*by, "rule", "channel", F.col("ends")[0].alias("lower"), F.col("ends")[1].alias("upper"))


def attribution_spread(attribution: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., channel, min_share, max_share, mean_share, spread, first_last_ratio) over the rules; widest spread first."""
    first = F.max(F.when(F.col("rule") == "first", F.col("share")))
    last = F.max(F.when(F.col("rule") == "last", F.col("share")))
    out = attribution.groupBy(*by, "channel").agg(
        F.min("share").alias("min_share"), F.max("share").alias("max_share"), F.avg("share").alias("mean_share"), (F.max("share") - F.min("share")).alias("spread"), F.when(last > 0, F.try_divide(first, last)).alias("first_last_ratio")
    )
    return out.orderBy(*by, F.desc("spread"), "channel")
