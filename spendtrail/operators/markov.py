"""Order-1 Markov removal effects: transitions are counted in Spark, the small absorbing chain is solved per segment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendtrail.operators.credit import _frame

START, CONVERSION, NULL = "(start)", "(conversion)", "(null)"


def transition_counts(paths, by: Sequence[str] = (), value: bool = False) -> DataFrame:
    """(by..., source, target, ends, n[, total]): source null is the start; ends: '' for channels, else how a journey ended; total:
    the values of the journeys that ended so, null where none has one.

    One exchange by journey, then partial counts; none more where path_id is among ``by``.
    """
    df = _frame(paths)
    order = Window.partitionBy("path_id").orderBy("touch_rank")
    worth = [F.when(F.col("converted"), F.col("conversion_value")).alias("worth")] if value else []
    step = df.select(*by, "channel", "touch_rank", "converted", *worth, F.lead("channel").over(order).alias("next"))
    end = F.when(F.col("converted"), CONVERSION).otherwise(NULL)
    moves = F.array(
        F.when(F.col("touch_rank") == 1, F.struct(F.lit(None).cast("string").alias("source"), F.col("channel").alias("target"), F.lit("").alias("ends"))),
        F.struct(F.col("channel").alias("source"), F.col("next").alias("target"), F.when(F.col("next").isNull(), end).otherwise("").alias("ends")),
    )
    sums = [F.count("*").alias("n"), *([F.sum(F.when(F.col("ends") != "", F.col("worth"))).alias("total")] if value else [])]
    return step.select(*by, *(["worth"] if value else []), F.explode(F.array_compact(moves)).alias("m")).select("*", "m.*").groupBy(*by, "source", "target", "ends").agg(*sums)


def solve_chain(moves: pd.DataFrame) -> tuple[list[str], np.ndarray, float]:
    """(channels in order, P(conversion) without each, P(conversion)) of counted moves."""
    channels = sorted({*moves["source"].dropna(), *moves["target"].dropna()}, key=lambda c: c.encode())
    at = {c: i + 1 for i, c in enumerate(channels)}
    k = len(channels)
    counts, wins = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
    total = np.zeros(k + 1)
    for source, target, ends, n in moves[["source", "target", "ends", "n"]].itertuples(index=False):
        i = 0 if source is None or source != source else at[source]
        total[i] += n
        if ends == CONVERSION:
            wins[i] += n
        elif ends == "":
            counts[i, at[target]] += n
    scale = np.where(total > 0, total, 1)
    inverse = np.linalg.inv(np.eye(k + 1) - counts / scale[:, None])
    reach = inverse @ (wins / scale)
    own = np.diag(inverse)[1:]
    without = reach[0] - inverse[0, 1:] / own * reach[1:]
    return channels, np.clip(without, 0, 1), float(reach[0])


def removal_effects(channels: list[str], without: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    effect = np.maximum(0, 1 - without / base) if base > 0 else np.zeros(len(channels))
    return effect, effect / effect.sum() if effect.sum() > 0 else np.zeros(len(channels))


def markov_removal(paths, by: Sequence[str] = ()) -> DataFrame:
    """(by..., channel, removal_effect, conversions, share, value, p_without, p_conversion) for each segment's channels.

    What is solved for a segment is at most its (channels + 1) x (channels + 2) counts. value is null where no converting
    journey has one.
    """
    return removal_with_touches(paths, by).drop("touches")


def removal_with_touches(paths, by: Sequence[str] = ()) -> DataFrame:
    """``markov_removal`` and each channel's number of touches, all from one pass: every touch is the source of one move, and the
    conversions and their values are those of the moves that end so."""
    df = _frame(paths)
    rows = transition_counts(df, by, value=True)

    def solve(segment: pd.DataFrame) -> pd.DataFrame:
        channels, without, base = solve_chain(segment)
        effect, share = removal_effects(channels, without, base)
        won = segment[segment["ends"] == CONVERSION]
        total = won["total"].sum(min_count=1)
        touches = segment.groupby("source")["n"].sum().reindex(channels, fill_value=0).to_numpy()
        out = pd.DataFrame({"channel": channels, "removal_effect": effect, "conversions": int(won["n"].sum()) * share, "share": share, "value": total * share if total == total else None, "p_without": without, "p_conversion": base, "touches": touches})
        for name in by:
            out[name] = segment[name].iloc[0]
        return out

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + "channel string, removal_effect double, conversions double, share double, value double, p_without double, p_conversion double, touches long"
    return rows.groupBy(*by).applyInPandas(solve, schema)


def transitions(paths, by: Sequence[str] = ()) -> DataFrame:
    """(by..., from, to, n, p): observed moves and their probabilities, with names for start and ends."""
    moves = transition_counts(paths, by)
    source, target = F.coalesce("source", F.lit(START)), F.coalesce("target", "ends")
    whole = Window.partitionBy(*by, "source")
    return moves.select(*by, source.alias("from"), target.alias("to"), "n", (F.col("n") / F.sum("n").over(whole)).alias("p"))
