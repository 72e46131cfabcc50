"""Scores of candidates on the splits that all of them completed, their jackknife errors and the one-standard-error pick.

What is compared is a row for each candidate and split, so it is small whatever the panel's size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrail.functions.metrics import finite


@dataclass(frozen=True)
class Scoring:
    """metric: rmse or mae; ``metric_fn(y, predicted)`` on arrays takes its place. aggregate: pooled (over all test rows) or mean
    (of the splits' metrics). Errors leave out blocks of ``se_block`` splits."""

    metric: str = "rmse"
    aggregate: str = "pooled"
    se_block: int = 1
    metric_fn: Callable | None = None

    def __post_init__(self):
        if self.metric not in ("rmse", "mae"):
            raise ValueError("metric is rmse or mae")
        if self.aggregate not in ("pooled", "mean"):
            raise ValueError("aggregate is pooled or mean")
        if self.se_block < 1:
            raise ValueError("se_block must be at least 1")

    def of(self, loss, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.asarray(loss, float) / np.asarray(n, float)
        return np.sqrt(mean) if self.metric == "rmse" else mean


@dataclass
class Compared:
    """metric, std_err: by candidate, NaN if it completed no split. jack: the metrics without each block, a row each."""

    metric: np.ndarray
    std_err: np.ndarray
    jack: np.ndarray | None
    common: list[int]
    live: list[int]
    lost: int
    first_failure: str | None

    def paired_error(self, candidate: int, anchor: int) -> float:
        return jackknife(self.jack[:, candidate] - self.jack[:, anchor]) if self.jack is not None else np.nan

    def one_standard_error(self, anchor: int, carry: list[tuple[float, float, float]]) -> int:
        """The candidate of least ``carry`` that is no worse than the anchor by more than the error of their difference."""
        near = [j for j in self.live if j == anchor or self.metric[j] - self.metric[anchor] <= self.paired_error(j, anchor)]
        return min(near, key=lambda j: carry[j])


def jackknife(theta: np.ndarray) -> float:
    g = len(theta)
    return float(np.sqrt((g - 1) / g * ((theta - theta.mean()) ** 2).sum())) if g > 1 else np.nan


def split_losses(predicted: DataFrame, metric: str = "rmse") -> DataFrame:
    """(candidate, split, n, loss, failure) of rows (candidate, split, y, predicted) with or without a failure."""
    off = F.col("y") - F.col("predicted")
    known, sound = finite(F.col("y")), F.coalesce(finite(F.col("predicted")), F.lit(False))
    told = F.max("failure") if "failure" in predicted.columns else F.lit(None).cast("string")
    odd = F.when(F.count_if(known & ~sound) > 0, "predictions are missing or not finite")
    return predicted.groupBy("candidate", "split").agg(F.count_if(known).alias("n"), F.sum(F.when(known, off * off if metric == "rmse" else F.abs(off))).alias("loss"), F.coalesce(told, odd).alias("failure"))


def compare(losses: pd.DataFrame, candidates: int, informative: list[int], scoring: Scoring, predicted: DataFrame | None = None) -> Compared:
    """``losses``: candidate, split, n, loss and maybe failure. Only ``informative`` splits count, those with a y to train on and one
    to test; candidates that completed none have no score, all others are scored on the splits that each of them completed.

    ``predicted`` is asked for where ``scoring`` has a function of arrays.
    """
    losses = losses.assign(failure=losses["failure"] if "failure" in losses else None)
    losses = losses[losses["split"].isin(informative)].sort_values(["candidate", "split"])
    failures = losses["failure"].dropna()
    if scoring.metric_fn and scoring.aggregate == "mean":
        values = _by_function(predicted, scoring.metric_fn, ["candidate", "split"]).toPandas()
        losses = losses.merge(values, on=["candidate", "split"], how="left")
        failures = pd.concat([failures, losses["reason"].dropna()])
        losses.loc[losses["failure"].isna() & ~np.isfinite(losses["value"]), "failure"] = "no finite metric"
    else:
        losses["value"] = scoring.of(losses["loss"], losses["n"])
    done = losses[losses["failure"].isna()]
    live = sorted(done["candidate"].unique().tolist())
    times = done.groupby("split")["candidate"].nunique()
    common = sorted(times.index[times == len(live)].tolist()) if live else []
    out = Compared(np.full(candidates, np.nan), np.full(candidates, np.nan), None, common, live, len(informative) - len(common) if live else 0, failures.iloc[0] if len(failures) else None)
    if not common:
        return out
    blocks = len(common) // scoring.se_block
    block = {s: -(-(i + 1) * blocks // len(common)) for i, s in enumerate(common)} if blocks > 1 else {}
    if scoring.metric_fn and scoring.aggregate == "pooled":
        whole = _by_function(predicted.where(F.col("candidate").isin(live) & F.col("split").isin(common)), scoring.metric_fn, ["candidate"], block).toPandas()
        out.first_failure = out.first_failure or next(iter(whole["reason"].dropna()), None)
        out.jack = np.full((blocks, candidates), np.nan) if block else None
        for j, value, left in zip(whole["candidate"], whole["value"], whole["left_out"], strict=True):
            out.metric[j] = value
            if block:
                out.jack[:, j] = left
    else:
        table = done[done["split"].isin(common)].assign(block=lambda d: d["split"].map(block) if block else 0)
        pieces = {c: table.pivot_table(index="split", columns="candidate", values=c, aggfunc="sum")[live].to_numpy() for c in ("loss", "n", "value")}
        held = np.array([block.get(s, 0) for s in common])
        pooled = scoring.aggregate == "pooled"
        score = (lambda keep: scoring.of(pieces["loss"][keep].sum(axis=0), pieces["n"][keep].sum(axis=0))) if pooled else (lambda keep: pieces["value"][keep].mean(axis=0))
        out.metric[live] = score(np.full(len(common), True))
        if block:
            out.jack = np.full((blocks, candidates), np.nan)
            out.jack[:, live] = np.stack([score(held != b) for b in range(1, blocks + 1)])
    if out.jack is not None:
        out.std_err = np.array([jackknife(out.jack[:, j]) for j in range(candidates)])
    return out


def _by_function(predicted: DataFrame, metric_fn: Callable, keys: list[str], block: dict[int, int] | None = None) -> DataFrame:
    """(keys..., value, reason, left_out): the function over a group's rows with a y, and without each block of splits."""
    blocks = max(block.values()) if block else 0

    def value(part: pd.DataFrame) -> tuple[float, str | None]:
        try:
            return float(metric_fn(part["y"].to_numpy(), part["predicted"].to_numpy())), None
        except Exception as e:  # the caller's function: its failure is a result
            return np.nan, f"metric_fn failed: {e}".split("\n")[0]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part[np.isfinite(part["y"])].sort_values(["split", "period", "y"])
        whole, reason = value(part)
        left = [value(part[part["split"].map(block) != b])[0] for b in range(1, blocks + 1)] if np.isfinite(whole) else [np.nan] * blocks
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "value": [whole], "reason": [reason], "left_out": [left]})

    return predicted.select("candidate", "split", "period", "y", "predicted").where(finite(F.col("y"))).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} int" for k in keys) + ", value double, reason string, left_out array<double>")
