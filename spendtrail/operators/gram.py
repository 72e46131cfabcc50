"""Least squares of many models on many training windows, from one table of cross products by period.

A row's regressors are an array; their cross products with each other and with y add up over rows, so tasks sum them by period
and the sums of tasks merge. Every model is a choice of columns: its cross products are rows and columns of that table, its
training windows running sums of them. What is solved grows with periods, candidates and regressors, not with rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrail.functions.metrics import finite

HELD = 1 << 23  # numbers that a task holds before it passes its sums on
TOLERANCE = 1e-11  # of a regressor's square sum: what is left of it beyond those before it counts as nothing
BROADCAST = 100_000  # fits of (candidate, split): up to so many are sent to all tasks


def means(rows: DataFrame) -> np.ndarray:
    """Of each regressor and of y, over the rows that have a y. Cross products about them keep the digits that fits need."""
    known = rows.where(finite(F.col("y")))
    first = known.agg(Summarizer.mean(array_to_vector(F.col("x"))).alias("x"), F.avg("y").alias("y")).first()
    if first["y"] is None:
        raise ValueError("y has no finite value")
    return np.append(first["x"].toArray(), first["y"])


def cross_products(rows: DataFrame, about: np.ndarray) -> DataFrame:
    """(period, cells): for rows (period, y, x) with a y, the sums of products of 1, the regressors and y less ``about``.

    cells: the upper triangle, row by row.
    """
    width = len(about) - 1
    upper = np.triu_indices(width + 2)

    def run(batches):
        def passed_on():
            cells = pa.array([g[upper] for g in held.values()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), cells], ["period", "cells"])

        held = {}
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            known = np.isfinite(y)
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(y), width)
            period = batch.column(0).to_numpy(zero_copy_only=False)[known]
            order = np.argsort(period, kind="stable")
            v = np.column_stack([np.ones(known.sum()), x[known] - about[:-1], y[known] - about[-1]])[order]
            names, starts = np.unique(period[order], return_index=True)
            for p, part in zip(names.tolist(), np.split(v, starts[1:]), strict=False):
                held[p] = held.get(p, 0.0) + part.T @ part
                if len(held) * (width + 2) ** 2 > HELD:
                    yield passed_on()
                    held = {}
        if held:
            yield passed_on()

    sums = rows.select("period", "y", "x").mapInArrow(run, "period int, cells array<double>")
    return sums.groupBy("period").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("cells")))).alias("cells"))


def least_squares(products: np.ndarray) -> np.ndarray:
    """Coefficients for each matrix of cross products (of regressors, then y); a regressor that those before it determine has 0."""
    a = products.astype(float)
    k = a.shape[-1] - 1
    size = np.einsum("sii->si", a).copy()
    for j in range(k):
        pivot = a[:, j, j]
        sound = pivot > TOLERANCE * size[:, j]
        row = np.where(sound[:, None], a[:, j, :] / np.where(sound, pivot, 1)[:, None], 0.0)
        a -= np.where(sound[:, None], a[:, :, j], 0.0)[:, :, None] * row[:, None, :]
        a[:, j, :] = row
        a[~sound, :, j] = 0.0
    return a[:, :k, k]


def fits(products: DataFrame, about: np.ndarray, models: dict[int, Sequence[int]], cuts: Sequence[tuple[int, int]]) -> DataFrame:
    """(candidate, split, n, loss, coefficients) for every model (its columns of x) and split (last training, last test period).

    n and loss: test rows with a y and their sum of squared errors; coefficients: the intercept, then one for each column.
    A model's cross products over all periods are one task's, some numbers a period.
    """
    width = len(about) + 1
    upper = np.triu_indices(width)
    places = {c: [0, *[i + 1 for i in columns], width - 1] for c, columns in models.items()}

    def chosen(parts):
        for part in parts:
            for period, cells in zip(part["period"], part["cells"], strict=True):
                whole = np.zeros((width, width))
                whole[upper] = cells
                whole += np.triu(whole, 1).T
                yield pd.DataFrame({"candidate": list(places), "period": period, "cells": [whole[np.ix_(at, at)].ravel() for at in places.values()]})

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("period")
        candidate = int(part["candidate"].iloc[0])
        k = len(places[candidate]) - 1
        period, each = part["period"].to_numpy(), np.stack(part["cells"].to_numpy()).reshape(-1, k + 1, k + 1)
        running = np.concatenate((np.zeros((1, k + 1, k + 1)), each.cumsum(axis=0)))
        first, last = np.array(cuts).T
        beta = least_squares(running[np.searchsorted(period, first, "right")])
        test = np.stack([each[(period > a) & (period <= b)].sum(axis=0) for a, b in cuts])
        off = np.concatenate((beta, -np.ones((len(cuts), 1))), axis=1)
        loss = np.einsum("si,sij,sj->s", off, test, off)
        level = np.array(about)[[*models[candidate]]]
        beta[:, 0] += about[-1] - beta[:, 1:] @ level
        return pd.DataFrame({"candidate": candidate, "split": np.arange(len(cuts)), "n": test[:, 0, 0].round().astype(np.int64), "loss": np.maximum(loss, 0.0), "coefficients": list(beta)})

    narrow = products.mapInPandas(chosen, "candidate int, period int, cells array<double>")
    return narrow.groupBy("candidate").applyInPandas(solved, "candidate int, split int, n long, loss double, coefficients array<double>")


def fitted_values(rows: DataFrame, made: DataFrame, models: dict[int, Sequence[int]], cuts: Sequence[tuple[int, int]]) -> DataFrame:
    """(candidate, split, the columns of ``rows`` but x, predicted): test rows of every split by every fit."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("split"), F.lit(a).alias("after"), F.lit(b).alias("until")) for i, (a, b) in enumerate(cuts)])).alias("s")
    tested = rows.select("*", each).where((F.col("period") > F.col("s.after")) & (F.col("period") <= F.col("s.until"))).select("*", F.col("s.split").alias("split")).drop("s")
    columns = F.element_at(F.create_map(*[x for c, at in models.items() for x in (F.lit(c), F.array(*map(F.lit, at)))]), F.col("candidate"))
    made = made.select("candidate", "split", "coefficients", columns.alias("columns"))
    joined = tested.join(F.broadcast(made) if len(models) * len(cuts) <= BROADCAST else made, "split")
    value = F.aggregate(F.sequence(F.lit(1), F.size("columns")), F.col("coefficients")[0], lambda total, i: total + F.element_at("coefficients", i + 1) * F.element_at("x", F.element_at("columns", i) + 1))
    return joined.select("candidate", "split", *[c for c in rows.columns if c != "x"], value.alias("predicted"))
