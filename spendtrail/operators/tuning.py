"""Forward-only cross-validation of carryover, with the grid of candidates as rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendtrail.functions.decay import half_life
from spendtrail.functions.metrics import EPS, finite
from spendtrail.operators.adstock import Adstock, adstock_weights_total
from spendtrail.operators.gram import cross_products, fits, fitted_values, means
from spendtrail.operators.scoring import Compared, Scoring, compare, split_losses
from spendtrail.validate import require_columns, require_distinct, require_number


def splits(n: int, scheme: str = "rolling_origin", initial: int | None = None, assess: int = 1, skip: int = 0, k: int = 5) -> list[tuple[int, int]]:
    """(last training period, last test period) of each forward split of periods 1..n."""
    for name, value, low in (("initial", initial, 2), ("assess", assess, 1), ("skip", skip, 0), ("k", k, 1)):
        if value is not None:
            require_number(value, name, low, whole=True)
    initial = initial or max(2, n // 2)
    if scheme == "rolling_origin":
        out = [(e, e + assess) for e in range(initial, n - assess + 1, skip + 1)]
    elif scheme == "k_fold_forward":
        edges = np.floor(np.linspace(initial, n, k + 1)).astype(int).tolist()
        out = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
    else:
        raise ValueError("scheme is rolling_origin or k_fold_forward")
    if not out:
        raise ValueError("too few periods for a split")
    return out


def grid(max_lags: Sequence[float] = (math.inf,), decays: Sequence[float] = tuple(round(0.1 + 0.05 * i, 2) for i in range(17)), normalise: bool = True) -> list[Adstock]:
    if not max_lags or not decays or len(set(max_lags)) < len(max_lags) or len(set(decays)) < len(decays):
        raise ValueError("max_lags and decays need at least one value each and none twice")
    return [Adstock("geometric", d, lag, normalise=normalise) for lag in max_lags for d in decays if not (math.isinf(lag) and d == 1)]


def filtered_wide(df: DataFrame, media: Sequence[str], y: str, index: str, candidates: Sequence[Adstock], by: Sequence[str] = (), controls: Sequence[str] = (), warm_until: int | None = None) -> DataFrame:
    """(by..., period, y, x): x holds every medium filtered by every candidate, medium by medium, then the controls.

    With ``warm_until`` a series starts as if it had always spent its mean over the first periods up to that one, as many as
    hold nine tenths of the carryover; where it has none of these, or the kernel is not geometric, it starts cold.

    Filters are causal, so filtering once is the same as filtering each training window. period numbers the distinct times. A
    series with two rows of a period is refused; a missing y is NaN; missing controls are refused.
    """
    require_columns(df, [*by, index], numeric=[*media, y, *controls])
    require_distinct([*media, *controls], "media and controls")
    times = df.select(index).distinct().withColumn("period", F.dense_rank().over(Window.orderBy(index)))
    number = lambda c: F.col(c).cast("double")
    known = lambda c: F.when(finite(F.col(c)), number(c)).otherwise(F.raise_error(F.lit(f"{c} has missing or infinite values")).cast("double"))
    rows = df.select(*by, index, number(y).alias("y"), F.array(*map(known, media)).alias("media"), F.array(*map(known, controls)).cast("array<double>").alias("controls")).join(F.broadcast(times), index)

    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("period")
        if series["period"].duplicated().any():
            raise ValueError(f"a series repeats a period of {index}")
        inside = int((series["period"] <= warm_until).sum()) if warm_until else 0
        values = np.stack(series["media"].to_numpy()).T
        made = [warmed(k, own, own[:inside]) for own in values for k in candidates]
        return series[[*by, "period", "y"]].assign(x=[[*z, *c] for z, c in zip(zip(*made, strict=True), series["controls"], strict=True)])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return rows.groupBy(*by).applyInPandas(run, "".join(f"`{c}` {kinds[c]}, " for c in by) + "period int, y double, x array<double>")


def by_candidate(wide: DataFrame, candidates: int, controls: Sequence[str] = (), at: int = 0) -> DataFrame:
    """(by..., period, y, candidate, z, controls...): a row for each candidate of the medium at that place."""
    held = [c for c in wide.columns if c != "x"]
    last = [F.element_at("x", i - len(controls)).alias(c) for i, c in enumerate(controls)]
    return wide.select(*held, F.posexplode(F.slice("x", at * candidates + 1, candidates)).alias("candidate", "z"), *last)


def filtered(df: DataFrame, x: str, y: str, index: str, candidates: Sequence[Adstock], by: Sequence[str] = (), controls: Sequence[str] = (), warm_until: int | None = None) -> DataFrame:
    """(by..., period, y, candidate, z, controls...): the series filtered by every candidate, in one pass over each series."""
    return by_candidate(filtered_wide(df, [x], y, index, candidates, by, controls, warm_until), len(candidates), controls)


def warmed(kernel: Adstock, values: np.ndarray, early: np.ndarray) -> np.ndarray:
    """The filtered series, before which the mean of the first of ``early`` was spent for ever."""
    if not len(early) or kernel.kind != "geometric" or kernel.decay == 0:
        return kernel.run(values)
    window = math.ceil(math.log(0.1) / math.log(kernel.decay)) if kernel.decay < 1 else len(early)
    steady = float(np.mean(early[: max(1, min(window, len(early)))]))
    reached = np.zeros(len(values))
    weights = kernel.kernel(len(values))
    reached[: len(weights)] = weights
    return kernel.run(values) + steady * (adstock_weights_total(kernel) - reached.cumsum())


def expanding_fits(rows: DataFrame) -> DataFrame:
    """(candidate, period, intercept, slope): least squares of y on z over all rows up to the period, by running sums.

    Sums are about each candidate's overall means, which keeps the differences that slopes are made of. Windows run over sums
    by period, not over rows; rows without a y don't count.
    """
    rows = rows.where(finite(F.col("y")))
    level = rows.groupBy("candidate").agg(F.avg("z").alias("mz"), F.avg("y").alias("my"))
    centred = rows.join(F.broadcast(level), "candidate").withColumns({"u": F.col("z") - F.col("mz"), "v": F.col("y") - F.col("my")})  # a row a candidate
    per = centred.groupBy("candidate", "period").agg(F.count("*").alias("n"), F.sum("u").alias("u"), F.sum("v").alias("v"), F.sum(F.col("u") * F.col("u")).alias("uu"), F.sum(F.col("u") * F.col("v")).alias("uv"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.first("mz").alias("mz"), F.first("my").alias("my"))
    run = Window.partitionBy("candidate").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    per = per.select("candidate", "period", "mz", "my", *[F.sum(c).over(run).alias(c) for c in ("n", "u", "v", "uu", "uv", "zz")])
    sxx, sxy = F.col("uu") - F.col("u") * F.col("u") / F.col("n"), F.col("uv") - F.col("u") * F.col("v") / F.col("n")
    slope = F.when(sxx <= EPS * F.col("zz"), 0.0).otherwise(F.try_divide(sxy, sxx))
    per = per.withColumn("slope", slope)
    return per.select("candidate", "period", (F.col("my") + F.col("v") / F.col("n") - F.col("slope") * (F.col("mz") + F.col("u") / F.col("n"))).alias("intercept"), "slope")


def predictions(rows: DataFrame, cuts: Sequence[tuple[int, int]]) -> DataFrame:
    """(candidate, split, by..., period, y, predicted): test rows of each split by the fit on the periods before."""
    fits = expanding_fits(rows)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("split"), F.lit(a).alias("train_to"), F.lit(b).alias("test_to")) for i, (a, b) in enumerate(cuts)])).alias("s")
    models = fits.select("candidate", F.col("period").alias("fitted_to"), "intercept", "slope", each).where(F.col("fitted_to") == F.col("s.train_to"))
    tested = rows.select("*", each).where((F.col("period") > F.col("s.train_to")) & (F.col("period") <= F.col("s.test_to")))
    by = [c for c in rows.columns if c not in ("candidate", "period", "y", "z")]
    models = models.select("candidate", F.col("s.split").alias("split"), "intercept", "slope")
    tested = tested.select("candidate", F.col("s.split").alias("split"), *by, "period", "y", "z")
    return tested.join(models, ["candidate", "split"]).select("candidate", "split", *by, "period", "y", (F.col("intercept") + F.col("slope") * F.col("z")).alias("predicted"))


@dataclass
class Carryover:
    """results: a row for each candidate, the best first: metric, its jackknife error std_err and paired_err, that of the
    difference from the best. ``notices``: picks at the edge of what was searched, splits left out as fits failed on them."""

    best: Adstock
    best_1se: Adstock
    results: pd.DataFrame
    predictions: DataFrame
    notices: list[str]
    n_splits: int = 0
    n_ok: int = 0


#: For each parameter: the values at which an edge says nothing, and the value of the other one at which it has no effect.
BOUNDS = {"decay": ((0.0, 1.0), ("max_lag", 1.0)), "max_lag": ((1.0, math.inf), ("decay", 0.0))}


def edge_notices(pick: Adstock, candidates: Sequence[Adstock], of: str = "") -> list[str]:
    """A notice for each parameter of the pick that ends the range of three or more values tried beside its other parameter."""
    out = []
    for name, (natural, (other, idle)) in BOUNDS.items():
        value, beside = getattr(pick, name), getattr(pick, other)
        tried = sorted({getattr(k, name) for k in candidates if getattr(k, other) == beside})
        if len(tried) > 2 and beside != idle and value not in natural and value in (tried[0], tried[-1]):
            side, more = ("largest", "larger") if value == tried[-1] else ("smallest", "smaller")
            out.append(f"{of}{name} {value:g} is the {side} value tried; try {more} ones")
    return out


def informative_splits(rows: DataFrame, cuts: Sequence[tuple[int, int]]) -> list[int]:
    """Splits with a y to train on and one to test."""
    known = np.sort([r["period"] for r in rows.where(finite(F.col("y"))).select("period").distinct().collect()])
    count = lambda until: int(np.searchsorted(known, until, "right"))
    found = [i for i, (a, b) in enumerate(cuts) if 0 < count(a) < count(b)]
    if not found:
        raise ValueError("no split has a y both to train on and to test")
    return found


def check_scores(found: Compared) -> None:
    if np.isfinite(found.metric).any():
        return
    if not found.live:
        raise RuntimeError(f"every candidate failed: {found.first_failure}")
    if not found.common:
        raise RuntimeError(f"no split was completed by every candidate; the first failure: {found.first_failure}")
    raise RuntimeError(f"no candidate has a finite metric; the first failure: {found.first_failure}")


def lost_notices(lost: int, n_ok: int, why: str | None) -> list[str]:
    return [f"{lost} splits left out, scored on the {n_ok} that all candidates completed; the first failure: {why}"] if lost else []


def carried(candidates: Sequence[Adstock]) -> list[tuple[float, float, float]]:
    """By what the one-standard-error pick prefers: little decay (none at one lag), then short kernels."""
    return [(0.0 if k.max_lag == 1 else k.decay, k.max_lag, k.decay) for k in candidates]


def profile(candidates: Sequence[Adstock], found: Compared, anchor: int) -> pd.DataFrame:
    live = lambda k: 0 < k.decay < 1 and k.max_lag > 1
    return pd.DataFrame({
        "candidate": range(len(candidates)), "decay": [k.decay for k in candidates], "max_lag": [k.max_lag for k in candidates],
        "half_life": [half_life(k.decay) if live(k) else np.nan for k in candidates], "metric": found.metric, "std_err": found.std_err,
        "paired_err": [found.paired_error(j, anchor) for j in range(len(candidates))],
    })


def tune_carryover(
    df: DataFrame, x: str, y: str, index: str, by: Sequence[str] = (), candidates: Sequence[Adstock] | None = None, metric: str = "rmse", aggregate: str = "pooled", scheme: str = "rolling_origin",
    initial: int | None = None, assess: int = 1, skip: int = 0, k: int = 5, se_block: int = 1, controls: Sequence[str] = (), fit: Callable | None = None, predict: Callable | None = None,
    metric_fn: Callable | None = None, warm_start: bool = False,
) -> Carryover:
    """The candidate with the least forward error, and the one of least carryover within one paired standard error of it.

    The model is least squares of y on the carried-over series and the ``controls``, or any: ``fit(z, y)`` and
    ``predict(model, z)`` on arrays, z with a column for the series and each control if there are any. ``metric_fn(y,
    predicted)`` takes the place of ``metric``. A split on which a candidate's fit fails, or whose predictions are of the wrong
    number or not finite, counts for none; a candidate that completes no split has no metric. If all do, an error says why.
    """
    if (fit is None) != (predict is None):
        raise ValueError("fit and predict go together")
    candidates = list(candidates or grid())
    scoring = Scoring(metric, aggregate, se_block, metric_fn)
    require_columns(df, [*by, index], numeric=[x, y, *controls])
    cuts = splits(df.select(index).distinct().count(), scheme, initial, assess, skip, k)
    wide = filtered_wide(df, [x], y, index, candidates, by, controls, cuts[0][0] if warm_start else None).persist()
    held = [wide]
    try:
        informative = informative_splits(wide, cuts)
        if fit is None and controls:
            about = means(wide)
            models = {c: [c, *range(len(candidates), len(candidates) + len(controls))] for c in range(len(candidates))}
            made = fits(cross_products(wide, about), about, models, cuts).persist()
            held.append(made)
            predicted = fitted_values(wide, made, models, cuts)
            exact = metric == "rmse" and metric_fn is None  # squared errors follow from cross products alone
            losses = (made.select("candidate", "split", "n", "loss") if exact else split_losses(predicted, metric)).toPandas()
        else:
            rows = by_candidate(wide, len(candidates), controls)
            predicted = (predictions(rows, cuts) if fit is None else cross_validate(rows, cuts, fit, predict, ["z", *controls] if controls else "z")).persist()
            held.append(predicted)
            losses = split_losses(predicted, metric).toPandas()
        found = compare(losses, len(candidates), informative, scoring, predicted)
        check_scores(found)
    finally:
        for part in held:
            part.unpersist()
    best = int(np.nanargmin(found.metric))
    near = found.one_standard_error(best, carried(candidates))
    results = profile(candidates, found, best).sort_values(["metric", "candidate"]).reset_index(drop=True)
    notices = edge_notices(candidates[best], candidates) + lost_notices(found.lost, len(found.common), found.first_failure)
    return Carryover(candidates[best], candidates[near], results, predicted, notices, len(cuts), len(found.common))


def cross_validate(rows: DataFrame, cuts: Sequence[tuple[int, int]], fit: Callable, predict: Callable, known: str | Sequence[str] = "z") -> DataFrame:
    """(candidate, split, period, y, predicted, failure) with any model: ``fit(z, y)`` and ``predict(model, z)`` on arrays of the
    column or columns ``known``.

    A function of arrays needs them whole, so a candidate's panel is one task's; candidates run side by side. What a split
    raises is its failure, and its rows have no prediction; so is a wrong number of predictions.
    """
    known = known if isinstance(known, str) else list(known)

    def tried(train: pd.DataFrame, test: pd.DataFrame) -> tuple[np.ndarray, str | None]:
        step = "fit"
        try:
            model = fit(train[known].to_numpy(), train["y"].to_numpy())
            step = "predict"
            made = np.asarray(predict(model, test[known].to_numpy()), float)
        except Exception as e:  # the caller's model: its failure is a result
            return np.full(len(test), np.nan), f"{step} failed: {e}".split("\n")[0]
        if made.shape != (len(test),):
            return np.full(len(test), np.nan), f"predict returned {made.size} values for {len(test)} rows"
        return made, None

    def run(candidate: pd.DataFrame) -> pd.DataFrame:
        out, order = [], candidate.sort_values("period", kind="stable")
        for i, (a, b) in enumerate(cuts):
            test = order[(order["period"] > a) & (order["period"] <= b)]
            made, failure = tried(order[order["period"] <= a], test)
            out.append(test[["candidate", "period", "y"]].assign(split=i, predicted=made, failure=failure))
        return pd.concat(out)[["candidate", "split", "period", "y", "predicted", "failure"]]

    return rows.groupBy("candidate").applyInPandas(run, "candidate int, split int, period int, y double, predicted double, failure string")


@dataclass
class JointCarryover:
    """best, best_1se: a kernel for each channel. metric, best_1se_metric: of each set as a whole, on the splits both completed.

    profiles: (channel, candidate, ..., metric, std_err, paired_err) of the last sweep, other channels at their best; history: the
    best of each step; predictions: (selection, split, period, y, predicted) of both sets.
    """

    best: dict[str, Adstock]
    best_1se: dict[str, Adstock]
    metric: float
    best_1se_metric: float
    profiles: pd.DataFrame
    history: pd.DataFrame
    converged: bool
    predictions: DataFrame
    notices: list[str]
    n_splits: int
    n_ok: int

    @property
    def iterations(self) -> int:
        return int(self.history["sweep"].max())

    def chart(self) -> pd.DataFrame:
        """The profiles, with what is picked of each channel marked as best and best_1se."""
        is_ = lambda picks: [(d, lag) == (picks[c].decay, picks[c].max_lag) for c, d, lag in self.profiles[["channel", "decay", "max_lag"]].itertuples(index=False)]
        return self.profiles.assign(best=is_(self.best), best_1se=is_(self.best_1se))


def tune_carryover_joint(
    df: DataFrame, media: Sequence[str], y: str, index: str, by: Sequence[str] = (), candidates: Sequence[Adstock] | None = None, start: dict[str, float] | None = None, max_iter: int = 10,
    controls: Sequence[str] = (), fit: Callable | None = None, predict: Callable | None = None, metric: str = "rmse", metric_fn: Callable | None = None, aggregate: str = "pooled", se_block: int = 1,
    warm_start: bool = False, **cv,
) -> JointCarryover:
    """Coordinate descent: one channel's candidates at a time, all others held, until a sweep changes nothing.

    Each channel starts at the candidate whose decay is nearest to ``start``, by default the middle of the grid. The model is
    least squares of y on all channels and the ``controls``: every channel under every candidate is filtered once, their cross
    products are summed once, and all steps of the search read only these. Any other model, ``fit(x, y)`` and
    ``predict(model, x)`` with a column for each channel and control, has its candidates' panels side by side. What is said of
    failures in ``tune_carryover`` holds within each step; so does what ``metric``, ``metric_fn`` and ``aggregate`` mean.
    """
    if (fit is None) != (predict is None):
        raise ValueError("fit and predict go together")
    candidates, media = list(candidates or grid()), list(media)
    if unknown := set(start or {}) - set(media):
        raise ValueError(f"start names no channels: {sorted(unknown)}")
    scoring = Scoring(metric, aggregate, se_block, metric_fn)
    cuts = splits(df.select(index).distinct().count(), **cv)
    size = len(candidates)
    decays = np.array([k.decay for k in candidates])
    nearest = lambda decay: int(np.argmin(np.abs(decays - decay)))
    chosen = {c: nearest((start or {}).get(c, float(np.median(np.unique(decays))))) for c in media}
    wide = filtered_wide(df, media, y, index, candidates, by, controls, cuts[0][0] if warm_start else None).persist()
    informative = informative_splits(wide, cuts)
    held = [wide]
    if fit is None:
        about = means(wide)
        products = cross_products(wide, about).persist()
        held.append(products)

    def columns(selection: dict[str, int]) -> list[int]:
        return [i * size + selection[c] for i, c in enumerate(media)] + list(range(len(media) * size, len(media) * size + len(controls)))

    def predicted_by(models: dict[int, list[int]]) -> DataFrame:
        if fit is None:
            return fitted_values(wide, fits(products, about, models, cuts), models, cuts)
        names = [f"x{i}" for i in range(len(media) + len(controls))]
        each = F.explode(F.array(*[F.struct(F.lit(g).alias("candidate"), F.array(*[F.element_at("x", i + 1) for i in at]).alias("own")) for g, at in models.items()])).alias("m")
        rows = wide.select("period", "y", each).select("period", "y", "m.candidate", *[F.element_at("m.own", i + 1).alias(n) for i, n in enumerate(names)])
        return cross_validate(rows, cuts, fit, predict, names)

    def scored(selections: list[dict[str, int]]) -> Compared:
        models = {g: columns(s) for g, s in enumerate(selections)}
        if fit is None and metric == "rmse" and metric_fn is None:
            losses, made = fits(products, about, models, cuts).select("candidate", "split", "n", "loss").toPandas(), None
        else:
            made = predicted_by(models).persist()
            losses = split_losses(made, metric).toPandas()
        try:
            found = compare(losses, len(selections), informative, scoring, made)
        finally:
            if made is not None:
                made.unpersist()
        check_scores(found)
        return found

    try:
        last, history, converged, lost = {}, [], False, (0, 0, None)
        for sweep in range(1, max_iter + 1):
            before = dict(chosen)
            for c in media:
                found = last[c] = scored([chosen | {c: g} for g in range(size)])
                lost = max(lost, (found.lost, len(found.common), found.first_failure), key=lambda x: x[0])
                best, now = int(np.nanargmin(found.metric)), found.metric[chosen[c]]
                if not np.isfinite(now) or found.metric[best] < now - 1e-10 * max(1.0, abs(now)):
                    chosen[c] = best
                history.append((sweep, c, chosen[c], candidates[chosen[c]].decay, found.metric[chosen[c]]))
            if chosen == before:
                converged = True
                break
        near = {c: last[c].one_standard_error(chosen[c], carried(candidates)) for c in media}
        both = scored([chosen, near])
    finally:
        for part in held:
            part.unpersist()
    models = {0: columns(chosen), 1: columns(near)}
    kept = predicted_by(models).where(F.col("split").isin(both.common))
    kept = kept.select(F.when(F.col("candidate") == 0, "best").otherwise("best_1se").alias("selection"), *[c for c in kept.columns if c not in ("candidate", "failure")])
    notices = [n for c in media for n in edge_notices(candidates[chosen[c]], candidates, f"{c}: ")] + lost_notices(*lost)
    if not converged:
        notices.append(f"not settled within {max_iter} sweeps")
    return JointCarryover(
        {c: candidates[g] for c, g in chosen.items()}, {c: candidates[g] for c, g in near.items()}, float(both.metric[0]), float(both.metric[1]),
        pd.concat([profile(candidates, last[c], chosen[c]).assign(channel=c) for c in media], ignore_index=True),
        pd.DataFrame(history, columns=["sweep", "channel", "candidate", "decay", "metric"]), converged, kept, notices, len(cuts), len(both.common),
    )
