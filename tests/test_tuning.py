"""The tuners against least squares by hand: controls, joint search, any model, failures, warm start."""

import itertools
import math

import numpy as np
import pytest

from spendtrail.operators.adstock import Adstock
from spendtrail.operators.gram import cross_products, fits, least_squares, means
from spendtrail.operators.scoring import Scoring, jackknife
from spendtrail.operators.tuning import edge_notices, filtered_wide, splits, tune_carryover, tune_carryover_joint, warmed

KERNELS = [Adstock("geometric", d) for d in (0.2, 0.5, 0.8)]


def market(spark, geos=2, n=50, seed=5, missing=()):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(geos):
        a, b, c = rng.gamma(2, 40, n), rng.gamma(2, 30, n), rng.normal(0, 1, n)
        y = 1000 + 3 * KERNELS[1].run(a) + 2 * KERNELS[0].run(b) + 15 * c + rng.normal(0, 4, n)
        rows += [(f"g{g}", i, float(a[i]), float(b[i]), float(c[i]), None if (g, i) in missing else float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "geo string, t int, a double, b double, c double, y double"), rows


def designs(rows, picks, control=False):
    """(period, y, regressors) of all rows, the channels filtered by the picked kernels."""
    out = []
    for g in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == g]
        made = [KERNELS[k].run(np.array([r[2 + i] for r in own])) for i, k in enumerate(picks)]
        out += [(r[1] + 1, np.nan if r[5] is None else r[5], [1.0, *[float(z[j]) for z in made], *([r[4]] if control else [])]) for j, r in enumerate(own)]
    return out


def by_hand(design, cuts):
    """Squared errors by split of lstsq on each training window."""
    period, y, x = (np.array(c) for c in zip(*design, strict=True))
    out = []
    for a, b in cuts:
        train, test = (period <= a) & np.isfinite(y), (period > a) & (period <= b) & np.isfinite(y)
        beta = np.linalg.lstsq(x[train], y[train], rcond=None)[0]
        out.append((x[test] @ beta - y[test]) ** 2)
    return out


def rmse_of(parts):
    return math.sqrt(np.concatenate(parts).mean())


def test_fits_from_cross_products_equal_lstsq(spark):
    df, rows = market(spark, missing={(0, 3), (1, 40)})
    cuts = splits(50, initial=20, assess=3)
    wide = filtered_wide(df, ["a", "b"], "y", "t", KERNELS, ["geo"], ["c"])
    about = means(wide)
    models = {3 * i + j: [i, 3 + j, 6] for i, j in itertools.product(range(3), range(3))}
    got = fits(cross_products(wide.repartition(5), about), about, models, cuts).toPandas()
    assert len(got) == 9 * len(cuts)
    for m, part in got.groupby("candidate"):
        design = designs(rows, (m // 3, m % 3), control=True)
        want = by_hand(design, cuts)
        part = part.sort_values("split")
        assert part["loss"].to_numpy() == pytest.approx([w.sum() for w in want], rel=1e-8)
        assert part["n"].tolist() == [len(w) for w in want]
        period, y, x = (np.array(c) for c in zip(*design, strict=True))
        train = (period <= cuts[0][0]) & np.isfinite(y)
        assert part["coefficients"].iloc[0] == pytest.approx(np.linalg.lstsq(x[train], y[train], rcond=None)[0], rel=1e-6)


def test_regressors_that_others_determine_have_no_part():
    x = np.column_stack([np.ones(9), np.arange(9.0), 2 * np.arange(9.0) + 1, np.arange(9.0) ** 2])
    y = x @ [3, 1, 0, 2]
    v = np.column_stack([x, y])
    beta = least_squares((v.T @ v)[None])[0]
    assert beta[2] == 0 and x @ beta == pytest.approx(y)
    assert least_squares(np.zeros((2, 4, 4))).tolist() == [[0, 0, 0]] * 2


def test_joint_search_equals_the_whole_grid_by_hand(spark):
    df, rows = market(spark)
    cuts = splits(50, initial=25, assess=5, skip=4)
    table = {p: rmse_of(by_hand(designs(rows, p, control=True), cuts)) for p in itertools.product(range(3), range(3))}
    got = tune_carryover_joint(df, ["a", "b"], "y", "t", ["geo"], KERNELS, controls=["c"], initial=25, assess=5, skip=4)
    now, walked = (1, 1), []
    for _ in range(10):
        before = now
        for c in (0, 1):
            now = min((tuple(k if i == c else now[i] for i in (0, 1)) for k in range(3)), key=table.get)
            walked.append(table[now])
        if now == before:
            break
    assert [KERNELS.index(got.best[c]) for c in "ab"] == list(now) and got.converged
    assert got.metric == pytest.approx(table[now], rel=1e-8)
    assert got.history["metric"].tolist() == pytest.approx(walked, rel=1e-8) and got.iterations == len(walked) // 2
    for i, c in enumerate("ab"):
        profile = got.profiles[got.profiles["channel"] == c].sort_values("candidate")["metric"]
        assert profile.tolist() == pytest.approx([table[tuple(k if i == j else now[j] for j in (0, 1))] for k in range(3)], rel=1e-8)
    assert (got.best["a"].decay, got.best["b"].decay) == (0.5, 0.2)
    assert got.best_1se_metric >= got.metric - 1e-9 and all(got.best_1se[c].decay <= got.best[c].decay for c in "ab")
    kept = got.predictions.where("selection = 'best'").toPandas()
    assert math.sqrt(((kept["y"] - kept["predicted"]) ** 2).mean()) == pytest.approx(got.metric, rel=1e-8)


def test_joint_search_starts_where_it_is_told(spark):
    df, _ = market(spark)
    one = tune_carryover_joint(df, ["a", "b"], "y", "t", ["geo"], KERNELS, start={"a": 0.79}, max_iter=1, initial=40, assess=5)
    assert one.history["sweep"].tolist() == [1, 1] and any("not settled" in n for n in one.notices) is not one.converged
    with pytest.raises(ValueError, match="start names no channels"):
        tune_carryover_joint(df, ["a"], "y", "t", ["geo"], KERNELS, start={"z": 0.5})


def any_model():
    """Made here, so that workers get the functions themselves and don't import this module."""

    def least(x, y):
        return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]

    def forecast(beta, x):
        return np.column_stack([np.ones(len(x)), x]) @ beta

    return least, forecast


def test_joint_search_with_any_model_and_metric_equals_its_own(spark):
    df, _ = market(spark)
    least, forecast = any_model()
    how = {"controls": ["c"], "initial": 30, "assess": 5, "skip": 4}
    own = tune_carryover_joint(df, ["a", "b"], "y", "t", ["geo"], KERNELS, **how)
    any_ = tune_carryover_joint(df, ["a", "b"], "y", "t", ["geo"], KERNELS, fit=least, predict=forecast, **how)
    assert any_.best == own.best and any_.best_1se == own.best_1se
    assert any_.profiles[["metric", "std_err", "paired_err"]].to_numpy() == pytest.approx(own.profiles[["metric", "std_err", "paired_err"]].to_numpy(), rel=1e-6, abs=1e-9)
    mae = tune_carryover_joint(df, ["a", "b"], "y", "t", ["geo"], KERNELS, metric="mae", **how)
    called = tune_carryover_joint(df, ["a", "b"], "y", "t", ["geo"], KERNELS, metric_fn=lambda y, p: float(np.abs(y - p).mean()), **how)
    assert called.profiles[["metric", "std_err"]].to_numpy() == pytest.approx(mae.profiles[["metric", "std_err"]].to_numpy(), rel=1e-9)


@pytest.mark.parametrize("aggregate", ["pooled", "mean"])
def test_tuning_with_controls_its_errors_and_pick(spark, aggregate):
    df, rows = market(spark, missing={(0, 30)})
    cuts = splits(50, initial=25, assess=5, skip=4)
    tuned = tune_carryover(df, "a", "y", "t", ["geo"], KERNELS, initial=25, assess=5, skip=4, controls=["c", "b"], aggregate=aggregate)
    own = [[r[0], r[1], r[2], 0.0, r[4], r[5]] for r in rows]
    losses = []
    for k in range(3):
        design = [(p, y, [x[0], x[1], x[3], rows[i][3]]) for i, (p, y, x) in enumerate(designs(own, (k, 0), control=True))]
        losses.append(by_hand(design, cuts))
    score = lambda parts: rmse_of(parts) if aggregate == "pooled" else float(np.mean([rmse_of([x]) for x in parts]))
    theta = np.array([[score([x for i, x in enumerate(part) if i != out]) for out in range(len(cuts))] for part in losses])
    got = tuned.results.sort_values("candidate")
    want = [score(part) for part in losses]
    best = int(np.argmin(want))
    assert got["metric"].tolist() == pytest.approx(want, rel=1e-8)
    assert got["std_err"].tolist() == pytest.approx([jackknife(t) for t in theta], rel=1e-6)
    assert got["paired_err"].tolist() == pytest.approx([jackknife(t - theta[best]) for t in theta], rel=1e-6, abs=1e-9)
    near = [k for k in range(3) if want[k] - want[best] <= jackknife(theta[k] - theta[best]) or k == best]
    assert tuned.best == KERNELS[best] and tuned.best_1se == KERNELS[min(near)]


def test_a_failed_split_counts_for_nobody_and_its_candidate_stays(spark):
    df, _ = market(spark)

    def sometimes(x, y):
        if len(y) == 2 * 40 and x.std() < 35:  # the smoothest candidate's fit on the third window
            raise ValueError("too smooth")
        return np.polyfit(x, y, 1)

    how = {"initial": 30, "assess": 5, "skip": 4}
    tuned = tune_carryover(df, "a", "y", "t", ["geo"], KERNELS, fit=sometimes, predict=np.polyval, **how)
    clean = tune_carryover(df, "a", "y", "t", ["geo"], KERNELS, fit=lambda x, y: np.polyfit(x, y, 1), predict=np.polyval, **how)
    assert np.isfinite(tuned.results["metric"]).all() and (clean.n_splits, clean.n_ok, tuned.n_ok) == (4, 4, 3)
    assert any("1 splits left out" in n and "fit failed: too smooth" in n for n in tuned.notices) and not clean.notices


def test_failures_by_kind(spark):
    df, _ = market(spark, geos=1)
    how = {"initial": 40, "assess": 5, "skip": 4}
    least, _ = any_model()
    with pytest.raises(RuntimeError, match="predict returned 3 values for 5 rows"):
        tune_carryover(df, "a", "y", "t", ["geo"], KERNELS, fit=least, predict=lambda m, x: np.zeros(3), **how)
    with pytest.raises(RuntimeError, match="predict failed: no forecast"):
        tune_carryover(df, "a", "y", "t", ["geo"], KERNELS, fit=least, predict=lambda m, x: (_ for _ in ()).throw(ValueError("no forecast")), **how)
    with pytest.raises(RuntimeError, match="predictions are missing or not finite"):
        tune_carryover(df, "a", "y", "t", ["geo"], KERNELS, fit=least, predict=lambda m, x: np.full(len(x), np.nan), **how)
    with pytest.raises(RuntimeError, match="metric_fn failed: no metric"):
        tune_carryover(df, "a", "y", "t", ["geo"], KERNELS, metric_fn=lambda y, p: (_ for _ in ()).throw(ValueError("no metric")), **how)


def test_repeated_periods_and_missing_media_are_refused(spark):
    df, rows = market(spark, geos=1)
    with pytest.raises(Exception, match="repeats a period"):
        tune_carryover(df.unionByName(df.limit(1)), "a", "y", "t", ["geo"], KERNELS, initial=40)
    with pytest.raises(Exception, match="c has missing or infinite values"):
        tune_carryover(df.selectExpr("geo", "t", "a", "y", "if(t = 3, null, c) AS c"), "a", "y", "t", ["geo"], KERNELS, initial=40, controls=["c"])
    with pytest.raises(ValueError, match="no split has a y"):
        tune_carryover(df.withColumn("y", df["y"] * float("nan")), "a", "y", "t", ["geo"], KERNELS, initial=40)


def test_scoring_is_checked():
    for wrong in ({"metric": "r2"}, {"aggregate": "sum"}, {"se_block": 0}):
        with pytest.raises(ValueError):
            Scoring(**wrong)


@pytest.mark.parametrize("kernel", [Adstock("geometric", 0.8), Adstock("geometric", 0.8, normalise=False), Adstock("geometric", 0.6, 5), Adstock("geometric", 0.9, 2000, normalise=False), Adstock("geometric", 1.0, 4)])
def test_warm_start_in_closed_form_equals_a_long_constant_past(kernel):
    values = np.array([5.0, 1.0, 0.0, 7.0, 3.0])
    window = min(3, math.ceil(math.log(0.1) / math.log(kernel.decay)) if kernel.decay < 1 else 3)
    past = np.full(4000, values[:window].mean())
    assert warmed(kernel, values, values[:3]) == pytest.approx(kernel.run(np.concatenate((past, values)))[len(past) :])
    assert warmed(kernel, values, values[:0]) == pytest.approx(kernel.run(values))


def test_edge_notices():
    tried = [Adstock("geometric", d, lag) for d in (0.0, 0.3, 0.6, 1.0) for lag in (1, 4, 9)]
    assert edge_notices(Adstock("geometric", 0.3, 4), tried) == []
    assert edge_notices(Adstock("geometric", 0.6, 9), tried, "tv: ") == ["tv: max_lag 9 is the largest value tried; try larger ones"]
    assert edge_notices(Adstock("geometric", 0.0, 9), tried) == [] and edge_notices(Adstock("geometric", 1.0, 1), tried) == []
    some = [Adstock("geometric", d) for d in (0.2, 0.4, 0.6)]
    assert edge_notices(some[0], some) == ["decay 0.2 is the smallest value tried; try smaller ones"] and edge_notices(some[0], some[:2]) == []
