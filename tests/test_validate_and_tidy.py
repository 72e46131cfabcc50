"""Checks of arguments, and results as plain tables."""

import numpy as np
import pytest

from spendtrail.operators.adstock import Adstock, ChannelSpec, Saturation, adstock
from spendtrail.operators.bootstrap import block_bootstrap
from spendtrail.operators.diagnose import diagnose_media
from spendtrail.operators.steps import AdstockStep, Curve, SaturationStep
from spendtrail.operators.tuning import splits, tune_carryover, tune_carryover_joint
from spendtrail.plans.media import allocate_budget, contributions, roi, unmatched_channels
from spendtrail.plans.plot_data import INK, ink
from spendtrail.plans.tidy import tidy
from spendtrail.validate import require_columns, require_distinct, require_number


@pytest.fixture(scope="module")
def weeks(spark):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([("g", i, *map(float, rng.gamma(2, 40, 3)), "x") for i in range(40)], "geo string, t int, a double, b double, y double, word string").persist()


def test_columns_and_numbers(spark, weeks):
    require_columns(weeks, ["geo"], numeric=["a", "t"])
    for call, why in (
        (lambda: require_columns(weeks, ["geo", "gone"]), "the table lacks the columns gone; it has geo, t"),
        (lambda: require_columns(weeks, [], "the spend", numeric=["word"]), r"columns of the spend must be numeric: word \(string\)"),
        (lambda: require_columns(weeks.select("a", "a"), ["a"]), "more than one column named a"),
        (lambda: require_distinct(["a", "b", "a"], "media"), "media name these more than once: a"),
        (lambda: require_number(True, "steps"), "steps must be a finite number"),
        (lambda: require_number(float("nan"), "steps"), "steps must be a finite number"),
        (lambda: require_number(1.5, "steps", whole=True), "steps must be a whole number"),
        (lambda: require_number(0, "steps", 1, 9), "steps must be from 1 to 9, not 0"),
        (lambda: adstock(weeks, {"z": ("word", Adstock("geometric", 0.5))}, "t"), "must be numeric: word"),
        (lambda: adstock(weeks, {"z": ("a", Adstock("geometric", 0.5))}, "week"), "lacks the columns week"),
        (lambda: tune_carryover(weeks, "a", "word", "t"), "must be numeric: word"),
        (lambda: tune_carryover_joint(weeks, ["a", "a"], "y", "t"), "media and controls name these more than once: a"),
        (lambda: splits(40, initial=1), "initial must be from 2"),
        (lambda: splits(40, assess=0), "assess must be from 1"),
        (lambda: diagnose_media(weeks, ["a", "a"]), "media name these more than once"),
        (lambda: diagnose_media(weeks, ["a"], date="day"), "lacks the columns day"),
        (lambda: AdstockStep({"t": Adstock()}, "t"), "can't be channels"),
        (lambda: AdstockStep({"word": Adstock()}, "t").fit(weeks), "must be numeric: word"),
        (lambda: SaturationStep({"word": Curve()}).fit(weeks), "must be numeric: word"),
        (lambda: roi(weeks, weeks, "t"), "the contributions lacks the columns period, channel"),
        (lambda: block_bootstrap(weeks, lambda d: {}, "t", times=0), "times must be from 1"),
        (lambda: ink("paper"), "role is one of surface"),
    ):
        with pytest.raises(ValueError, match=why):
            call()
    assert len({ink(r) for r in INK}) == len(INK)


def test_unmatched_channels(spark, weeks):
    made = contributions(weeks.select("geo", "t", "a", "b"), {"a": 1.0, "b": 2.0}, "t", ["geo"], intercept=3.0)
    got = {(r.channel, r.missing) for r in unmatched_channels(made, weeks.select("geo", "t", "b", "y"), "t", ["geo"]).collect()}
    assert got == {("a", "spend"), ("y", "contribution")}
    assert unmatched_channels(made, weeks.select("geo", "t", "a", "b"), "t", ["geo"]).count() == 0


def test_curves_name_their_own_parameters():
    step = SaturationStep({"a": Curve("hill"), "b": Curve("power"), "c": Curve("exponential")})
    assert list(step.tunable()) == ["a.half_max", "a.shape", "b.exponent", "c.half_max"]


def test_results_as_tables(spark, weeks):
    kernels = [Adstock("geometric", d) for d in (0.2, 0.5, 0.8)]
    one = tidy(tune_carryover(weeks, "a", "y", "t", candidates=kernels, initial=30))
    assert one["best"].sum() == one["best_1se"].sum() == 1 and len(one) == 3
    both = tidy(tune_carryover_joint(weeks, ["a", "b"], "y", "t", candidates=kernels, initial=34))
    assert both.groupby("channel")[["best", "best_1se"]].sum().to_numpy().tolist() == [[1, 1], [1, 1]]
    spec = {c: ChannelSpec(Adstock("geometric", 0.5), Saturation("hill", {"half_max": 50.0})) for c in "ab"}
    moved = tidy(allocate_budget(weeks.select("geo", "t", "a", "b"), spec, {"a": 10.0, "b": 9.0}, "t", by=["geo"], steps=10)).collect()
    assert all(r.spend_change == pytest.approx(r.recommended_spend - r.current_spend) for r in moved) and {r.channel for r in moved} == {"a", "b"}
    seen = tidy(diagnose_media(weeks, ["a", "b", "y"])).collect()
    assert all(r.vif >= 1 and abs(r.r) <= 1 and r.mean > 0 for r in seen) and len(seen) == 3
    step = tidy(AdstockStep({"a": kernels[0], "b": Adstock("weibull", max_lag=4, shape=2.0, scale=2.0)}, "t").fit(weeks))
    assert step["kind"].tolist() == ["geometric", "weibull"] and step["decay"].isna().tolist() == [False, True]
    level = tidy(SaturationStep({"a": Curve("hill", 0.4)}).fit(weeks))
    assert level["reference"].iloc[0] == pytest.approx(max(r.a for r in weeks.collect()))
    with pytest.raises(TypeError, match="nothing tidy"):
        tidy(3)
