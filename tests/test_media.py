"""Carryover, saturation, planning, tuning, resampling, steps and streams against hand-worked or brute-force values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendtrail.functions import decay as vocab
from spendtrail.functions.calendar import fourier_terms
from spendtrail.functions.saturation import curve_inverse, curve_value, saturate
from spendtrail.operators.adstock import Adstock, ChannelSpec, Saturation, adstock, adstock_state, adstock_steady_state
from spendtrail.operators.bootstrap import block_bootstrap, resampled
from spendtrail.operators.diagnose import carry_class, date_audit, diagnose_media, vif
from spendtrail.operators.steps import AdstockStep, Curve, SaturationStep, adstock_channels, parameter_grid
from spendtrail.operators.tuning import cross_validate, filtered, splits, tune_carryover, tune_carryover_joint
from spendtrail.plans.media import allocate_budget, best_split, contributions, marginal_roi, mroi, reallocate, simulate_plan, spend_for
from spendtrail.plans.plot_data import palette
from spendtrail.sources.look_alikes import touchpoints, weekly_panel
from spendtrail.streaming.stateful import run_to_memory, stream_adstock, stream_journeys, stream_sessions


def series(spark, values, geo="g"):
    return spark.createDataFrame([(geo, i, float(v)) for i, v in enumerate(values)], "geo string, t int, x double")


def run(df, kernel, **kw):
    return [r.a for r in adstock(df, {"a": ("x", kernel)}, "t", ["geo"], **kw).orderBy("geo", "t").collect()]


@pytest.mark.parametrize(
    "values,kernel,expected",
    [
        ((100, 0, 0, 0, 100), Adstock("geometric", 0.5, normalise=False), (100, 50, 25, 12.5, 106.25)),
        ((100, 0, 0, 0, 100), Adstock("geometric", 0.5, normalise=True), (50, 25, 12.5, 6.25, 53.125)),
        ((100, 100, 0, 0), Adstock("geometric", 0.6, normalise=False), (100, 160, 96, 57.6)),
        ((100, 0, 0, 0), Adstock("geometric", 0.5, 2, normalise=False), (100, 50, 0, 0)),
        ((100, 0, 0, 0), Adstock("geometric", 0.5, 2, normalise=True), (100 / 1.5, 50 / 1.5, 0, 0)),
        ((100, 0, 0, 0, 0), Adstock("filter", weights=(0.2, 0.5, 0.3), normalise=False), (20, 50, 30, 0, 0)),
    ],
)
def test_golden_filters(spark, values, kernel, expected):
    assert run(series(spark, values), kernel) == pytest.approx(expected)


def test_kernels():
    assert vocab.weibull_weights(8, 2, 3, normalise=True) == pytest.approx([0.3680, 0.3293, 0.2111, 0.0777, 0.0131, 0.0008, 0, 0], abs=6e-5)
    assert vocab.decay_from_half_life(3) == pytest.approx(0.7937, abs=1e-4)
    assert vocab.effective_window(vocab.decay_from_half_life(3), 0.5) == 3
    assert vocab.half_life(0.5) == 1 and vocab.effective_window(0) == 1
    assert vocab.geometric_weights(2**31 - 1, 0.5, reach=3).tolist() == [1, 0.5, 0.25]
    for bad in (lambda: vocab.half_life(1), lambda: vocab.effective_window(0.5, 1), lambda: Adstock("delayed", 0.5, normalise=False), lambda: Adstock("filter", normalise=False)):
        with pytest.raises(ValueError):
            bad()


LONG = Adstock("filter", weights=tuple(0.9**i for i in range(80)), normalise=False)


@pytest.mark.parametrize("kernel", [Adstock("geometric", 0.7, normalise=False), Adstock("geometric", 0.7, 5, normalise=False), Adstock("weibull", max_lag=6, shape=2, scale=2, normalise=False), LONG])
def test_chunks_with_state_equal_the_whole(spark, kernel):
    rng = np.random.default_rng(1)
    df = series(spark, rng.uniform(0, 9, 40)).unionByName(series(spark, rng.uniform(0, 9, 40), "h"))
    whole = adstock(df, {"a": ("x", kernel)}, "t", ["geo"]).orderBy("geo", "t").toPandas()["a"].to_numpy()
    state, parts = None, []
    for low, high in ((0, 3), (3, 20), (20, 40)):
        part = df.where((F.col("t") >= low) & (F.col("t") < high))
        parts.append(adstock(part, {"a": ("x", kernel)}, "t", ["geo"], state=state))
        state = adstock_state(part, {"x": kernel}, "t", ["geo"], state=state)
    cut = parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("geo", "t").toPandas()["a"].to_numpy()
    assert cut == pytest.approx(whole)


def test_steady_state_is_a_fixed_point(spark):
    df = series(spark, [10.0] * 12)
    for kernel, level in ((Adstock("geometric", 0.5, normalise=False), 20.0), (Adstock("geometric", 0.5, normalise=True), 10.0), (Adstock("filter", weights=(0.5, 0.25, 0.25), normalise=False), 10.0)):
        seed = adstock_steady_state(df, "x", kernel, "t", ["geo"])
        assert run(df, kernel, state=seed) == pytest.approx([level] * 12)


def test_missing_media(spark):
    df = spark.createDataFrame([("g", 0, 4.0), ("g", 1, None), ("g", 2, 0.0)], "geo string, t int, x double")
    with pytest.raises(Exception, match="missing"):
        run(df, Adstock("geometric", 0.5, normalise=False))
    assert run(df, Adstock("geometric", 0.5, normalise=False), na_action="zero") == [4, 2, 1]


def test_saturation(spark):
    df = spark.createDataFrame([(0.0,), (50.0,), (1e300,), (None,)], "x double")
    got = [r[0] for r in df.select(saturate(F.col("x"), "hill", half_max=50, shape=2)).collect()]
    assert got == [0.0, 0.5, 1.0, None]
    with pytest.raises(Exception, match="non-negative"):
        spark.createDataFrame([(-1.0,)], "x double").select(saturate(F.col("x"), "power", exponent=0.5)).collect()
    for kind, p in (("hill", {"half_max": 5.0, "shape": 1.7}), ("exponential", {"rate": 0.3}), ("michaelis_menten", {"km": 4.0, "vmax": 3.0}), ("power", {"exponent": 0.4})):
        assert curve_inverse(curve_value(2.5, kind, **p), kind, **p) == pytest.approx(2.5)
    assert spend_for(200.0, 100.0, "hill", half_max=5.0) is None
    assert mroi(0.0, 2.0, "michaelis_menten", km=100.0) == pytest.approx(0.02, rel=1e-3)


def toy(spark):
    rows = [(t, 100 + 40 * math.sin(t / 2), 60 * (1 + math.cos(t / 3)), 30 + 20 * (t % 4 == 0)) for t in range(1, 31)]
    return spark.createDataFrame([(a, float(b), float(c), float(d)) for a, b, c, d in rows], "week int, a double, b double, c double")


SPEC = {n: ChannelSpec(Adstock("geometric", d, normalise=False), Saturation("hill", {"half_max": h})) for n, d, h in (("a", 0.6, 80.0), ("b", 0.3, 50.0), ("c", 0.1, 40.0))}
COEF = {"a": 50.0, "b": 40.0, "c": 30.0}


def response(x, spec, coefficient):
    held = spec.adstock.run(np.asarray(x, float))
    return coefficient * sum(curve_value(v, "hill", **spec.saturation.parameters) for v in held)


def test_plans(spark):
    plan = toy(spark)
    x = plan.orderBy("week").toPandas()
    got = {r.channel: r for r in simulate_plan(plan, SPEC, COEF, "week").collect()}
    assert all(got[c].contribution == pytest.approx(response(x[c], SPEC[c], COEF[c])) for c in SPEC)
    marginal = {r.channel: r for r in marginal_roi(plan, SPEC, COEF, "week", lift=0.1).collect()}
    want = (response(x["a"] * 1.1, SPEC["a"], 50) - response(x["a"], SPEC["a"], 50)) / (0.1 * x["a"].sum())
    assert marginal["a"].mroi == pytest.approx(want)
    moved = reallocate(plan, "a", "b", 300.0).toPandas()
    assert moved["a"].sum() == pytest.approx(x["a"].sum() - 300) and moved["b"].sum() == pytest.approx(x["b"].sum() + 300)
    with pytest.raises(Exception, match="more than"):
        reallocate(plan, "a", "b", 1e6).collect()
    parts = contributions(plan, {"a": 2.0, "b": -1.0}, "week", intercept=5.0).groupBy("period").agg(F.sum("contribution").alias("s")).orderBy("period").toPandas()
    assert parts["s"].to_numpy() == pytest.approx((5 + 2 * x["a"] - x["b"]).to_numpy())


def test_allocation_is_the_best_of_all_splits(spark):
    steps = 12
    got = allocate_budget(toy(spark), SPEC, COEF, "week", steps=steps)
    x = toy(spark).orderBy("week").toPandas()
    total = sum(x[c].sum() for c in SPEC)

    def value(split):
        return sum(response(x[c] * (k * total / steps / x[c].sum()), SPEC[c], COEF[c]) for c, k in zip(SPEC, split, strict=True))

    best = max((s for s in itertools.product(range(steps + 1), repeat=3) if sum(s) == steps), key=value)
    spend = {r.channel: r.recommended_spend for r in got.table.collect()}
    assert [spend[c] for c in SPEC] == pytest.approx([k * total / steps for k in best])
    assert sum(spend.values()) == pytest.approx(total)
    with pytest.raises(ValueError):
        allocate_budget(toy(spark), SPEC, COEF, "week", upper={"a": 1.0, "b": 1.0, "c": 1.0})
    assert best_split([np.array([0, 1.0]), np.array([0, 1.0])], 5) is None


def test_tuning_recovers_the_decay(spark):
    rng = np.random.default_rng(2)
    x = rng.gamma(1, 50, 80) * (rng.random(80) > 0.4)
    y = 20 + 3 * Adstock("geometric", 0.6, normalise=False).run(x) + rng.normal(0, 1, 80)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "t int, x double, y double")
    grid = [Adstock("geometric", d, normalise=False) for d in (0.0, 0.3, 0.6, 0.9)]
    tuned = tune_carryover(df, "x", "y", "t", candidates=grid)
    assert tuned.best.decay == 0.6 and tuned.best_1se.decay <= 0.6
    rows, cuts = filtered(df, "x", "y", "t", grid), splits(80)
    general = cross_validate(rows, cuts, lambda z, g: np.polyfit(z, g, 1), lambda m, z: np.polyval(m, z)).where("candidate = 2").toPandas()
    fast = tuned.predictions.where("candidate = 2").toPandas()
    both = general.merge(fast, on=["split", "period"])
    assert both["predicted_x"].to_numpy() == pytest.approx(both["predicted_y"].to_numpy(), abs=1e-6)
    failed = cross_validate(rows.where("candidate = 0"), cuts[:1], lambda z, g: 1 / 0, lambda m, z: z).first()
    assert failed.failure == "fit failed: division by zero"


def test_joint_tuning(spark):
    rng = np.random.default_rng(3)
    a, b = rng.gamma(1, 50, 60), rng.gamma(1, 50, 60)
    y = 3 * Adstock("geometric", 0.6, normalise=False).run(a) + 2 * Adstock("geometric", 0.2, normalise=False).run(b) + rng.normal(0, 1, 60)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(a, b, y, strict=True))], "t int, a double, b double, y double")
    grid = [Adstock("geometric", d, normalise=False) for d in (0.2, 0.6, 0.8)]
    got = tune_carryover_joint(df, ["a", "b"], "y", "t", candidates=grid)
    assert (got.best["a"].decay, got.best["b"].decay) == (0.6, 0.2) and got.converged


def test_bootstrap(spark):
    df = series(spark, np.arange(20.0)).unionByName(series(spark, np.arange(20.0), "h"))
    rows = resampled(df, "t", times=5, block_length=4, by=["geo"]).toPandas()
    assert (rows.groupby(["replicate", "geo"]).size() == 20).all()
    g, h = (rows[rows.geo == k].sort_values(["replicate", "_pos"])["x"].to_numpy() for k in ("g", "h"))
    assert (g == h).all()  # groups share their periods
    blocks = g.reshape(5, 5, 4)
    assert (np.diff(blocks, axis=2) == 1).all()
    one, _ = block_bootstrap(df.repartition(1), lambda d: {"mean": d.x.mean()}, "t", times=40, by=["geo"])
    many, _ = block_bootstrap(df.repartition(8), lambda d: {"mean": d.x.mean()}, "t", times=40, by=["geo"])
    a, b = one.first(), many.first()
    assert a == b and a.estimate == 9.5 and a.lower < 9.5 < a.upper


def test_diagnostics(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(10, 2, 60)
    df = spark.createDataFrame([(i, float(v), float(2 * v), float(rng.normal(5, 1))) for i, v in enumerate(a)], "t int, a double, b double, c double")
    got = {r.channel: r.vif for r in vif(df, ["a", "b", "c"]).collect()}
    assert math.isinf(got["a"]) and got["c"] < 2
    flags = diagnose_media(df, ["a", "b", "c"], date="t").flags()
    assert any("a is collinear" in f for f in flags)
    gaps = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0), (3, 5.0), (4, 4.0)], "row int, t double")
    got = date_audit(gaps, "t", row_order="row").first()
    assert (got.out_of_order, got.duplicated, got.missing) == (1, 1, 1)
    old = spark.createDataFrame([("g", float(i)) for i in range(5)], "geo string, t double")
    for start, kind in ((3.0, "overlap"), (5.0, "contiguous"), (4.5, "misaligned"), (9.0, "gap")):
        new = spark.createDataFrame([("g", start), ("z", start)], "geo string, t double")
        assert {r.geo: r.carry for r in carry_class(old, new, "t", ["geo"]).collect()} == {"g": kind, "z": "unseen"}


def test_steps_continue_series(spark):
    df = series(spark, range(1, 21))
    kernels = {"x": Adstock("geometric", 0.5, normalise=False)}
    whole = run(df, kernels["x"])
    train, new = df.where("t < 12"), df.where("t >= 12")
    got = [r.adstock_x for r in AdstockStep(kernels, "t", ["geo"]).fit(train).transform(new).orderBy("t").collect()]
    assert got == pytest.approx(whole[12:])
    cold = AdstockStep(kernels, "t", ["geo"], carry_over="cold").fit(train).transform(new).orderBy("t").first()
    assert cold.adstock_x == 13
    after_gap = AdstockStep(kernels, "t", ["geo"]).fit(train).transform(df.where("t >= 15")).orderBy("t").first()
    assert after_gap.adstock_x == 16
    assert adstock_channels(kernels, "t", ["geo"]).fit(train).transform(new).count() == 8
    sat = SaturationStep({"x": Curve("hill", 0.5)}, ["geo"]).fit(df)
    assert [r.x for r in sat.transform(series(spark, [10.0], "unseen")).collect()] == [0.5]
    assert parameter_grid("max_lag", 3) == [1, 14, 26] and len(palette(8)) == 8
    with pytest.raises(ValueError):
        palette(9)


def test_look_alikes(spark):
    log = touchpoints(spark, 100)
    assert log.where("conversion = 0 and value is not null").count() == 0 and log.where("channel is null").count() > 0
    assert weekly_panel(spark, 20).groupBy("geo").count().collect()[0]["count"] == 20
    terms = fourier_terms(spark.createDataFrame([(13,)], "i int"), "i", 1, cycle=52).first()
    assert terms.fourier_sin1 == pytest.approx(1)


def test_streamed_filter_equals_batch(spark, tmp_path):
    df = series(spark, range(1, 13)).unionByName(series(spark, range(12, 0, -1), "h"))
    for i, (low, high) in enumerate(((0, 5), (5, 6), (6, 12))):
        df.where((F.col("t") >= low) & (F.col("t") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_to_memory(stream_adstock(source, "geo", "t", "x", 0.5), "streamed").where("not late").orderBy("series", "t").toPandas()["value"].to_numpy()
    assert got == pytest.approx(np.array(run(df, Adstock("geometric", 0.5, normalise=False))))


def test_streamed_journeys_and_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 0.0, 0), ("a", "y", 1.0, 1), ("a", "z", 2.0, 0), ("a", "w", 3.0, 1)], "id string, ch string, t double, conv int")
    for low in (0, 2):
        rows.where((F.col("t") >= low) & (F.col("t") < low + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_to_memory(stream_journeys(source, "id", "ch", "t", "conv"), "journeys").orderBy("path_id").collect()
    assert [(r.path_id, r.path) for r in got] == [("a#1", "x > y"), ("a#2", "z > w")]
    timed = rows.select("id", "ch", F.timestamp_seconds((F.col("t") * F.when(F.col("t") < 2, 10).otherwise(100)).cast("long")).alias("ts"))
    assert sorted(r.touches for r in stream_sessions(timed, "id", "ts", "15 seconds", "1 minute", "ch").collect()) == [1, 1, 2]


def tuned_rows(spark, n=60):
    rng = np.random.default_rng(31)
    x, c = rng.gamma(2, 50, n), rng.normal(0, 1, n)
    y = 20 + 3 * Adstock("geometric", 0.6).run(x) + 40 * c + rng.normal(0, 1, n)
    return spark.createDataFrame([(i, float(x[i]), float(c[i]), float(y[i])) for i in range(n)], "t int, x double, c double, y double"), x, c, y


def test_tuning_with_controls_equals_least_squares_by_hand(spark):
    df, x, c, y = tuned_rows(spark)
    kernels = [Adstock("geometric", d) for d in (0.2, 0.4, 0.6, 0.8)]
    tuned = tune_carryover(df, "x", "y", "t", candidates=kernels, initial=30, assess=5, skip=4, controls=["c"])
    want = []
    for k in kernels:
        z, off = k.run(x), []
        for a in range(30, 56, 5):
            design = np.column_stack([np.ones(60), z, c])
            beta = np.linalg.lstsq(design[:a], y[:a], rcond=None)[0]
            off += (design[a : a + 5] @ beta - y[a : a + 5]).tolist()
        want.append(float(np.sqrt(np.mean(np.square(off)))))
    got = tuned.results.sort_values("candidate")["metric"].tolist()
    assert got == pytest.approx(want) and tuned.best.decay == 0.6 and tuned.notices == []


def test_tuning_with_any_model_metric_and_failures(spark):
    df, x, c, y = tuned_rows(spark)
    kernels = [Adstock("geometric", d) for d in (0.6, 0.7, 0.8)]

    def failing(z, goal):
        raise ValueError("no")

    tuned = tune_carryover(df, "x", "y", "t", candidates=kernels, initial=40, fit=lambda z, goal: np.polyfit(z, goal, 1), predict=np.polyval, metric_fn=lambda a, b: float(np.median(np.abs(a - b))))
    assert np.isfinite(tuned.results["std_err"]).all()
    if tuned.best.decay == 0.6:
        assert tuned.notices == ["decay 0.6 is the smallest value tried; try smaller ones"]
    with pytest.raises(RuntimeError, match="every candidate failed: fit failed: no"):
        tune_carryover(df, "x", "y", "t", candidates=kernels, initial=40, fit=failing, predict=np.polyval)
    with pytest.raises(ValueError):
        tune_carryover(df, "x", "y", "t", candidates=kernels, fit=failing)


def test_warm_start_takes_the_level_before_the_series(spark):
    from spendtrail.operators.tuning import filtered, grid

    df = spark.createDataFrame([(i, 10.0, 1.0) for i in range(20)], "t int, x double, y double")
    kernels = [Adstock("geometric", 0.5), Adstock("geometric", 0.5, 4), Adstock("geometric", 0.0)]
    got = {(r.candidate, r.period): r.z for r in filtered(df, "x", "y", "t", kernels, warm_until=8).collect()}
    assert all(z == pytest.approx(10.0) for z in got.values())
    cold = {(r.candidate, r.period): r.z for r in filtered(df, "x", "y", "t", kernels).collect()}
    assert cold[0, 1] == pytest.approx(5.0)
    with pytest.raises(ValueError):
        grid(decays=(0.2, 0.2))
