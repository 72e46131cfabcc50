"""Fitted models in contributions, share replicates, the made log, diagnosis after carryover, inferred periods, allocation."""

import datetime as dt
import itertools
import warnings

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import functions as F

from spendtrail.functions.calendar import holiday_flags, steps_of
from spendtrail.functions.decay import decay_column, decay_from_half_life, effective_window, effective_window_column, half_life_column
from spendtrail.operators.adstock import Adstock, ChannelSpec, Saturation, adstock, carried_by_lag
from spendtrail.operators.attribution import poisson_draws, replicate_sums, share_intervals, share_replicates
from spendtrail.operators.diagnose import correlations, diagnose_media, vif
from spendtrail.operators.journeys import build_paths
from spendtrail.operators.markov import transition_counts
from spendtrail.plans.media import Responses, allocate_budget, contributions, fitted, spend_for, spend_for_column
from spendtrail.sources.hyper import from_theta_alpha_gamma
from spendtrail.sources.look_alikes import CLOSING, OPENING, touchpoints, weekly_panel

# contributions of fitted models


def sales(spark, n=60):
    rng = np.random.default_rng(3)
    tv, search, price = rng.gamma(2, 50, n), rng.gamma(2, 30, n), rng.normal(10, 1, n)
    y = 500 + 2 * tv + 3 * search - 20 * price + rng.normal(0, 1, n)
    return spark.createDataFrame([(i, float(tv[i]), float(search[i]), float(price[i]), float(y[i])) for i in range(n)], "week int, tv double, `paid search` double, price double, y double")


def test_contributions_of_rows_the_model_never_saw_sum_to_its_prediction(spark):
    df = sales(spark)
    names = ["tv", "paid search", "price"]
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), LinearRegression(featuresCol="x", labelCol="y")]).fit(df.where("week < 40"))
    late = df.where("week >= 40")
    got = contributions(late.select("week", "tv", "paid search"), model, "week", newdata=late)
    sums = {r.period: r.s for r in got.groupBy("period").agg(F.sum("contribution").alias("s")).collect()}
    assert sums == pytest.approx({r.week: r.prediction for r in model.transform(late).collect()})
    assert {r.channel for r in got.select("channel").distinct().collect()} == {"tv", "paid search", "(baseline)"}
    whole = contributions(late.select("week", *names), model, "week")  # all of the model's columns: its intercept is the baseline
    base = {r.contribution for r in whole.where("channel = '(baseline)'").collect()}
    assert list(base) == [pytest.approx(model.stages[-1].intercept)]
    bare = model.stages[-1]
    assert fitted(bare, names) == fitted(model)
    for wrong, why in (({"model": bare}, "features must name"), ({"model": bare, "features": ["tv"]}, "features must name"), ({"model": object()}, "no coefficients are known")):
        with pytest.raises((ValueError, TypeError), match=why):
            contributions(late, index="week", **wrong)
    with pytest.raises(ValueError, match="give newdata with price"):
        contributions(late.select("week", "tv", "paid search"), model, "week")
    with pytest.raises(ValueError, match="newdata lacks price"):
        contributions(late.select("week", "tv"), model, "week", newdata=late.drop("price"))


def test_newdata_is_checked_row_by_row(spark):
    df = sales(spark)
    model = Pipeline(stages=[VectorAssembler(inputCols=["tv", "price"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="y")]).fit(df)
    media = df.select("week", "tv")
    with pytest.raises(Exception, match="newdata lacks a row"):
        contributions(media, model, "week", newdata=df.where("week > 0")).collect()
    with pytest.raises(Exception, match="different values of tv"):
        contributions(media, model, "week", newdata=df.withColumn("tv", F.when(F.col("week") == 7, 0.5).otherwise(F.col("tv")))).collect()


def test_mappings_of_coefficients(spark):
    df = sales(spark)
    got = contributions(df, {"(Intercept)": 5, "`paid search`": 2, "gone": 9}, "week").where("period = 3").collect()
    search = df.where("week = 3").first()["paid search"]
    assert {r.channel: r.contribution for r in got} == {"paid search": pytest.approx(2 * search), "(baseline)": 5.0}
    with pytest.raises(ValueError, match="newdata needs a fitted model"):
        contributions(df, {"tv": 1.0}, "week", newdata=df)
    with pytest.raises(ValueError, match="no column"):
        contributions(df, {"radio": 1.0}, "week", intercept=0)
    with pytest.raises(ValueError, match="others determine them: tv"):
        contributions(df, {"tv": float("nan")}, "week", intercept=0)
    with pytest.raises(ValueError, match="intercept or a prediction"):
        contributions(df, {"tv": 1.0}, "week")


def test_a_link_is_told(spark):
    df = sales(spark).withColumn("y", F.round(F.col("y") / 100))
    stages = [VectorAssembler(inputCols=["tv", "price"], outputCol="x"), GeneralizedLinearRegression(featuresCol="x", labelCol="y", family="poisson", linkPredictionCol="eta")]
    model = Pipeline(stages=stages).fit(df)
    with pytest.warns(UserWarning, match="log link"):
        got = contributions(df.select("week", "tv"), model, "week", newdata=df)
    sums = {r.period: r.s for r in got.groupBy("period").agg(F.sum("contribution").alias("s")).collect()}
    assert sums == pytest.approx({r.week: r.eta for r in model.transform(df).collect()})
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert fitted({"tv": 1.0}).link == "identity"


# share replicates


def journeys(spark, n=200, seed=8):
    rng = np.random.default_rng(seed)
    rows = [(f"c{i}", f"ch{rng.integers(3)}", float(k), int(k == 2 and rng.random() < 0.6), f"s{i % 2}") for i in range(n) for k in range(rng.integers(1, 4))]
    return build_paths(spark.createDataFrame(rows, "id string, ch string, t double, won int, seg string"), "id", "ch", "t", "won", keep=["seg"])


def test_draws_are_poisson_and_fixed():
    draws = poisson_draws(np.arange(5000, dtype=np.int64), 40)
    assert draws.shape == (5000, 40) and abs(draws.mean() - 1) < 0.01 and abs(draws.var() - 1) < 0.02
    assert (poisson_draws(np.arange(10, dtype=np.int64), 5) == draws[:10, :5]).all()
    assert abs(np.corrcoef(draws[:, 0], draws[:, 1])[0, 1]) < 0.05


def test_replicate_sums_equal_journeys_drawn_one_by_one(spark):
    paths = journeys(spark)
    moves = transition_counts(paths, ["path_id"]).withColumnRenamed("n", "amount")
    got = {(r.source, r.target, r.ends, r.replicate): r.total for r in replicate_sums(moves.repartition(7), ["source", "target", "ends"], 6, seed=3).collect()}
    rows = moves.withColumn("h", F.xxhash64("path_id", F.lit(3))).collect()
    want = dict.fromkeys(got, 0.0)
    for r in rows:
        for i, times in enumerate(poisson_draws(np.array([r.h]), 6)[0]):
            want[r.source, r.target, r.ends, i + 1] += float(times * r.amount)
    assert got == pytest.approx(want) and {k[3] for k in got} == {1, 2, 3, 4, 5, 6}


def test_share_replicates_sum_to_one_and_shuffle_no_touches_by_replicates(spark):
    paths = journeys(spark)
    made = share_replicates(paths, ["linear", "markov"], by=["seg"], times=30)
    sums = made.groupBy("seg", "replicate", "rule").agg(F.sum("share").alias("s")).collect()
    assert len(sums) == 2 * 30 * 2 and all(r.s == pytest.approx(1) for r in sums)
    bounds = share_intervals(paths, ["markov"], times=200).collect()
    assert all(0 < r.lower < r.upper < 1 for r in bounds)
    plan = made._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("lead(") :] if "lead(" in plan else plan
    assert "explode(sequence" not in window  # journeys are not copied before their moves are counted


# the made log


def test_the_log_is_the_same_however_it_is_cut_and_blends_openers_into_closers(spark):
    log = touchpoints(spark, 4000, seed=2)
    again = touchpoints(spark, 4000, seed=2).repartition(3)
    mark = lambda df: df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.count("*")).first()
    assert mark(log) == mark(again) and mark(log) != mark(touchpoints(spark, 4000, seed=3))
    assert "LocalTableScan" not in (plan := log._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan and "Range" in plan
    n = log.count()
    assert 0.93 < n / (4000 * 20799 / 5400) < 1.07
    assert log.where("conversion = 1 and (value is null or value <= 0)").count() == 0 and log.where("conversion = 0 and value is not null").count() == 0
    assert 0 < log.where("channel is null").count() < 0.05 * n and n > log.distinct().count()
    paths = build_paths(log, "customer_id", "channel", "timestamp", "conversion", split_on=("gap",), gap=18, dedupe=True)
    ends = paths.df.where("touch_n > 2").groupBy("channel").agg(F.count_if(F.col("touch_rank") == 1).alias("first"), F.count_if(F.col("touch_rank") == F.col("touch_n")).alias("last")).collect()
    for r in ends:
        if r.channel in OPENING and abs(OPENING[r.channel] - CLOSING[r.channel]) > 0.1:
            assert (r["first"] > r["last"]) == (OPENING[r.channel] > CLOSING[r.channel])
    wins = log.where("conversion = 1").distinct().groupBy("customer_id").count().groupBy("count").count().collect()
    share = {r[0]: r[1] / 4000 for r in wins}
    assert share[1] == pytest.approx(0.28, abs=0.03) and share[2] == pytest.approx(0.07, abs=0.015) and set(share) == {1, 2, 3}


# diagnosis


def spending(spark, n=80, seed=6):
    rng = np.random.default_rng(seed)
    a = rng.gamma(2, 50, n)
    b = np.array(Adstock("geometric", 0.8).run(a)) + rng.normal(0, 2, n)  # what a leaves behind, which plain spend doesn't show
    c, flat = rng.gamma(2, 20, n), 100 + rng.normal(0, 1, n)
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), float(flat[i]), None, 0.0 if i % 5 else 9.0, 1000.0) for i in range(n)]
    rows[7] = (*rows[7][:7], 10.0)  # a hundredth of the impressions
    return spark.createDataFrame(rows, "t int, a double, b double, c double, flat double, dead double, dark double, seen double")


def test_diagnosis_after_carryover(spark):
    df = spending(spark)
    plain = {r.channel: r.vif for r in diagnose_media(df, ["a", "b", "c"], date="t").collinearity.collect()}
    found = diagnose_media(df, ["a", "b", "c"], date="t", decay={"a": 0.8})
    carried = {r.channel: r.vif for r in found.collinearity.collect()}
    assert plain["a"] < 3 and carried["a"] > 20 and carried["c"] < 2
    by_hand = np.column_stack([Adstock("geometric", 0.8).run(np.array([r.a for r in df.orderBy("t").collect()])), [r.b for r in df.orderBy("t").collect()], [r.c for r in df.orderBy("t").collect()]])
    assert [carried[x] for x in "abc"] == pytest.approx(np.diag(np.linalg.inv(np.corrcoef(by_hand.T))))
    flags = found.flags(correlation_threshold=0.9)
    assert any(f.startswith("a goes with b") for f in flags) and any("a is collinear" in f for f in flags)
    with pytest.raises(ValueError, match="decay names no channels"):
        diagnose_media(df, ["a"], decay={"z": 0.5}, date="t")
    with pytest.raises(ValueError, match="decay needs date"):
        diagnose_media(df, ["a"], decay=0.5)


def test_flags_of_every_kind(spark):
    df = spending(spark)
    flags = diagnose_media(df, ["a", "flat", "dead", "dark"], date="t", spend="a", impressions="seen").flags()
    assert any("flat hardly varies" in f for f in flags) and any("dead has no usable values" in f for f in flags) and any("dark is mostly zero" in f for f in flags)
    assert any("odd cost per thousand" in f for f in flags)
    lone = diagnose_media(df.withColumns({"x": F.lit(1.0), "y": F.lit(2.0)}), ["x", "y"])
    assert any("could not be assessed" in f for f in lone.flags())
    assert diagnose_media(df, ["a"]).correlations is None


def test_vif_and_correlations_of_three(spark):
    df = spending(spark)
    x = np.array([(r.a, r.b, r.c) for r in df.collect()])
    got = {r.channel: r.vif for r in vif(df, ["a", "b", "c"]).collect()}
    r = np.corrcoef(x.T)
    assert [got[k] for k in "abc"] == pytest.approx(np.diag(np.linalg.inv(r)))
    strongest = {q.channel: (q.partner, q.r) for q in correlations(df, ["a", "b", "c"]).collect()}
    assert strongest["a"] == ("b", pytest.approx(r[0, 1]))


# inferred periods


def test_holidays_with_an_inferred_period(spark):
    months = [dt.date(2024, m, 1) for m in range(1, 13)]
    df = spark.createDataFrame([(d,) for d in months for _ in range(2)], "d date")
    assert tuple(steps_of(df, "d").first()) == (31.0, 5)  # five months are shorter than their median
    flags = holiday_flags(df, "d", {"x": [dt.date(2024, 3, 31), dt.date(2024, 7, 4)], "none": []}).distinct().orderBy("d").collect()
    assert [r.holiday_x for r in flags] == [int(m in (3, 7)) for m in range(1, 13)] and all(r.holiday_none == 0 for r in flags)
    ends = holiday_flags(df, "d", {"x": [dt.date(2024, 3, 31)]}, align="end").where("holiday_x = 1").select("d").distinct().collect()
    assert [r.d for r in ends] == [dt.date(2024, 4, 1)]
    weekly = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=7 * i),) for i in range(5)], "d date")
    inferred, given = (holiday_flags(weekly, "d", {"x": [dt.date(2024, 1, 18)]}, **o).collect() for o in ({}, {"period": 7}))
    assert sorted(inferred) == sorted(given)
    with pytest.raises(Exception, match="fewer than two days"):
        holiday_flags(df.where("month(d) = 1"), "d", {"x": []}).collect()


# allocation


def test_allocation_filters_once_and_takes_channels_that_saturate_first(spark):
    rng = np.random.default_rng(9)
    plan = spark.createDataFrame([(i, *map(float, rng.gamma(2, 30, 3))) for i in range(20)], "t int, a double, b double, c double")
    spec = {
        "a": ChannelSpec(Adstock("geometric", 0.5, normalise=False), Saturation("hill", {"half_max": 60.0})),
        "b": ChannelSpec(Adstock("filter", weights=(0.6, 0.4)), Saturation("exponential", {"rate": 0.02})),
        "c": ChannelSpec(Adstock("geometric", 0.3), Saturation("hill", {"half_max": 50.0}), saturate_first=True),
    }
    coefficients = {"a": 100.0, "b": 80.0, "c": 120.0}
    found = allocate_budget(plan, spec, coefficients, "t", steps=12)
    with Responses(plan, spec, coefficients, "t") as responses:
        total = sum(responses.current().values())
        grid = {(r.channel, r.k): r.response for r in responses.at({c: [total * k / 12 for k in range(13)] for c in spec}).collect()}
    best = max(((i, j, 12 - i - j) for i, j in itertools.product(range(13), repeat=2) if i + j <= 12), key=lambda p: sum(grid[c, k] for c, k in zip("abc", p, strict=True)))
    got = {r.channel: r.recommended_spend for r in found.table.collect()}
    assert [got[c] for c in "abc"] == pytest.approx([total * k / 12 for k in best])
    assert found.table.agg(F.sum("recommended_spend")).first()[0] == pytest.approx(total)
    with pytest.raises(ValueError, match="steps"):
        allocate_budget(plan, spec, coefficients, "t", steps=0)


def test_the_density_kernel_of_the_other_tool_is_refused(spark):
    with pytest.raises(ValueError, match="weibull_cdf"):
        from_theta_alpha_gamma(spark.createDataFrame([(1, 2.0)], "t int, x double"), "x", "t", kind="weibull_pdf", shape=2.0, scale=0.5)


# columns of what was known for numbers


def test_vocabulary_of_columns_equals_that_of_numbers(spark):
    decays = [0.0, 0.1, 0.5, 0.7937005259840998, 0.9, 0.999]
    got = spark.createDataFrame([(d,) for d in decays], "d double").select("d", effective_window_column(F.col("d")).alias("w90"), effective_window_column(F.col("d"), 0.5).alias("w50")).collect()
    assert [(r.w90, r.w50) for r in got] == [(effective_window(d), effective_window(d, 0.5)) for d in decays]
    lives = [0.5, 1.0, 3.0, 52.0]
    back = spark.createDataFrame([(h,) for h in lives], "h double").select(decay_column(F.col("h"), 2.0).alias("d")).select("d", half_life_column(F.col("d"), 2.0).alias("h")).collect()
    assert [r.d for r in back] == pytest.approx([decay_from_half_life(h, 2.0) for h in lives]) and [r.h for r in back] == pytest.approx(lives)
    one = spark.createDataFrame([(1.0, -1.0)], "one double, less double")
    for wrong in (effective_window_column(F.col("one")), half_life_column(F.col("one")), decay_column(F.col("less"))):
        with pytest.raises(Exception, match="must be"):
            one.select(wrong).collect()


@pytest.mark.parametrize("type, p", [("hill", {"half_max": 50.0, "shape": 1.7}), ("exponential", {"rate": 0.02}), ("michaelis_menten", {"km": 30.0, "vmax": 2.0}), ("power", {"exponent": 0.4})])
def test_spend_for_columns_equals_that_of_numbers(spark, type, p):
    targets = [-0.0, 1.0, 45.0, 99.0, 150.0, 250.0]
    got = [r.s for r in spark.createDataFrame([(t,) for t in targets], "t double").select(spend_for_column(F.col("t"), 100.0, type, max_spend=2000.0, **p).alias("s")).collect()]
    want = [spend_for(t, 100.0, type, max_spend=2000.0, **p) for t in targets]
    assert [x is None for x in got] == [x is None for x in want]
    assert [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None])
    with pytest.raises(Exception, match="of one sign"):
        spark.range(1).select(spend_for_column(F.lit(-5.0), 100.0, type, max_spend=9.0, **p)).collect()


def test_carried_by_lag_adds_up_to_the_filtered_column(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(g, i, float(rng.gamma(1, 9))) for g, n in (("a", 20), ("b", 3)) for i in range(n)], "geo string, t int, x double")
    kernel = Adstock("weibull", max_lag=6, shape=2.0, scale=3.0, normalise=False)
    rows = carried_by_lag(df, "x", kernel, "t", ["geo"]).collect()
    assert {r.lag for r in rows if r.geo == "a"} == set(range(6)) and {r.lag for r in rows if r.geo == "b"} == set(range(3))
    whole = {r.geo: r.s for r in adstock(df, {"z": ("x", kernel)}, "t", ["geo"]).groupBy("geo").agg(F.sum("z").alias("s")).collect()}
    assert {g: sum(r.carried for r in rows if r.geo == g) for g in "ab"} == pytest.approx(whole)
    with pytest.raises(ValueError, match="kernels with max_lag"):
        carried_by_lag(df, "x", Adstock("geometric", 0.5), "t", ["geo"])


def test_made_tables_for_given_customers_and_geos(spark):
    some = spark.createDataFrame([(7,), (900,)], "c long")
    log, whole = touchpoints(spark, some), touchpoints(spark, 1000)
    assert {r.customer_id for r in log.select("customer_id").distinct().collect()} == {"cust_00007", "cust_00900"}
    assert sorted(log.collect(), key=str) == sorted(whole.where("customer_id in ('cust_00007', 'cust_00900')").collect(), key=str)
    geos = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "geo string, size double")
    panel = weekly_panel(spark, 104, geos=geos)
    sums = {r.geo: r for r in panel.groupBy("geo").agg(F.count("*").alias("n"), F.avg("tv").alias("tv"), F.avg((F.col("tv") == 0).cast("int")).alias("dark"), F.avg("price").alias("price"), F.avg("revenue").alias("revenue")).collect()}
    assert all(r.n == 104 and 0.15 < r.dark < 0.45 and abs(r.price - 10) < 0.3 for r in sums.values())
    assert 2 < sums["y"].tv / sums["x"].tv < 4 and 2.5 < sums["y"].revenue / sums["x"].revenue < 3.5
    same = weekly_panel(spark, 104, geos=geos.repartition(3)).orderBy("geo", "date").collect()
    assert [r.revenue for r in same] == pytest.approx([r.revenue for r in panel.orderBy("geo", "date").collect()])
