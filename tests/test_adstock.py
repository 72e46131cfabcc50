"""Recursions as window sums, in chunks, with states; what is refused."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendtrail.operators.adstock import Adstock, adstock, adstock_state


def panel(spark, lengths, seed=1, gaps=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate(lengths):
        x = rng.gamma(1, 100, n) * (rng.random(n) > 0.3)
        rows += [(f"g{g}", i, None if rng.random() < gaps else float(x[i])) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], "geo string, t int, x double")


def by_hand(df, decay, start=None):
    out = {}
    for geo, part in df.toPandas().sort_values("t").groupby("geo"):
        a = (start or {}).get(geo, 0.0)
        for t, x in zip(part["t"], part["x"].fillna(0.0), strict=True):
            a = x + decay * a
            out[geo, t] = a
    return out


@pytest.mark.parametrize("decay", [0.0, 1e-150, 1e-70, 0.001, 0.3, 0.85, 0.999, 0.999999])
def test_recursion_equals_the_loop_at_any_decay(spark, decay):
    df = panel(spark, [3000, 1, 700])
    want = by_hand(df, decay)
    for options in ({}, {"chunk_rows": 400}):
        got = {(r.geo, r.t): r.a for r in adstock(df, {"a": ("x", Adstock("geometric", decay, normalise=False))}, "t", ["geo"], **options).collect()}
        assert got.keys() == want.keys()
        assert np.array([got[k] for k in want]) == pytest.approx(np.array(list(want.values())), rel=1e-9, abs=1e-60)


def test_chunks_carry_on_from_one_to_the_next_and_from_a_state(spark):
    df = panel(spark, [900, 40, 5], seed=2).withColumn("day", F.date_add(F.lit(dt.date(2001, 1, 1)), F.col("t")))
    kernels = {"a": ("x", Adstock("geometric", 0.99, normalise=False)), "b": ("x2", Adstock("geometric", 0.4, normalise=True)), "c": ("x", Adstock("geometric", 0.5, 6, normalise=False))}
    state = spark.createDataFrame([("g0", 5000.0, 1.0), ("g1", 70.0, 2.0), ("g2", 3.0, 0.0)], "geo string, x_acc double, x2_acc double")
    df = df.withColumn("x2", F.col("x") / 3)
    whole = adstock(df, kernels, "day", ["geo"], state=state).select("geo", "t", "a", "b", "c")
    parts = adstock(df, kernels, "day", ["geo"], state=state, chunk_rows=100).select("geo", "t", "a", "b", "c")
    a, b = (np.array([tuple(r)[2:] for r in x.orderBy("geo", "t").collect()]) for x in (whole, parts))
    assert b == pytest.approx(a, rel=1e-9)
    want = by_hand(df, 0.99, {"g0": 5000.0, "g1": 70.0, "g2": 3.0})
    assert a[:, 0] == pytest.approx([want[k] for k in sorted(want)], rel=1e-9)


def test_no_rows_reach_python_but_a_row_a_chunk(spark):
    df = panel(spark, [50])
    kernel = Adstock("geometric", 0.5)
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan(adstock(df, {"a": ("x", kernel)}, "t", ["geo"]))
    assert "Pandas" not in plan(adstock(df, {"a": ("x", Adstock("geometric", 0.5, 9))}, "t", ["geo"], state=adstock_state(df, {"x": Adstock("geometric", 0.5, 9)}, "t", ["geo"])))
    chunked = plan(adstock(df, {"a": ("x", kernel)}, "t", ["geo"], chunk_rows=10))
    below = chunked[chunked.index("FlatMapGroupsInPandas") :]
    assert "HashAggregate" in below and chunked.count("FlatMapGroupsInPandas") == 1  # over one row a chunk


def test_gaps_are_kept_and_carried_over(spark):
    df = panel(spark, [60, 30], gaps=0.2)
    want = by_hand(df, 0.7)
    rows = adstock(df, {"a": ("x", Adstock("geometric", 0.7, normalise=False)), "f": ("x", Adstock("geometric", 0.7, 3, normalise=False))}, "t", ["geo"], na_action="keep").collect()
    for r in rows:
        assert (r.a is None) == (r.f is None) == (r.x is None)
        if r.x is not None:
            assert r.a == pytest.approx(want[r.geo, r.t])


def test_a_state_that_lacks_a_series_is_refused_or_cold(spark):
    kernel = Adstock("geometric", 0.5, normalise=False)
    df = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 20.0), ("b", 0, 30.0), ("b", 1, 40.0)], "geo string, t int, x double")
    state = spark.createDataFrame([("a", 7.5)], "geo string, x_acc double")
    for made in (lambda **o: adstock(df, {"z": ("x", kernel)}, "t", ["geo"], state=state, **o), lambda **o: adstock_state(df, {"x": kernel}, "t", ["geo"], state=state, **o)):
        with pytest.raises(Exception, match="state lacks the series b"):
            made().collect()
    rows = adstock(df, {"z": ("x", kernel)}, "t", ["geo"], state=state, missing_state="cold").orderBy("geo", "t").collect()
    assert [r.z for r in rows] == [13.75, 26.875, 30.0, 55.0]
    cold = {r.geo: r.x_acc for r in adstock_state(df, {"x": kernel}, "t", ["geo"], state=state, missing_state="cold").collect()}
    assert cold == {"a": 26.875, "b": 55.0}
    with pytest.raises(ValueError, match="missing_state"):
        adstock(df, {"z": ("x", kernel)}, "t", ["geo"], state=state, missing_state="warm")


@pytest.mark.parametrize("kernel", [Adstock("geometric", 0.5), Adstock("geometric", 0.5, 3)])
@pytest.mark.parametrize("rows", [[("a", 1, 1.0), ("a", 1, 2.0)], [("a", None, 1.0), ("a", 1, 2.0)]])
def test_two_rows_of_one_time_or_one_without_are_refused(spark, kernel, rows):
    df = spark.createDataFrame(rows, "geo string, t int, x double")
    with pytest.raises(Exception, match="two rows of one time, or one without"):
        adstock(df, {"a": ("x", kernel)}, "t", ["geo"]).collect()
