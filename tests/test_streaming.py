"""Journeys with timers and the filter's policy on gaps, over micro-batches, against the batch operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendtrail.operators.adstock import Adstock, adstock
from spendtrail.operators.diagnose import carry_class
from spendtrail.operators.journeys import build_paths
from spendtrail.streaming.stateful import CARRY, _micros, run_to_memory, stream_adstock, stream_journeys, with_side_output

START = dt.datetime(2024, 1, 1)


def batches(spark, tmp_path, rows, schema, name="in"):
    """A stream of the lists of rows, each a micro-batch of its own."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"{i:03}"))
    parts = [str(tmp_path / name / f"{i:03}") for i in range(len(rows))]
    import os
    import shutil

    flat = tmp_path / f"{name}-flat"
    flat.mkdir()
    for i, part in enumerate(parts):
        (file,) = [f for f in os.listdir(part) if f.startswith("part-")]
        shutil.copy(os.path.join(part, file), flat / f"{i:03}.parquet")
        os.utime(flat / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))


TOUCH = "who string, ch string, at timestamp, won int"


def touch(who, ch, hours, won=0):
    return (who, ch, START + dt.timedelta(hours=hours), won)


def test_timed_journeys_equal_build_paths(spark, tmp_path):
    first = [touch("a", "tv", 0), touch("a", "search", 2, 1), touch("b", "tv", 1), touch("c", "social", 3), touch("a", "mail", 4), touch("d", None, 1)]
    second = [touch("b", "mail", 9), touch("a", "search", 5, 1), touch("a", "tv", 4.5), touch("c", "tv", 8.5), touch("e", "tv", 12), touch("d", "mail", 1.5, 1)]  # some out of order
    third = [touch("b", "search", 40, 1), touch("a", "tv", 41), touch("z", "late", 80)]
    everything = first + second + third
    stream = batches(spark, tmp_path, [first, second, third, [touch("z", "end", 200)], [touch("z", "end", 201)]], TOUCH)
    got = run_to_memory(stream_journeys(stream, "who", "ch", "at", "won", gap="6 hours", watermark="10 hours"), "timed_journeys").collect()
    paths = build_paths(spark.createDataFrame(everything, TOUCH), "who", "ch", "at", "won", split_on=("conversion", "gap"), gap=6, units="hours", collapse_repeats=False, keep_null_paths=True)
    want = paths.df.groupBy("id", "path_id").agg(F.sort_array(F.collect_list(F.struct("touch_rank", "channel"))).alias("x"), F.max("converted").alias("converted")).collect()
    journeys = lambda rows: sorted(rows)
    whole = journeys((r["id"], " > ".join(x["channel"] for x in r["x"]).replace("(direct)", "(missing)"), bool(r["converted"])) for r in want)
    done = journeys((r["id"], r["path"], r["converted"]) for r in got if r["id"] != "z" or r["path"] == "late")
    assert done == whole
    assert {r["path_id"] for r in got if r["id"] == "a"} == {"a#1", "a#2", "a#3"}
    timer_closed = [r for r in got if r["id"] == "c"]
    assert [(r["path"], r["touches"], r["converted"], r["last_t"]) for r in timer_closed] == [("social > tv", 2, False, START + dt.timedelta(hours=8.5))]  # c never came again


def test_what_is_forgotten_begins_anew(spark, tmp_path):
    stream = lambda name: batches(spark, tmp_path, [[touch("a", "x", 0, 1), touch("b", "y", 1)], [touch("k", "t", 60)], [touch("k", "t", 61)], [touch("a", "x", 70, 1)], [touch("k", "t", 150)], [touch("k", "t", 151)]], TOUCH, name)
    keep = run_to_memory(stream_journeys(stream("one"), "who", "ch", "at", "won", gap="6 hours"), "kept_numbers").where("id = 'a'").collect()
    drop = run_to_memory(stream_journeys(stream("two"), "who", "ch", "at", "won", gap="6 hours", forget="24 hours"), "dropped_numbers").where("id = 'a'").collect()
    assert sorted(r["path_id"] for r in keep) == ["a#1", "a#2"] and sorted(r["path_id"] for r in drop) == ["a#1", "a#1"]


def test_spans_are_checked(spark):
    assert (_micros("14 days"), _micros("1.5 hours"), _micros("1 second")) == (14 * 86400 * 10**6, 5400 * 10**6, 10**6)
    rows = spark.createDataFrame([touch("a", "x", 0)], TOUCH)
    for options in ({"gap": "soon"}, {"gap": "3 weeks"}, {"gap": "2 days", "forget": "1 day"}):
        with pytest.raises(ValueError):
            stream_journeys(rows, "who", "ch", "at", "won", **options)


SPEND = "geo string, t double, x double"


def test_all_six_classes_and_what_a_break_does(spark, tmp_path):
    parts = [
        [("a", 0.0, 100.0), ("a", 7.0, 0.0), ("b", 0.0, 10.0)],
        [("a", 14.0, 0.0), ("a", 7.0, 99.0), ("b", 7.0, 0.0)],
        [("a", 35.0, 0.0), ("b", 9.0, 0.0), ("c", 3.0, 5.0)],
    ]
    values = {}
    for on_break in ("continue", "decay", "cold"):
        rows = run_to_memory(stream_adstock(batches(spark, tmp_path, parts, SPEND, on_break), "geo", "t", "x", 0.5, on_break=on_break), f"policy_{on_break}").collect()
        assert {r["carry"] for r in rows} == set(CARRY)
        assert {(r["series"], r["t"]) for r in rows if r["late"]} == {("a", 7.0)} and all((r["value"] is None) == r["late"] for r in rows)
        values[on_break] = {(r["series"], r["t"]): (r["value"], r["carry"]) for r in rows if not r["late"]}
    one = values["continue"]
    assert one["a", 0.0] == (100.0, "unseen") and one["a", 7.0] == (50.0, "unknown_period") and one["a", 14.0] == (25.0, "contiguous")
    assert [values[k]["a", 35.0] for k in ("continue", "decay", "cold")] == [(12.5, "gap"), (3.125, "gap"), (0.0, "gap")]
    assert [values[k]["b", 9.0] for k in ("continue", "decay", "cold")] == [(2.5, "misaligned"), (2.5, "misaligned"), (0.0, "misaligned")]
    taken = spark.createDataFrame([r for part in parts for r in part if r != ("a", 7.0, 99.0)], SPEND)
    batch = {(r.geo, r.t): r.a for r in adstock(taken, {"a": ("x", Adstock("geometric", 0.5, normalise=False))}, "t", ["geo"]).collect()}
    assert batch == {k: v for k, (v, _) in one.items()}


def test_breaks_go_to_a_table_of_their_own(spark, tmp_path):
    parts = [[("a", 0.0, 8.0), ("a", 1.0, 0.0)], [("a", 1.0, 5.0), ("a", 2.0, 0.0)], [("a", 9.0, 0.0)]]
    made = stream_adstock(batches(spark, tmp_path, parts, SPEND), "geo", "t", "x", 0.5, period=1.0)
    query = with_side_output(made, str(tmp_path / "main"), str(tmp_path / "side"), str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    main, side = spark.read.parquet(str(tmp_path / "main")), spark.read.parquet(str(tmp_path / "side"))
    assert sorted((r.t, r.value) for r in main.collect()) == [(0.0, 8.0), (1.0, 4.0), (2.0, 2.0), (9.0, 1.0)]
    assert sorted((r.t, r.carry) for r in side.collect()) == [(1.0, "overlap"), (9.0, "gap")]


def test_policy_is_checked(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0)], SPEND)
    for options in ({"on_break": "skip"}, {"tolerance": 0.5}, {"period": 0.0}):
        with pytest.raises(ValueError):
            stream_adstock(rows, "geo", "t", "x", 0.5, **options)


@pytest.mark.parametrize("start, kind", [(-1.0, "overlap"), (3.0, "overlap"), (3.5, "misaligned"), (5.0, "contiguous"), (5.2, "contiguous"), (5.4, "gap"), (9.5, "gap")])
def test_batch_classes(spark, start, kind):
    old = spark.createDataFrame([("g", float(i)) for i in range(5)] + [("one", 4.0)], "geo string, t double")
    new = spark.createDataFrame([("g", start), ("g", start + 1), ("z", start), ("one", 5.0)], "geo string, t double")
    assert {r.geo: r.carry for r in carry_class(old, new, "t", ["geo"]).collect()} == {"g": kind, "z": "unseen", "one": "contiguous"}


def test_batch_classes_without_groups_or_periods(spark):
    frame = lambda *times: spark.createDataFrame([(float(t),) for t in times], "t double")
    assert carry_class(frame(1), frame(2), "t", []).first().carry == "unknown_period"
    assert carry_class(frame(1, 2, 4, 5), frame(3), "t", []).first().carry == "overlap"  # a period after one of its times
    assert carry_class(frame(1, 2), frame(3), "t", []).first().carry == "contiguous"
