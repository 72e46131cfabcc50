"""Journey and attribution queries over ``events``.

id = user_id, channel = event_type, conversion = purchase events, ties by event_id, 'error' as the direct label. Cases that
the table lacks (ties, duplicates, missing labels, text times) are derived inside the query and likewise in the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spendtrail.operators.attribution import attribute, attribution_spread, share_intervals
from spendtrail.operators.credit import credit, credit_custom
from spendtrail.operators.journeys import bind_paths, build_paths
from spendtrail.operators.markov import markov_removal, transition_counts, transitions
from spendtrail.operators.path_stats import as_channel_paths, assisted_conversions, channel_positions, conversion_lag, path_lengths, path_strings, path_summary, top_paths
from spendtrail.streaming.stateful import stream_sessions

QUERIES, SQL = {}, {}
DROP = {"conversion_touch": "drop"}


def events(spark, sf_dir, ties=False, dupes=False, missing=False, text=False):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    df = df.withColumn("conv", F.col("event_type") == "purchase")
    if ties:
        df = df.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    if missing:
        df = df.withColumn("event_type", F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, " ")).otherwise(F.col("event_type")))
    if text:
        df = df.withColumn("ts", F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSSSSS")).withColumn("conv", F.when(F.col("conv"), " Yes ").otherwise("0"))
    return df.unionByName(df.where("event_id % 50 = 0")) if dupes else df


def journeys(spark, sf_dir, derive=None, **settings):
    asked = {"id": "user_id", "channel": "event_type", "timestamp": "ts", "conversion": "conv", "value": "value", "row_order": "event_id", "direct_labels": ("error",)}
    return build_paths(events(spark, sf_dir, **(derive or {})), **(asked | settings))


def journey_sql(derive=None, split=("conversion",), gap=None, lookback=None, direct="keep", touch="keep", collapse=True, null_paths=True, dedupe=True, extra=""):
    """CTEs raw, facts and p (the journeys) for the same settings; durations in days."""
    derive = derive or {}
    ts = "date_trunc('hour', ts)" if derive.get("ties") else "ts"
    channel = "CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN ' ' END ELSE event_type END" if derive.get("missing") else "event_type"
    base = f"SELECT event_id, user_id::VARCHAR AS id, {channel} AS ch, {ts} AS ts, epoch_us({ts}) AS t, (event_type = 'purchase')::INT AS conv, CASE WHEN event_type = 'purchase' THEN value END AS v, props FROM events"
    if derive.get("dupes"):
        base += f" UNION ALL {base} WHERE event_id % 50 = 0"
    opens = ["lag(t) OVER o IS NULL"]
    if "conversion" in split:
        opens.append("lag(conv) OVER o = 1")
    if "gap" in split:
        opens.append(f"t - lag(t) OVER o > {gap} * 86400000000::BIGINT")
    keep = ["(conv_t IS NULL OR t <= conv_t)"]
    if direct == "drop":
        keep.append("NOT dir")
    if touch == "drop":
        keep.append("conv = 0")
    if lookback is not None:
        keep.append(f"t >= coalesce(conv_t, last_t) - {lookback} * 86400000000::BIGINT")
    label = "CASE WHEN dir THEN '(direct)' WHEN trim(ch) = '' THEN '(blank)' ELSE ch END" if direct == "label" else "CASE WHEN ch IS NULL THEN '(missing)' WHEN trim(ch) = '' THEN '(blank)' ELSE ch END"
    last = [] if not collapse else ["(before IS NULL OR before <> channel)"]
    if not null_paths:
        last.append("conv_t IS NOT NULL")
    return f"""
    raw AS ({base}),
    d AS (SELECT *, row_number() OVER (PARTITION BY id, ch, t, conv, v ORDER BY event_id) AS copy FROM raw),
    s AS (SELECT *, (ch IS NULL OR lower(trim(ch)) = 'error') AS dir, CASE WHEN {' OR '.join(opens)} THEN 1 ELSE 0 END AS op
          FROM d {'WHERE copy = 1' if dedupe else ''} WINDOW o AS (PARTITION BY id ORDER BY t, conv, event_id)),
    j AS (SELECT *, sum(op) OVER (PARTITION BY id ORDER BY t, conv, event_id ROWS UNBOUNDED PRECEDING) AS jn FROM s),
    facts AS (SELECT *, max(CASE WHEN conv = 1 THEN t END) OVER w AS conv_t, sum(CASE WHEN conv = 1 THEN v END) OVER w AS total, max(t) OVER w AS last_t FROM j WINDOW w AS (PARTITION BY id, jn)),
    f AS (SELECT *, {label} AS channel FROM facts WHERE {' AND '.join(keep)}),
    c AS (SELECT *, lag(channel) OVER (PARTITION BY id, jn ORDER BY t, conv, event_id) AS before FROM f),
    k AS (SELECT * FROM c {'WHERE ' + ' AND '.join(last) if last else ''}),
    p AS (SELECT id || '#' || jn::BIGINT AS path_id, id, channel, ts AS "timestamp", (row_number() OVER (PARTITION BY id, jn ORDER BY t, conv, event_id))::INT AS touch_rank,
                 (count(*) OVER (PARTITION BY id, jn))::INT AS touch_n, conv_t IS NOT NULL AS converted, total AS conversion_value, (conv_t - t) / 86400000000.0::DOUBLE AS time_to_conversion{extra} FROM k)"""


def register(name, build, sql=None):
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


CORE = ["path_id", "id", "channel", "timestamp", "touch_rank", "touch_n", "converted"]
ROUNDED_SQL = 'path_id, id, channel, "timestamp", touch_rank, touch_n, converted, round(conversion_value, 6) AS conversion_value, round(time_to_conversion, 6) AS time_to_conversion'
COUNTS_SQL = """
    SELECT (SELECT count(*) FROM raw) AS events_in, (SELECT count(*) FROM p) AS events_out, (SELECT count(*) FILTER (dir) FROM facts) AS direct_events,
           (SELECT count(*) FROM p WHERE touch_rank = 1) AS journeys, (SELECT sum(op)::BIGINT FROM facts) AS journeys_before_filtering,
           (SELECT count(*) FROM p WHERE touch_rank = 1 AND converted) AS converting_journeys, (SELECT sum(conv)::BIGINT FROM facts) AS conversion_events,
           (SELECT count(*) FROM facts WHERE op = 1 AND conv_t IS NOT NULL) AS conversions_observed,
           (SELECT count(*) FROM facts WHERE op = 1 AND conv_t IS NOT NULL) - (SELECT count(*) FROM p WHERE touch_rank = 1 AND converted) AS conversions_unattributable,
           (SELECT count(*) FROM raw) - (SELECT count(*) FROM facts) AS duplicate_events,
           (SELECT count(*) FROM (SELECT sum(conv) AS wins FROM facts GROUP BY id, jn) WHERE wins > 1) AS multi_conversion_journeys,
           (SELECT coalesce(sum(wins - 1), 0)::BIGINT FROM (SELECT sum(conv) AS wins FROM facts GROUP BY id, jn) WHERE wins > 1) AS conversions_merged"""

#: name: (settings of build_paths, the same for journey_sql)
VARIANTS = {
    "w6_build_paths": ({}, {}),
    "w1_split_gap": ({"split_on": "gap", "gap": 1}, {"split": ("gap",), "gap": 1}),
    "w1_split_both": ({"split_on": ("conversion", "gap"), "gap": 0.5, **DROP}, {"split": ("conversion", "gap"), "gap": 0.5, "touch": "drop"}),
    "w2_split_none": ({"split_on": "none", **DROP}, {"split": (), "touch": "drop"}),
    "w3_uncollapsed": ({"collapse_repeats": False, **DROP}, {"collapse": False, "touch": "drop"}),
    "a1_dedupe": ({"derive": {"dupes": True}}, {"derive": {"dupes": True}}),
    "a1_no_dedupe": ({"derive": {"dupes": True}, "dedupe": False}, {"derive": {"dupes": True}, "dedupe": False}),
    "o1_ties": ({"derive": {"ties": True}}, {"derive": {"ties": True}}),
    "p2_text_times": ({"derive": {"text": True}}, {}),
    "p6_direct_label": ({"derive": {"missing": True}, "direct": "label"}, {"derive": {"missing": True}, "direct": "label"}),
    "p6_missing_labels": ({"derive": {"missing": True}}, {"derive": {"missing": True}}),
    "p7_direct_drop": ({"direct": "drop", **DROP}, {"direct": "drop", "touch": "drop"}),
    "p9_conversion_touch_drop": (DROP, {"touch": "drop"}),
    "p10_lookback": ({"lookback": 0.25, **DROP}, {"lookback": 0.25, "touch": "drop"}),
    "p11_no_null_paths": ({"keep_null_paths": False, **DROP}, {"null_paths": False, "touch": "drop"}),
}
for _name, (_own, _same) in VARIANTS.items():

    def _build(spark, sf_dir, own=_own):
        df = journeys(spark, sf_dir, **own).df
        return df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).select(*CORE, *[F.round(c, 6).alias(c) for c in ("conversion_value", "time_to_conversion")])

    register(_name, _build, f"WITH {journey_sql(**_same)} SELECT {ROUNDED_SQL} FROM p")

for _name, (_own, _same) in {"a2_counts": ({"direct": "drop", "lookback": 0.25, "derive": {"dupes": True}, **DROP}, {"direct": "drop", "lookback": 0.25, "derive": {"dupes": True}, "touch": "drop"}), "a3_counts_split_none": ({"split_on": "none"}, {"split": ()})}.items():
    register(_name, lambda spark, sf_dir, own=_own: journeys(spark, sf_dir, **own).counts(), f"WITH {journey_sql(**_same)} {COUNTS_SQL}")

register(
    "p1_kept_columns",
    lambda spark, sf_dir: journeys(spark, sf_dir, keep=["props"], **DROP).df.select("path_id", "touch_rank", "channel", "props"),
    f"WITH {journey_sql(touch='drop', extra=', props')} SELECT path_id, touch_rank, channel, props FROM p",
)
register(
    "p12_filter_rerank",
    lambda spark, sf_dir: journeys(spark, sf_dir, **DROP).filter(F.col("channel") != "click").df.select("path_id", "channel", "touch_rank", "touch_n"),
    f"""WITH {journey_sql(touch='drop')} SELECT path_id, channel, (row_number() OVER (PARTITION BY path_id ORDER BY touch_rank))::INT AS touch_rank, (count(*) OVER (PARTITION BY path_id))::INT AS touch_n
        FROM p WHERE channel <> 'click'""",
)
register(
    "u1_bind_paths",
    lambda spark, sf_dir: bind_paths({"a": journeys(spark, sf_dir, **DROP), "b": journeys(spark, sf_dir, split_on="none", **DROP)}).df.select("path_id", "channel", "touch_rank"),
    f"WITH a AS (WITH {journey_sql(touch='drop')} SELECT 'a:' || path_id AS path_id, channel, touch_rank FROM p), b AS (WITH {journey_sql(touch='drop', split=())} SELECT 'b:' || path_id AS path_id, channel, touch_rank FROM p) SELECT * FROM a UNION ALL SELECT * FROM b",
)

BASE = journey_sql(touch="drop")
WEIGHTS = {
    "linear": "1.0::DOUBLE / touch_n",
    "first": "(touch_rank = 1)::INT::DOUBLE",
    "last": "(touch_rank = touch_n)::INT::DOUBLE",
    "position": "CASE WHEN touch_n = 1 THEN 1.0 WHEN touch_n = 2 THEN 0.5 WHEN touch_rank IN (1, touch_n) THEN 0.4::DOUBLE ELSE 0.2::DOUBLE / (touch_n - 2) END",
    "time_decay": "exp(time_to_conversion * ln(0.5) / 7) / sum(exp(time_to_conversion * ln(0.5) / 7)) OVER (PARTITION BY path_id)",
}
CREDITS = ", ".join(f"CASE WHEN converted THEN {w} ELSE 0 END AS _{r}" for r, w in WEIGHTS.items())
SCORED = f"{BASE}, scored AS (SELECT *, {CREDITS} FROM p)"
LONG = f"{SCORED}, long AS (" + " UNION ALL ".join(f"SELECT path_id, id, channel, conversion_value, '{r}' AS rule, _{r} AS credit FROM scored" for r in WEIGHTS) + ")"
for _rule in WEIGHTS:
    register(
        f"w7_credit_{_rule}",
        lambda spark, sf_dir, rule=_rule: credit(journeys(spark, sf_dir, **DROP), rule).select("path_id", "touch_rank", "channel", F.round("credit", 6).alias("credit"), F.round("credit_value", 6).alias("credit_value")),
        f"WITH {SCORED} SELECT path_id, touch_rank, channel, round(_{_rule}::DOUBLE, 6) AS credit, round(_{_rule}::DOUBLE * coalesce(conversion_value, 0), 6) AS credit_value FROM scored",
    )
register(
    "w10_time_decay_zero",
    lambda spark, sf_dir: credit(journeys(spark, sf_dir, derive={"ties": True}, **DROP), "time_decay", decay=0).select("path_id", "touch_rank", F.round("credit", 6).alias("credit")),
    f"""WITH {journey_sql(touch='drop', derive={'ties': True})}, m AS (SELECT *, min(time_to_conversion) OVER (PARTITION BY path_id) AS least FROM p)
        SELECT path_id, touch_rank, round(CASE WHEN converted AND time_to_conversion = least THEN 1.0::DOUBLE / sum((time_to_conversion = least)::INT) OVER (PARTITION BY path_id) ELSE 0.0 END, 6) AS credit FROM m""",
)
register(
    "w11_credit_custom",
    lambda spark, sf_dir: credit_custom(journeys(spark, sf_dir, **DROP), lambda rank, n, recency: F.lit(1.0) / rank).select("path_id", "touch_rank", F.round("credit", 6).alias("credit")),
    f"WITH {BASE} SELECT path_id, touch_rank, round(CASE WHEN converted THEN 1.0::DOUBLE / touch_rank / sum(1.0::DOUBLE / touch_rank) OVER (PARTITION BY path_id) ELSE 0.0 END, 6) AS credit FROM p",
)
register("w11_credit_custom_function", lambda spark, sf_dir: credit_custom(journeys(spark, sf_dir, **DROP), lambda rank, n, recency: 2.0 ** -rank.astype(float)).select("path_id", "touch_rank", F.round("credit", 6).alias("credit")))

SUMS = "SELECT {by}rule, channel, sum(credit) AS conversions, sum(credit * coalesce(conversion_value, 0)) AS value, count(*) AS touches FROM long GROUP BY ALL"
SHARES = "SELECT {by}rule, channel, round(conversions, 6) AS conversions, round(conversions / sum(conversions) OVER (PARTITION BY {by}rule), 6) AS share, round(value, 4) AS value, touches FROM sums"
WALK = """
    moves AS (SELECT {by}channel AS source, coalesce(lead(channel) OVER o, CASE WHEN converted THEN '(conversion)' ELSE '(null)' END) AS target FROM p WINDOW o AS (PARTITION BY path_id ORDER BY touch_rank)
              UNION ALL SELECT {by}'(start)', channel FROM p WHERE touch_rank = 1),
    counts AS (SELECT {by}source, target, count(*) AS n FROM moves GROUP BY ALL),
    probs AS (SELECT {by}source, target, n, n::DOUBLE / sum(n) OVER (PARTITION BY {by}source) AS pr FROM counts)"""
CHAIN = (
    WALK
    + """,
    removed AS (SELECT DISTINCT {by}channel AS gone FROM p UNION ALL SELECT DISTINCT {by}'(nobody)' FROM p),
    walk AS (SELECT 0 AS step, {by}gone, '(start)' AS state, 1.0::DOUBLE AS mass FROM removed
             UNION ALL SELECT any_value(w.step) + 1, {wby}w.gone, q.target, sum(w.mass * q.pr) FROM walk w JOIN probs q ON q.source = w.state {on}
             WHERE q.target <> w.gone AND w.step < 300 GROUP BY {wby}w.gone, q.target),
    hit AS (SELECT {by}gone, coalesce(sum(mass) FILTER (state = '(conversion)'), 0) AS pc FROM walk GROUP BY ALL),
    effect AS (SELECT {hby}h.gone AS channel, greatest(0, 1 - h.pc / b.pc) AS re, h.pc AS p_without, b.pc AS base FROM hit h JOIN hit b ON b.gone = '(nobody)' AND h.gone <> '(nobody)' {hon}),
    firsts AS (SELECT {by}count(*) FILTER (converted) AS n_conv, sum(conversion_value) FILTER (converted) AS total FROM p WHERE touch_rank = 1 GROUP BY ALL),
    markov AS (SELECT e.*, f.n_conv * re / sum(re) OVER ({part}) AS conversions, re / sum(re) OVER ({part}) AS share, f.total * re / sum(re) OVER ({part}) AS value FROM effect e JOIN firsts f ON {fon})"""
)
PLAIN = {"by": "", "wby": "", "hby": "", "on": "", "hon": "", "part": "", "fon": "true"}
register(
    "a11_linear_totals",
    lambda spark, sf_dir: _rounded(attribute(journeys(spark, sf_dir, **DROP), rules=["linear"])),
    f"WITH {LONG}, sums AS ({SUMS.format(by='')}) {SHARES.format(by='')} WHERE rule = 'linear'",
)


def _rounded(df, *by):
    return df.select(*by, "rule", "channel", F.round("conversions", 6).alias("conversions"), F.round("share", 6).alias("share"), F.round("value", 4).alias("value"), "touches")


register(
    "a12_attribute",
    lambda spark, sf_dir: _rounded(attribute(journeys(spark, sf_dir, **DROP))),
    f"""WITH RECURSIVE {LONG}, sums AS ({SUMS.format(by='')}), {CHAIN.format(**PLAIN)}
        {SHARES.format(by='')} UNION ALL SELECT 'markov', m.channel, round(conversions, 6), round(share, 6), round(value, 4), t.n FROM markov m JOIN (SELECT channel, count(*) AS n FROM p GROUP BY 1) t USING (channel)""",
)


def segmented(spark, sf_dir, **settings):
    return journeys(spark, sf_dir, **settings).df.withColumn("segment", (F.col("id").cast("long") % 3).cast("int"))


SEGMENTED = BASE.replace("p AS (SELECT id", "p AS (SELECT (id::BIGINT % 3)::INT AS segment, id")
register(
    "a12_attribute_by",
    lambda spark, sf_dir: _rounded(attribute(segmented(spark, sf_dir, **DROP), rules=["linear", "first", "last", "position", "time_decay"], by=["segment"]), "segment"),
    f"WITH {LONG}, seg AS (SELECT *, (id::BIGINT % 3)::INT AS segment FROM long), sums AS ({SUMS.format(by='segment, ').replace('FROM long', 'FROM seg')}) {SHARES.format(by='segment, ')}",
)
register(
    "a14_spread",
    lambda spark, sf_dir: attribution_spread(attribute(journeys(spark, sf_dir, **DROP), rules=["linear", "first", "last", "position", "time_decay"])).select("channel", *[F.round(c, 6).alias(c) for c in ("min_share", "max_share", "mean_share", "spread", "first_last_ratio")]),
    f"""WITH {LONG}, sums AS ({SUMS.format(by='')}), shares AS (SELECT rule, channel, conversions / sum(conversions) OVER (PARTITION BY rule) AS share FROM sums)
        SELECT channel, round(min(share), 6) AS min_share, round(max(share), 6) AS max_share, round(avg(share), 6) AS mean_share, round(max(share) - min(share), 6) AS spread,
               round(max(share) FILTER (rule = 'first') / nullif(max(share) FILTER (rule = 'last'), 0), 6) AS first_last_ratio FROM shares GROUP BY 1""",
)
register("a15_transitions", lambda spark, sf_dir: transitions(journeys(spark, sf_dir, **DROP)).select("from", "to", "n", F.round("p", 6).alias("p")), f'WITH {BASE}, {WALK.format(by="")} SELECT source AS "from", target AS "to", n, round(pr, 6) AS p FROM probs')
register(
    "a16_markov_removal",
    lambda spark, sf_dir: markov_removal(journeys(spark, sf_dir, **DROP)).select("channel", *[F.round(c, 6).alias(c) for c in ("removal_effect", "conversions", "share")], F.round("value", 4).alias("value"), F.round("p_without", 6).alias("p_without"), F.round("p_conversion", 6).alias("p_conversion")),
    f"""WITH RECURSIVE {BASE}, {CHAIN.format(**PLAIN)} SELECT channel, round(re, 6) AS removal_effect, round(conversions, 6) AS conversions, round(share, 6) AS share, round(value, 4) AS value,
        round(p_without, 6) AS p_without, round(base, 6) AS p_conversion FROM markov""",
)
register(
    "a16_markov_by",
    lambda spark, sf_dir: markov_removal(segmented(spark, sf_dir, **DROP), by=["segment"]).select("segment", "channel", *[F.round(c, 6).alias(c) for c in ("removal_effect", "conversions", "share")]),
    f"""WITH RECURSIVE {SEGMENTED}, {CHAIN.format(by='segment, ', wby='w.segment, ', hby='h.segment, ', on='AND q.segment = w.segment', hon='AND h.segment = b.segment', part='PARTITION BY e.segment', fon='e.segment = f.segment')}
        SELECT segment, channel, round(re, 6) AS removal_effect, round(conversions, 6) AS conversions, round(share, 6) AS share FROM markov""",
)
register("t14_share_intervals", lambda spark, sf_dir: share_intervals(journeys(spark, sf_dir, **DROP), ["linear", "last", "markov"]))
register(
    "a4_path_summary",
    lambda spark, sf_dir: path_summary(journeys(spark, sf_dir, **DROP)).withColumn("mean_length", F.round("mean_length", 6)),
    f"WITH {BASE}, n AS ({COUNTS_SQL}), l AS (SELECT round(avg(touch_n), 6) AS mean_length, median(touch_n)::DOUBLE AS median_length, max(touch_n) AS max_length FROM p WHERE touch_rank = 1) SELECT * FROM n, l",
)
register(
    "a5_path_lengths",
    lambda spark, sf_dir: path_lengths(journeys(spark, sf_dir, **DROP)).withColumn("conversion_rate", F.round("conversion_rate", 6)),
    f"WITH {BASE} SELECT touch_n AS length, count(*) AS journeys, count(*) FILTER (converted) AS converting, round(count(*) FILTER (converted) / count(*), 6) AS conversion_rate FROM p WHERE touch_rank = 1 GROUP BY 1",
)
register(
    "a6_channel_positions",
    lambda spark, sf_dir: channel_positions(journeys(spark, sf_dir, **DROP)).withColumn("first_last_ratio", F.round("first_last_ratio", 6)),
    f"""WITH {BASE}, q AS (SELECT channel, CASE WHEN touch_n = 1 THEN 'only' WHEN touch_rank = 1 THEN 'first' WHEN touch_rank = touch_n THEN 'last' ELSE 'middle' END AS pos FROM p WHERE converted)
        SELECT channel, count(*) FILTER (pos = 'only') AS "only", count(*) FILTER (pos = 'first') AS "first", count(*) FILTER (pos = 'middle') AS middle, count(*) FILTER (pos = 'last') AS "last", count(*) AS touches,
               round(count(*) FILTER (pos = 'first') / nullif(count(*) FILTER (pos = 'last'), 0), 6) AS first_last_ratio FROM q GROUP BY 1""",
)
SPANS = "spans AS (SELECT path_id, channel, min(touch_rank) AS f, max(touch_rank) AS l FROM p WHERE converted GROUP BY ALL), pairs AS (SELECT a.channel AS assisting, b.channel AS assisted, count(*) AS n FROM spans a JOIN spans b ON a.path_id = b.path_id AND a.f < b.l GROUP BY ALL)"
register("a7_assisted_conversions", lambda spark, sf_dir: assisted_conversions(journeys(spark, sf_dir, **DROP)), f"WITH {BASE}, {SPANS} SELECT * FROM pairs")
register(
    "a7_assisted_normalised",
    lambda spark, sf_dir: assisted_conversions(journeys(spark, sf_dir, split_on="none", **DROP), normalise=True).withColumn("n", F.round("n", 6)),
    f"WITH {journey_sql(split=(), touch='drop')}, {SPANS}, h AS (SELECT channel AS assisting, count(*) AS present FROM spans GROUP BY 1) SELECT assisting, assisted, round(n / present, 6) AS n FROM pairs JOIN h USING (assisting)",
)
STRINGS = "strs AS (SELECT path_id, string_agg(channel, ' > ' ORDER BY touch_rank) AS path, any_value(converted) AS converted, any_value(conversion_value) AS conversion_value FROM p GROUP BY 1)"
register(
    "a8_top_paths",
    lambda spark, sf_dir: top_paths(journeys(spark, sf_dir, **DROP), 15).withColumn("conversion_rate", F.round("conversion_rate", 6)),
    f"WITH {BASE}, {STRINGS} SELECT path, count(*) AS journeys, count(*) FILTER (converted) AS conversions, round(count(*) FILTER (converted) / count(*), 6) AS conversion_rate FROM strs GROUP BY 1 ORDER BY journeys DESC, path LIMIT 15",
)
register("a17_path_strings", lambda spark, sf_dir: path_strings(journeys(spark, sf_dir, **DROP)).withColumn("conversion_value", F.round("conversion_value", 6)), f"WITH {BASE}, {STRINGS} SELECT path_id, path, converted, round(conversion_value, 6) AS conversion_value FROM strs")
register(
    "s4_channel_paths",
    lambda spark, sf_dir: as_channel_paths(journeys(spark, sf_dir, **DROP)).withColumn("total_conversion_value", F.round("total_conversion_value", 4)),
    f"""WITH {BASE}, {STRINGS} SELECT path, (count(*) FILTER (converted))::DOUBLE AS total_conversions, (count(*) FILTER (NOT converted))::DOUBLE AS total_null,
        round(sum(CASE WHEN converted THEN coalesce(conversion_value, 0) ELSE 0 END), 4) AS total_conversion_value FROM strs GROUP BY 1""",
)
register(
    "a9_conversion_lag",
    lambda spark, sf_dir: conversion_lag(journeys(spark, sf_dir, **DROP)).select("quantile", F.round("lag", 6).alias("lag")),
    f"WITH {BASE}, l AS (SELECT max(time_to_conversion) AS lag FROM p WHERE converted GROUP BY path_id) " + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS quantile, round(quantile_cont(lag, {q}), 6) AS lag FROM l" for q in (0.5, 0.75, 0.9, 0.95, 0.99, 1.0)),
)
register("a15_transition_counts", lambda spark, sf_dir: transition_counts(journeys(spark, sf_dir, split_on="none", **DROP)).where("source is not null and target is not null").select("source", "target", "n"), f"WITH {journey_sql(split=(), touch='drop')}, {WALK.format(by='')} SELECT source, target, n FROM counts WHERE source <> '(start)' AND target NOT IN ('(conversion)', '(null)')")
register(
    "st_sessions",
    lambda spark, sf_dir: stream_sessions(events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "6 hours", "1 day").select("id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "touches"),
    """WITH o AS (SELECT user_id AS id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS op FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       s AS (SELECT *, sum(op) OVER (PARTITION BY id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
       SELECT id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS touches FROM s GROUP BY id, n""",
)
