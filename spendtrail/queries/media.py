"""Media-panel queries: spend by geo (region) and week from ``orders``, a channel for each order priority, net revenue as KPI."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from spendtrail.functions.calendar import fourier_terms, holiday_flags
from spendtrail.functions.decay import decay_column, delayed_weights, effective_window, effective_window_column, geometric_weights, half_life_column, weibull_weights
from spendtrail.functions.metrics import mae, ols, rmse
from spendtrail.functions.saturation import saturate
from spendtrail.operators.adstock import Adstock, ChannelSpec, Saturation, adstock, adstock_state, adstock_steady_state, carried_by_lag, media_transform
from spendtrail.operators.bootstrap import block_bootstrap
from spendtrail.operators.diagnose import carry_class, correlations, cpm_outliers, date_audit, diagnose_media, variation, vif
from spendtrail.operators.steps import AdstockStep, Curve, SaturationStep, reference_levels
from spendtrail.operators.tuning import expanding_fits, filtered, grid, predictions, splits, tune_carryover, tune_carryover_joint
from spendtrail.plans.media import allocate_budget, contributions, marginal_roi, mroi_column, reallocate, response_curve, response_grid, roi, simulate_plan, spend_for_column, transform_plan, unmatched, unmatched_channels
from spendtrail.plans.plot_data import contribution_bands
from spendtrail.sources.hyper import from_theta_alpha_gamma
from spendtrail.sources.look_alikes import touchpoints, weekly_panel

QUERIES, SQL = {}, {}
PRIORITY = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "spare": "4-NOT SPECIFIED", "low": "5-LOW"}
CHANNELS = list(PRIORITY)
JOINED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
PANEL = f"""
    sp AS (SELECT r_name AS geo, date_trunc('week', o_orderdate)::DATE AS wk, {', '.join(f"sum(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice ELSE 0 END) / 1000 AS {c}" for c, p in PRIORITY.items())}, count(*) AS n
           FROM {JOINED} GROUP BY ALL),
    wks AS (SELECT geo, unnest(generate_series(min(wk), max(wk), INTERVAL 7 DAY))::DATE AS wk FROM sp GROUP BY geo),
    panel AS (SELECT geo, wk, {', '.join(f'coalesce({c}, 0)::DOUBLE AS {c}' for c in CHANNELS)}, coalesce(n, 0) AS n FROM wks LEFT JOIN sp USING (geo, wk))"""
KPI = f""",
    rev AS (SELECT r_name AS geo, date_trunc('week', o_orderdate)::DATE AS wk, sum(l_extendedprice * (1 - l_discount)) / 1000 AS kpi FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
    full_panel AS (SELECT p.*, coalesce(kpi, 0)::DOUBLE AS kpi FROM panel p LEFT JOIN rev USING (geo, wk))"""


def sparse(spark, sf_dir, kpi=False):
    """(geo, wk, n, and channels or kpi) of the weeks that have orders."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    geo = read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("geo"))
    who = read("customer").join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "geo")
    rows = read("orders").join(who, F.col("o_custkey") == F.col("c_custkey")).withColumn("wk", F.date_trunc("week", "o_orderdate").cast("date"))
    if kpi:
        net = (F.col("l_extendedprice") * (1 - F.col("l_discount")))
        return read("lineitem").join(rows.select("o_orderkey", "geo", "wk"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("geo", "wk").agg((F.sum(net) / 1000).alias("kpi"))
    return rows.groupBy("geo", "wk").agg(*[(F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")).otherwise(0.0)) / 1000).alias(c) for c, p in PRIORITY.items()], F.count("*").alias("n"))


def panel(spark, sf_dir, kpi=False):
    """Every week of each geo, weeks without orders at zero."""
    rows = sparse(spark, sf_dir)
    weeks = rows.groupBy("geo").agg(F.min("wk").alias("a"), F.max("wk").alias("b")).select("geo", F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("wk"))
    out = weeks.join(rows, ["geo", "wk"], "left").na.fill(0, [*CHANNELS, "n"])
    return out.join(sparse(spark, sf_dir, kpi=True), ["geo", "wk"], "left").na.fill(0, ["kpi"]) if kpi else out


def register(name, build, sql=None):
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


def r(column, digits=6):
    return F.round(F.col(column).cast("double"), digits).alias(column)


def fir_sql(x, weights, by="geo", order="wk"):
    over = f"OVER (PARTITION BY {by} ORDER BY {order})"
    return " + ".join(f"{float(w)!r}::DOUBLE * coalesce(lag({x}, {i}) {over}, 0)" for i, w in enumerate(weights) if w)


def iir_sql(table, x, decay, by="geo", order="wk"):
    """CTE iir (by, order, x, a): the recursion over lists, one series a row."""
    return f"""lists AS (SELECT {by}, list({order} ORDER BY {order}) AS ts, list({x} ORDER BY {order}) AS xs FROM {table} GROUP BY {by}),
    iir AS (SELECT {by}, unnest(ts) AS {order}, unnest(list_transform(range(1, len(xs) + 1), lambda i: list_reduce(list_prepend(0.0::DOUBLE, list_slice(xs, 1, i)), lambda a, b: b + {decay}::DOUBLE * a))) AS a FROM lists)"""


GEO = Adstock("geometric", 0.6, normalise=False)
KERNELS = {
    "w13_geometric_finite": (Adstock("geometric", 0.5531, 4, normalise=False), geometric_weights(4, 0.5531)),
    "w13_geometric_finite_normalised": (Adstock("geometric", 0.5, 4, normalise=True), geometric_weights(4, 0.5, True)),
    "w14_weibull_cdf": (Adstock("weibull", max_lag=8, shape=2, scale=3, normalise=False), weibull_weights(8, 2, 3)),
    "w14_weibull_pdf": (Adstock("weibull", max_lag=8, shape=1.5, scale=2, type="pdf", normalise=True), weibull_weights(8, 1.5, 2, "pdf", True)),
    "w15_delayed": (Adstock("delayed", 0.7, 6, peak=2, normalise=False), delayed_weights(6, 0.7, 2)),
    "w16_filter": (Adstock("filter", weights=(0.2, 0.5, 0.3), normalise=False), (0.2, 0.5, 0.3)),
}
for _name, (_kernel, _weights) in KERNELS.items():
    register(
        _name,
        lambda spark, sf_dir, k=_kernel: adstock(panel(spark, sf_dir), {"a": ("urgent", k)}, "wk", ["geo"]).select("geo", "wk", r("a")),
        f"WITH {PANEL} SELECT geo, wk, round({fir_sql('urgent', _weights)}, 6) AS a FROM panel",
    )
for _name, _scale in (("w13_geometric", 1.0), ("w13_geometric_normalised", 0.4)):
    register(
        _name,
        lambda spark, sf_dir, s=_scale: adstock(panel(spark, sf_dir), {"a": ("urgent", Adstock("geometric", 0.6, normalise=s < 1))}, "wk", ["geo"]).select("geo", "wk", r("a", 4)),
        f"WITH {PANEL}, {iir_sql('panel', 'urgent', 0.6)} SELECT geo, wk, round({_scale}::DOUBLE * a, 4) AS a FROM iir",
    )


def chunked(spark, sf_dir):
    """The series cut in two: the first part's state continues the second, and both together equal the whole."""
    df, cut = panel(spark, sf_dir), F.lit(dt.date(1998, 1, 1))
    first, second = df.where(F.col("wk") < cut), df.where(F.col("wk") >= cut)
    state = adstock_state(first, {"urgent": GEO}, "wk", ["geo"])
    parts = adstock(first, {"a": ("urgent", GEO)}, "wk", ["geo"]).unionByName(adstock(second, {"a": ("urgent", GEO)}, "wk", ["geo"], state=state))
    return parts.select("geo", "wk", r("a", 4))


register("w17_adstock_chunked", chunked, f"WITH {PANEL}, {iir_sql('panel', 'urgent', 0.6)} SELECT geo, wk, round(a, 4) AS a FROM iir")
register(
    "w17_adstock_state",
    lambda spark, sf_dir: adstock_state(panel(spark, sf_dir), {"urgent": GEO}, "wk", ["geo"]).select("geo", r("urgent_acc", 4)),
    f"WITH {PANEL}, {iir_sql('panel', 'urgent', 0.6)} SELECT geo, round(arg_max(a, wk), 4) AS urgent_acc FROM iir GROUP BY geo",
)
register(
    "w18_steady_state",
    lambda spark, sf_dir: adstock_steady_state(panel(spark, sf_dir), "urgent", GEO, "wk", ["geo"]).select("geo", r("urgent_acc", 4)),
    f"WITH {PANEL}, o AS (SELECT *, row_number() OVER (PARTITION BY geo ORDER BY wk) AS rn FROM panel) SELECT geo, round(avg(urgent) / (1 - 0.6::DOUBLE), 4) AS urgent_acc FROM o WHERE rn <= {effective_window(0.6)} GROUP BY geo",
)
SPEC = {
    "urgent": ChannelSpec(Adstock("geometric", 0.5, 4, normalise=False), Saturation("hill", {"half_max": 400.0, "shape": 1.5})),
    "high": ChannelSpec(Adstock("filter", weights=(0.7, 0.3), normalise=False), Saturation("exponential", {"rate": 0.002})),
    "low": ChannelSpec(Adstock(), Saturation("power", {"exponent": 0.5})),
}
COEF = {"urgent": 900.0, "high": 500.0, "low": 20.0}


def transformed_sql(table="panel", order="wk", scale=None):
    s = scale or {c: c for c in SPEC}
    a = f"SELECT *, {fir_sql(s['urgent'], geometric_weights(4, 0.5), order=order)} AS au, {fir_sql(s['high'], (0.7, 0.3), order=order)} AS ah, {s['low']} AS al FROM {table}"
    return f"adst AS ({a}), trans AS (SELECT *, CASE WHEN au = 0 THEN 0 ELSE 1 / (1 + pow(400.0::DOUBLE / nullif(au, 0), 1.5)) END AS tu, 1 - exp(-0.002::DOUBLE * ah) AS th, pow(al, 0.5) AS tl FROM adst)"


register(
    "w20_media_transform",
    lambda spark, sf_dir: media_transform(panel(spark, sf_dir), {"t": ("urgent", SPEC["urgent"])}, "wk", ["geo"]).select("geo", "wk", r("t")),
    f"WITH {PANEL}, {transformed_sql()} SELECT geo, wk, round(tu, 6) AS t FROM trans",
)
register(
    "w21_transform_plan",
    lambda spark, sf_dir: transform_plan(panel(spark, sf_dir), SPEC, "wk", ["geo"]).select("geo", "wk", *[r(c) for c in SPEC], r("medium")),
    f"WITH {PANEL}, {transformed_sql()} SELECT geo, wk, round(tu, 6) AS urgent, round(th, 6) AS high, round(tl, 6) AS low, round(medium, 6) AS medium FROM trans",
)
EXT = "ext AS (SELECT geo, wk, 0 AS e, urgent, high, low FROM panel UNION ALL SELECT geo, max(wk), x.e::INT, 0, 0, 0 FROM panel, (SELECT unnest(range(1, 7)) AS e) x GROUP BY geo, x.e)"
register(
    "a30_simulate_plan",
    lambda spark, sf_dir: simulate_plan(panel(spark, sf_dir), SPEC, COEF, "wk", ["geo"], extend=6).select("channel", r("spend", 3), r("contribution", 3)),
    f"""WITH {PANEL}, {EXT}, {transformed_sql('ext', 'e, wk')} SELECT 'urgent' AS channel, round(sum(urgent), 3) AS spend, round(900 * sum(tu), 3) AS contribution FROM trans
        UNION ALL SELECT 'high', round(sum(high), 3), round(500 * sum(th), 3) FROM trans UNION ALL SELECT 'low', round(sum(low), 3), round(20 * sum(tl), 3) FROM trans""",
)
WINDOW = "wk >= DATE '1999-01-01'"
BUMPED = {c: f"CASE WHEN {WINDOW} AND e = 0 THEN {c} * 1.01::DOUBLE ELSE {c} END" for c in SPEC}
register(
    "a31_marginal_roi",
    lambda spark, sf_dir: marginal_roi(panel(spark, sf_dir), SPEC, COEF, "wk", ["geo"], rows=F.col("wk") >= dt.date(1999, 1, 1), extend=6).select("channel", r("spend", 3), r("contribution", 3), r("roi"), r("mroi", 4)),
    f"""WITH {PANEL}, {EXT}, b AS (SELECT geo, wk, e, {', '.join(f'{x} AS {c}' for c, x in BUMPED.items())} FROM ext),
        base AS (WITH {transformed_sql('ext', 'e, wk')} SELECT sum(tu) AS u, sum(th) AS h, sum(tl) AS l FROM trans),
        bump AS (WITH {transformed_sql('b', 'e, wk')} SELECT sum(tu) AS u, sum(th) AS h, sum(tl) AS l FROM trans),
        s AS (SELECT {', '.join(f"sum({c}) AS {c}, sum({c}) FILTER ({WINDOW}) AS w_{c}" for c in SPEC)} FROM panel)
        """
    + " UNION ALL ".join(
        f"SELECT '{c}' AS channel, round(s.{c}, 3) AS spend, round({COEF[c]} * base.{k}, 3) AS contribution, round({COEF[c]} * base.{k} / s.{c}, 6) AS roi, round({COEF[c]} * (bump.{k} - base.{k}) / (0.01 * s.w_{c}), 4) AS mroi FROM s, base, bump"
        for c, k in (("urgent", "u"), ("high", "h"), ("low", "l"))
    ),
)
LEVELS = {"urgent": (0.0, 50000.0, 100000.0), "high": (0.0, 80000.0), "low": (1000.0,)}
register("t15_response_grid", lambda spark, sf_dir: response_grid(panel(spark, sf_dir), SPEC, COEF, LEVELS, "wk", ["geo"]).select("channel", "k", "level", r("response", 3)),
    f"WITH {PANEL}, t AS (SELECT sum(urgent) AS u, sum(high) AS h, sum(low) AS l FROM panel), g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, {k} AS k, {x}::DOUBLE AS level" for c, xs in LEVELS.items() for k, x in enumerate(xs)) + f"""),
        adst AS (SELECT {fir_sql('urgent', geometric_weights(4, 0.5))} AS au, {fir_sql('high', (0.7, 0.3))} AS ah, low AS al FROM panel)
        SELECT channel, k, level, round(sum(CASE channel WHEN 'urgent' THEN 900 * CASE WHEN au * level = 0 THEN 0 ELSE 1 / (1 + pow(400.0::DOUBLE / nullif(au * level / u, 0), 1.5)) END
            WHEN 'high' THEN 500 * (1 - exp(-0.002::DOUBLE * ah * level / h)) ELSE 20 * pow(al * level / l, 0.5) END), 3) AS response FROM g, t, adst GROUP BY ALL""")
FULL_SPEC = SPEC | {
    "medium": ChannelSpec(Adstock("geometric", 0.3, 3, normalise=False), Saturation("michaelis_menten", {"km": 500.0, "vmax": 1.0})),
    "spare": ChannelSpec(Adstock("delayed", 0.6, 4, peak=1, normalise=False), Saturation("hill", {"half_max": 700.0, "shape": 0.8})),
}
FULL_COEF = COEF | {"medium": 700.0, "spare": 650.0}


def allocated(spark, sf_dir):
    """All five channels, 200 steps."""
    found = allocate_budget(panel(spark, sf_dir), FULL_SPEC, FULL_COEF, "wk", by=["geo"], steps=200).table
    return found.select("channel", r("current_spend", 3), r("recommended_spend", 3), r("current_response", 3), r("recommended_response", 3))


#: Each channel's response in SQL, of its carried-over spend x.
RESPONSE = {
    "urgent": "900 * CASE WHEN x = 0 THEN 0 ELSE 1 / (1 + pow(400.0::DOUBLE / nullif(x, 0), 1.5)) END", "high": "500 * (1 - exp(-0.002::DOUBLE * x))", "low": "20 * pow(x, 0.5::DOUBLE)",
    "medium": "700 * CASE WHEN x = 0 THEN 0 ELSE 1 / (1 + 500.0::DOUBLE / nullif(x, 0)) END", "spare": "650 * CASE WHEN x = 0 THEN 0 ELSE 1 / (1 + pow(700.0::DOUBLE / nullif(x, 0), 0.8::DOUBLE)) END",
}
CARRIED = {"urgent": geometric_weights(4, 0.5), "high": (0.7, 0.3), "low": (1.0,), "medium": geometric_weights(3, 0.3), "spare": delayed_weights(4, 0.6, 1)}


def split_sql():
    """CTEs s0, s1...: (b, gain, picks): the best split of b increments over the first channels."""
    out = ["s0 AS (SELECT k AS b, response AS gain, [k] AS picks FROM grid WHERE channel = 'urgent')"]
    for i, c in enumerate(list(FULL_SPEC)[1:]):
        out.append(f"s{i + 1} AS (SELECT s.b + g.k AS b, max(s.gain + g.response) AS gain, arg_max(list_append(s.picks, g.k), s.gain + g.response) AS picks FROM s{i} s JOIN grid g ON g.channel = '{c}' AND s.b + g.k <= 200 GROUP BY 1)")
    return ", ".join(out)


register("t15_allocate_budget", allocated,
    f"""WITH {PANEL}, carried AS (SELECT {', '.join(f'{fir_sql(c, w)} AS {c}' for c, w in CARRIED.items())} FROM panel), long AS ({' UNION ALL '.join(f"SELECT '{c}' AS channel, {c} AS a FROM carried" for c in FULL_SPEC)}),
        cur AS ({' UNION ALL '.join(f"SELECT '{c}' AS channel, sum({c}) AS spend FROM panel" for c in FULL_SPEC)}), tot AS (SELECT sum(spend) AS total FROM cur),
        points AS (SELECT channel, k, total * k / 200 AS level, total * k / 200 / spend AS f FROM cur, tot, (SELECT unnest(range(201)) AS k) UNION ALL SELECT channel, -1, spend, 1 FROM cur),
        grid AS (SELECT channel, k, any_value(level) AS level, sum(CASE channel {' '.join(f"WHEN '{c}' THEN {e}" for c, e in RESPONSE.items())} END) AS response FROM (SELECT p.*, a * f AS x FROM long JOIN points p USING (channel)) GROUP BY 1, 2),
        {split_sql().replace("FROM grid WHERE", "FROM grid WHERE k >= 0 AND").replace("'  AND s.b", "' AND s.b").replace("AND s.b + g.k", "AND g.k >= 0 AND s.b + g.k")},
        won AS (SELECT picks FROM s4 WHERE b = 200), names AS (SELECT unnest({list(FULL_SPEC)}) AS channel, unnest(picks) AS k FROM won)
        SELECT n.channel, round(spend, 3) AS current_spend, round(g.level, 3) AS recommended_spend, round(c0.response, 3) AS current_response, round(g.response, 3) AS recommended_response
        FROM names n JOIN grid g ON g.channel = n.channel AND g.k = n.k JOIN cur ON cur.channel = n.channel JOIN grid c0 ON c0.channel = n.channel AND c0.k = -1""")
register("t16_reallocate", lambda spark, sf_dir: reallocate(panel(spark, sf_dir), "urgent", "low", 100.0, "geo").select("geo", "wk", r("urgent", 4), r("low", 4)),
    f"WITH {PANEL} SELECT geo, wk, round(urgent * (1 - 100 / sum(urgent) OVER w), 4) AS urgent, round(low + 100 * low / sum(low) OVER w, 4) AS low FROM panel WINDOW w AS (PARTITION BY geo)")


def decomposed(spark, sf_dir):
    return contributions(transform_plan(panel(spark, sf_dir), SPEC, "wk", ["geo"]), COEF, "wk", ["geo"], intercept=50.0)


LONG = " UNION ALL ".join(f"SELECT wk AS period, geo, '{c}' AS channel, {COEF[c]} * {t} AS contribution FROM trans" for c, t in (("urgent", "tu"), ("high", "th"), ("low", "tl"))) + " UNION ALL SELECT wk, geo, '(baseline)', 50.0::DOUBLE FROM trans"
register("w29_contributions", lambda spark, sf_dir: decomposed(spark, sf_dir).select("period", "geo", "channel", r("contribution")), f"WITH {PANEL}, {transformed_sql()}, long AS ({LONG}) SELECT period, geo, channel, round(contribution, 6) AS contribution FROM long")
register("w29_contributions_predicted", lambda spark, sf_dir: contributions(panel(spark, sf_dir, kpi=True).withColumnRenamed("kpi", "yhat"), {"urgent": 0.4, "low": 0.2}, "wk", ["geo"], prediction="yhat").select("period", "geo", "channel", r("contribution", 8)),
    f"WITH {PANEL}{KPI} SELECT wk AS period, geo, 'urgent' AS channel, round(0.4::DOUBLE * urgent, 8) AS contribution FROM full_panel UNION ALL SELECT wk, geo, 'low', round(0.2::DOUBLE * low, 8) FROM full_panel UNION ALL SELECT wk, geo, '(baseline)', round(kpi - 0.4::DOUBLE * urgent - 0.2::DOUBLE * low, 8) FROM full_panel")
def decomposed_later(spark, sf_dir):
    """Fitted on the weeks before 1999, decomposed after: what the model never saw, with its control in newdata."""
    df, cut = panel(spark, sf_dir, kpi=True), dt.date(1999, 1, 4)
    model = Pipeline(stages=[VectorAssembler(inputCols=["urgent", "medium"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="kpi", solver="normal")]).fit(df.where(F.col("wk") < cut))
    late = df.where(F.col("wk") >= cut)
    return contributions(late.select("geo", "wk", "urgent"), model, "wk", ["geo"], newdata=late)


register("w29_contributions_newdata", lambda spark, sf_dir: decomposed_later(spark, sf_dir).select("period", "geo", "channel", r("contribution", 3)),
    f"""WITH {PANEL}{KPI}, e AS (SELECT urgent - avg(urgent) OVER () AS u, medium - avg(medium) OVER () AS m, kpi - avg(kpi) OVER () AS k, avg(urgent) OVER () AS au, avg(medium) OVER () AS am, avg(kpi) OVER () AS ak FROM full_panel WHERE wk < DATE '1999-01-04'),
        s AS (SELECT sum(u * u) AS uu, sum(u * m) AS um, sum(m * m) AS mm, sum(u * k) AS uk, sum(m * k) AS mk, any_value(au) AS au, any_value(am) AS am, any_value(ak) AS ak FROM e),
        b AS (SELECT *, (mm * uk - um * mk) / (uu * mm - um * um) AS bu, (uu * mk - um * uk) / (uu * mm - um * um) AS bm FROM s), late AS (SELECT * FROM full_panel WHERE wk >= DATE '1999-01-04')
        SELECT wk AS period, geo, 'urgent' AS channel, round(bu * urgent, 3) AS contribution FROM late, b UNION ALL SELECT wk, geo, '(baseline)', round(ak - bu * au - bm * am + bm * medium, 3) FROM late, b""")
register("a18_roi", lambda spark, sf_dir: roi(decomposed(spark, sf_dir), panel(spark, sf_dir).select("geo", "wk", *SPEC).where(F.col("wk") >= dt.date(1996, 1, 1)), "wk", ["geo"]).select("geo", "channel", r("contribution", 3), r("spend", 3), r("roi")),
    f"""WITH {PANEL}, {transformed_sql()}, long AS ({LONG}), sp2 AS (SELECT wk AS period, geo, unnest(['urgent', 'high', 'low']) AS channel, unnest([urgent, high, low]) AS spend FROM panel WHERE wk >= DATE '1996-01-01')
        SELECT geo, channel, round(sum(contribution), 3) AS contribution, round(sum(spend), 3) AS spend, round(sum(contribution) / sum(spend), 6) AS roi FROM long JOIN sp2 USING (period, geo, channel) GROUP BY ALL""")
register("plot_contribution_bands", lambda spark, sf_dir: contribution_bands(decomposed(spark, sf_dir), most=3).select("period", "band", r("contribution", 4)),
    f"""WITH {PANEL}, {transformed_sql()}, long AS ({LONG}), size AS (SELECT channel, row_number() OVER (ORDER BY sum(abs(contribution)) DESC, channel) AS n FROM long GROUP BY 1)
        SELECT period, CASE WHEN n >= 3 THEN 'Other' ELSE channel END AS band, round(sum(contribution), 4) AS contribution FROM long JOIN size USING (channel) GROUP BY ALL""")

CURVES = {
    "f7_hill": ("hill", {"half_max": 150000.0, "shape": 1.6}, "CASE WHEN x = 0 THEN 0 ELSE 1 / (1 + pow(150000.0::DOUBLE / nullif(x, 0), 1.6)) END"),
    "f8_exponential": ("exponential", {"rate": 0.00001}, "1 - exp(-0.00001::DOUBLE * x)"),
    "f9_michaelis_menten": ("michaelis_menten", {"km": 120000.0, "vmax": 2.0}, "CASE WHEN x = 0 THEN 0 ELSE 2 / (1 + 120000.0::DOUBLE / nullif(x, 0)) END"),
    "f10_power": ("power", {"exponent": 0.4}, "pow(x, 0.4)"),
}
for _name, (_type, _p, _sql) in CURVES.items():
    register(_name, lambda spark, sf_dir, t=_type, p=_p: spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(saturate(F.col("o_totalprice"), t, **p), 6).alias("y")), f"SELECT o_orderkey, round({_sql}, 6) AS y FROM (SELECT o_orderkey, o_totalprice AS x FROM orders)")
register("f12_mroi", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(1e6 * mroi_column(F.col("o_totalprice"), 10.0, "michaelis_menten", km=100000.0), 4).alias("slope")),
    "SELECT o_orderkey, round(1e6::DOUBLE * 10 * ((x * 1.01::DOUBLE) / (x * 1.01::DOUBLE + 100000) - (x * 0.99::DOUBLE) / (x * 0.99::DOUBLE + 100000)) / (0.02::DOUBLE * x), 4) AS slope FROM (SELECT o_orderkey, o_totalprice AS x FROM orders)")
register("f15_fourier_terms", lambda spark, sf_dir: fourier_terms(panel(spark, sf_dir).select("geo", "wk"), "wk").select("geo", "wk", *[r(f"fourier_{f}{k}") for k in (1, 2) for f in ("sin", "cos")]),
    f"WITH {PANEL}, t AS (SELECT geo, wk, (dayofyear(wk) - 1) / 365.25::DOUBLE AS t FROM panel) SELECT geo, wk, " + ", ".join(f"round({f}({2 * math.pi * k!r}::DOUBLE * t), 6) AS fourier_{f}{k}" for k in (1, 2) for f in ("sin", "cos")) + " FROM t")
HOLIDAYS = {"newyear": [dt.date(y, 1, 1) for y in range(1995, 2003)], "midyear": [dt.date(1997, 7, 4), dt.date(1999, 7, 5)]}
register("f16_holiday_flags", lambda spark, sf_dir: holiday_flags(panel(spark, sf_dir).select("geo", "wk"), "wk", HOLIDAYS),
    f"WITH {PANEL} SELECT geo, wk, " + ", ".join("(" + " OR ".join(f"(DATE '{d}' >= wk AND DATE '{d}' < wk + 7)" for d in ds) + f")::INT AS holiday_{n}" for n, ds in HOLIDAYS.items()) + " FROM panel")
register("f16_holiday_flags_end", lambda spark, sf_dir: holiday_flags(panel(spark, sf_dir).select("geo", "wk"), "wk", HOLIDAYS, align="end"),
    f"WITH {PANEL} SELECT geo, wk, " + ", ".join("(" + " OR ".join(f"(DATE '{d}' > wk - 7 AND DATE '{d}' <= wk)" for d in ds) + f")::INT AS holiday_{n}" for n, ds in HOLIDAYS.items()) + " FROM panel")
def monthly_flags(spark, sf_dir):
    """An index of months, of which the length of a period is inferred."""
    months = panel(spark, sf_dir).select("geo", F.trunc("wk", "month").alias("month")).distinct()
    return holiday_flags(months, "month", HOLIDAYS)


register("f16_holiday_flags_monthly", monthly_flags,
    f"""WITH {PANEL}, m AS (SELECT DISTINCT geo, date_trunc('month', wk)::DATE AS month FROM panel), d AS (SELECT DISTINCT month FROM m), s AS (SELECT month - lag(month) OVER (ORDER BY month) AS step FROM d), p AS (SELECT median(step) AS period FROM s)
        SELECT geo, month, """ + ", ".join("(" + " OR ".join(f"(DATE '{d}' >= month AND DATE '{d}' - month < period)" for d in ds) + f")::INT AS holiday_{n}" for n, ds in HOLIDAYS.items()) + " FROM m, p")
register("p18_saturation_step", lambda spark, sf_dir: (lambda df: SaturationStep({"urgent": Curve("hill", 0.4, 2.0), "low": Curve("power", exponent=0.5)}, ["geo"], "q95").fit(df).transform(df).select("geo", "wk", r("urgent"), r("low")))(panel(spark, sf_dir)),
    f"""WITH {PANEL}, ref AS (SELECT geo, quantile_cont(urgent, 0.95) AS ru, quantile_cont(low, 0.95) AS rl FROM panel GROUP BY geo)
        SELECT geo, wk, round(CASE WHEN urgent = 0 THEN 0 ELSE 1 / (1 + pow(0.4::DOUBLE * ru / nullif(urgent, 0), 2)) END, 6) AS urgent, round(pow(low / rl, 0.5), 6) AS low FROM panel JOIN ref USING (geo)""")
register("a27_reference_levels", lambda spark, sf_dir: reference_levels(panel(spark, sf_dir), CHANNELS, "q99", ["geo"]).select("geo", *[r(c, 4) for c in CHANNELS]), f"WITH {PANEL} SELECT geo, " + ", ".join(f"round(quantile_cont({c}, 0.99), 4) AS {c}" for c in CHANNELS) + " FROM panel GROUP BY geo")


def step_continues(spark, sf_dir):
    df, cut = panel(spark, sf_dir), F.lit(dt.date(1999, 1, 1))
    model = AdstockStep({"urgent": GEO, "low": KERNELS["w14_weibull_cdf"][0]}, "wk", ["geo"], carry_over="warm").fit(df.where(F.col("wk") < cut))
    return model.transform(df.where(F.col("wk") >= cut)).select("geo", "wk", r("adstock_urgent", 4), r("adstock_low", 4))


register("w26_adstock_step", step_continues,
    f"""WITH {PANEL}, {iir_sql('panel', 'urgent', 0.6)}, f AS (SELECT geo, wk, {fir_sql('low', weibull_weights(8, 2, 3))} AS l FROM panel)
        SELECT geo, wk, round(a, 4) AS adstock_urgent, round(l, 4) AS adstock_low FROM iir JOIN f USING (geo, wk) WHERE wk >= DATE '1999-01-01'""")
register("a20_variation", lambda spark, sf_dir: variation(panel(spark, sf_dir), CHANNELS, ["geo"]).select("channel", r("mean", 4), r("sd", 4), r("cv"), "distinct", r("zero_share")),
    f"""WITH {PANEL}, l AS (SELECT geo, unnest({CHANNELS}) AS channel, unnest([{', '.join(CHANNELS)}]) AS x FROM panel), g AS (SELECT geo, channel, avg(x) AS m, stddev_samp(x) AS s, count(DISTINCT x) AS d, avg((x = 0)::INT) AS z FROM l GROUP BY ALL)
        SELECT channel, round(avg(m), 4) AS mean, round(avg(s), 4) AS sd, round(min(s / abs(m)), 6) AS cv, min(d) AS "distinct", round(max(z), 6) AS zero_share FROM g GROUP BY 1""")
R3 = "corr(urgent, high) AS a, corr(urgent, low) AS b, corr(high, low) AS c"
VIF3 = """d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM g), v AS (SELECT unnest(['urgent', 'high', 'low']) AS channel, unnest([(1 - c * c) / det, (1 - b * b) / det, (1 - a * a) / det]) AS v FROM d)
    SELECT channel, round(max(v), 6) AS vif FROM v GROUP BY 1"""
register("a21_vif", lambda spark, sf_dir: vif(panel(spark, sf_dir), ["urgent", "high", "low"], ["geo"]).select("channel", r("vif")), f"WITH {PANEL}, g AS (SELECT {R3} FROM panel GROUP BY geo), {VIF3}")
register("a26_diagnosis_carried", lambda spark, sf_dir: diagnose_media(panel(spark, sf_dir), ["urgent", "high", "low"], ["geo"], date="wk", decay={"urgent": 0.6, "low": 0.3}).collinearity.select("channel", r("vif")),
    f"""WITH {PANEL}, ul AS (WITH {iir_sql('panel', 'urgent', 0.6)} SELECT geo, wk, a FROM iir), ll AS (WITH {iir_sql('panel', 'low', 0.3)} SELECT geo, wk, a FROM iir),
        carried AS (SELECT p.geo, p.wk, ul.a AS urgent, high, ll.a AS low FROM panel p JOIN ul ON ul.geo = p.geo AND ul.wk = p.wk JOIN ll ON ll.geo = p.geo AND ll.wk = p.wk), g AS (SELECT {R3} FROM carried GROUP BY geo), {VIF3}""")
PAIRS = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i + 1 :]]
register("a22_correlations", lambda spark, sf_dir: correlations(panel(spark, sf_dir), CHANNELS, ["geo"]).select("channel", "partner", r("r")),
    f"""WITH {PANEL}, g AS (SELECT {', '.join(f'corr({a}, {b}) AS {a}_{b}' for a, b in PAIRS)} FROM panel GROUP BY geo),
        l AS (SELECT unnest({[x for a, b in PAIRS for x in (a, b)]}) AS channel, unnest({[x for a, b in PAIRS for x in (b, a)]}) AS partner, unnest([{', '.join(f'{a}_{b}, {a}_{b}' for a, b in PAIRS)}]) AS r FROM g)
        SELECT channel, arg_max(partner, abs(r)) AS partner, round(arg_max(r, abs(r)), 6) AS r FROM l GROUP BY 1""")
register("a23_cpm_outliers", lambda spark, sf_dir: cpm_outliers(panel(spark, sf_dir), "urgent", "n", "wk", ["geo"]).select("geo", "wk", r("cpm"), r("median"), "outlier"),
    f"""WITH {PANEL}, c AS (SELECT geo, wk, urgent / n * 1000 AS cpm FROM panel WHERE n > 0), m AS (SELECT *, median(cpm) OVER (PARTITION BY geo) AS med FROM c), d AS (SELECT *, 1.4826 * median(abs(cpm - med)) OVER (PARTITION BY geo) AS mad FROM m)
        SELECT geo, wk, round(cpm, 6) AS cpm, round(med, 6) AS median, CASE WHEN mad > 0 THEN abs(cpm - med) > 5 * mad ELSE cpm > 2 * med OR cpm < med / 2 END AS outlier FROM d""")
def audited(spark, sf_dir):
    """The weeks with orders, some of them twice, in an order that goes back at times."""
    weeks = sparse(spark, sf_dir).select("geo", "wk", F.unix_date("wk").alias("day"))
    rows = weeks.withColumn("place", (F.col("day") % 35) * 100000 + F.col("day"))
    return date_audit(rows.unionByName(weeks.where("day % 11 = 0").withColumn("place", F.col("day") + 10000000)), "wk", ["geo"], row_order="place")


register("a24_date_audit", audited,
    f"""WITH {PANEL}, d AS (SELECT geo, (wk - DATE '1970-01-01') AS day FROM sp), rows AS (SELECT geo, day, (day % 35) * 100000 + day AS place FROM d UNION ALL SELECT geo, day, day + 10000000 FROM d WHERE day % 11 = 0),
        b AS (SELECT *, day < lag(day) OVER (PARTITION BY geo ORDER BY place) AS back FROM rows), c AS (SELECT geo, day::DOUBLE AS t, count(*) AS n, count(*) FILTER (back) AS back FROM b GROUP BY ALL),
        g AS (SELECT *, t - lag(t) OVER (PARTITION BY geo ORDER BY t) AS step FROM c), m AS (SELECT *, median(step) OVER (PARTITION BY geo) AS period, step / median(step) OVER (PARTITION BY geo) AS ratio FROM g)
        SELECT geo, sum(n)::BIGINT AS rows, min(t) AS start, max(t) AS "end", max(period) AS period, sum(back)::BIGINT AS out_of_order, sum(n - 1)::BIGINT AS duplicated, coalesce(sum(greatest(round(ratio) - 1, 0)), 0)::BIGINT AS missing,
               count(*) FILTER (abs(ratio - greatest(1, round(ratio))) > 0.25) AS irregular FROM m GROUP BY geo""")
#: How each geo's new rows join on: a day's shift, the weeks its history lacks, and where the new rows start.
JOINS = {"AFRICA": (0, "1998-01-05"), "AMERICA": (0, "1997-06-02"), "ASIA": (0, "1999-03-01"), "EUROPE": (3, "1997-06-02")}


def joined_on(spark, sf_dir):
    """Five of the six classes: the history of MIDDLE EAST is left out, EUROPE's new rows are shifted by days."""
    df, cut = panel(spark, sf_dir).select("geo", "wk"), dt.date(1998, 1, 5)
    history = df.where((F.col("wk") < cut) & (F.col("geo") != "MIDDLE EAST"))
    starts = F.create_map(*[F.lit(x) for geo, (_, start) in JOINS.items() for x in (geo, start)])
    shifts = F.create_map(*[F.lit(x) for geo, (days, _) in JOINS.items() for x in (geo, days)])
    late = df.where(F.col("wk") >= F.coalesce(F.element_at(starts, F.col("geo")), F.lit("1998-01-05")).cast("date"))
    return carry_class(history, late.withColumn("wk", F.date_add("wk", F.coalesce(F.element_at(shifts, F.col("geo")), F.lit(0)))), "wk", ["geo"])


register("w24_carry_class", joined_on,
    f"""WITH {PANEL}, how AS (SELECT unnest({list(JOINS)}) AS geo, unnest({[d for d, _ in JOINS.values()]}) AS days, unnest({[s for _, s in JOINS.values()]})::DATE AS start),
        old AS (SELECT geo, wk FROM panel WHERE wk < DATE '1998-01-05' AND geo <> 'MIDDLE EAST'),
        fresh AS (SELECT p.geo, min(p.wk + coalesce(days, 0)::INT) AS first FROM panel p LEFT JOIN how h ON p.geo = h.geo WHERE p.wk >= coalesce(start, DATE '1998-01-05') GROUP BY p.geo),
        steps AS (SELECT geo, wk - lag(wk) OVER (PARTITION BY geo ORDER BY wk) AS step FROM old), own AS (SELECT geo, median(step) AS period FROM steps GROUP BY geo),
        met AS (SELECT f.geo, first, max(o.wk) AS last, max(o.wk) FILTER (o.wk < first) AS before, coalesce(bool_or(o.wk = first), false) AS same FROM fresh f LEFT JOIN old o ON o.geo = f.geo GROUP BY ALL)
        SELECT m.geo, CASE WHEN last IS NULL THEN 'unseen' WHEN before IS NULL OR same THEN 'overlap' WHEN (first - before) / period < 0.75 THEN 'misaligned' WHEN (first - before) / period > 1.25 THEN 'gap'
                           WHEN before < last THEN 'overlap' ELSE 'contiguous' END AS carry FROM met m LEFT JOIN own ON own.geo = m.geo""")
register("a28_fit_ols", lambda spark, sf_dir: panel(spark, sf_dir, kpi=True).groupBy("geo").agg(ols(F.col("urgent"), F.col("kpi")).alias("f")).select("geo", "f.n", r("f.intercept", 4).alias("intercept"), F.round("f.slope", 6).alias("slope")),
    f"WITH {PANEL}{KPI} SELECT geo, count(*) AS n, round(regr_intercept(kpi, urgent), 4) AS intercept, round(regr_slope(kpi, urgent), 6) AS slope FROM full_panel GROUP BY geo")
register("a29_metrics", lambda spark, sf_dir: panel(spark, sf_dir, kpi=True).groupBy("geo").agg(F.round(rmse(F.col("kpi"), F.col("urgent")), 4).alias("rmse"), F.round(mae(F.col("kpi"), F.col("urgent")), 4).alias("mae")),
    f"WITH {PANEL}{KPI} SELECT geo, round(sqrt(avg(pow(kpi - urgent, 2))), 4) AS rmse, round(avg(abs(kpi - urgent)), 4) AS mae FROM full_panel GROUP BY geo")
CANDIDATES = grid((8,))  # all decays of the default grid


def carried_sql(x):
    return " UNION ALL ".join(f"SELECT {i} AS candidate, geo, period, kpi AS y, medium AS c, {fir_sql(x, geometric_weights(int(k.max_lag), k.decay, True))} AS z FROM per" for i, k in enumerate(CANDIDATES))


CV = f"""WITH {PANEL}{KPI}, per AS (SELECT *, dense_rank() OVER (ORDER BY wk) AS period FROM full_panel), z AS ({carried_sql('urgent')}), """


def least_squares_sql(table, regressors):
    """CTE fits (candidate, a, b0, b1...): y on one or two regressors over all periods up to a, by running sums about the means."""
    names = ["y", *regressors]
    pairs = [(p, q) for i, p in enumerate(names) for q in names[i:]]
    d = {x: f"({x} - m_{x})" for x in names}
    sums = [f"sum({d[x]}) AS s_{x}" for x in names] + [f"sum({d[p]} * {d[q]}) AS s_{p}_{q}" for p, q in pairs]
    cols = ["n", *[f"s_{x}" for x in names], *[f"s_{p}_{q}" for p, q in pairs]]
    v = lambda p, q: f"(s_{p}_{q} - s_{p} * s_{q} / n)"
    if len(regressors) == 1:
        (x,) = regressors
        slopes = {x: f"{v('y', x)} / {v(x, x)}"}
    else:
        x, w = regressors
        det = f"({v(x, x)} * {v(w, w)} - {v(x, w)} * {v(x, w)})"
        slopes = {x: f"({v(w, w)} * {v('y', x)} - {v(x, w)} * {v('y', w)}) / {det}", w: f"({v(x, x)} * {v('y', w)} - {v(x, w)} * {v('y', x)}) / {det}"}
    return f"""means AS (SELECT candidate, {', '.join(f'avg({x}) AS m_{x}' for x in names)} FROM {table} GROUP BY 1),
        per_sums AS (SELECT candidate, period, count(*)::DOUBLE AS n, {', '.join(f'any_value(m_{x}) AS m_{x}' for x in names)}, {', '.join(sums)} FROM {table} JOIN means USING (candidate) GROUP BY 1, 2),
        run AS (SELECT candidate, period, {', '.join(f'm_{x}' for x in names)}, {', '.join(f'sum({c}) OVER k AS {c}' for c in cols)} FROM per_sums WINDOW k AS (PARTITION BY candidate ORDER BY period)),
        slopes AS (SELECT *, {', '.join(f'{e} AS b_{x}' for x, e in slopes.items())} FROM run),
        fits AS (SELECT candidate, period AS a, m_y + s_y / n - {' - '.join(f'b_{x} * (m_{x} + s_{x} / n)' for x in regressors)} AS b0, {', '.join(f'b_{x}' for x in regressors)} FROM slopes)"""


def tested_sql(table, regressors, initial, assess):
    """CTEs fits and tested (candidate, split, geo, period, y, predicted)."""
    return least_squares_sql(table, regressors) + f""",
        cuts AS (SELECT unnest(range({initial}, (SELECT max(period) FROM per) - {assess - 1})) AS a),
        tested AS (SELECT t.candidate, a - {initial} AS split, t.geo, t.period, y, b0 + {' + '.join(f'b_{x} * {x}' for x in regressors)} AS predicted
                   FROM fits JOIN cuts USING (a) JOIN {table} t ON t.candidate = fits.candidate AND t.period > a AND t.period <= a + {assess})"""


def cross_validated(spark, sf_dir):
    df = panel(spark, sf_dir, kpi=True)
    rows = filtered(df, "urgent", "kpi", "wk", CANDIDATES, ["geo"])
    return rows, splits(df.select("wk").distinct().count(), initial=200, assess=4)


def search(spark, sf_dir, controls=()):
    return tune_carryover(panel(spark, sf_dir, kpi=True), "urgent", "kpi", "wk", ["geo"], CANDIDATES, initial=200, assess=4, controls=list(controls))


def tuned(spark, sf_dir, controls=()):
    """The metric of every candidate, its jackknife error and that of its difference from the best."""
    found = search(spark, sf_dir, controls).results
    return spark.createDataFrame(found[["candidate", "metric", "std_err", "paired_err"]], "candidate int, metric double, std_err double, paired_err double").select("candidate", *[r(c, 4) for c in ("metric", "std_err", "paired_err")])


def picked(spark, sf_dir):
    found = search(spark, sf_dir)
    return spark.createDataFrame([("best", found.best.decay, float(found.best.max_lag)), ("best_1se", found.best_1se.decay, float(found.best_1se.max_lag))], "pick string, decay double, max_lag double")


#: scores (candidate, metric, std_err, paired_err): the whole and what is left without each split.
SCORES = """losses AS (SELECT candidate, split, sum(pow(y - predicted, 2)) AS s, count(*) AS n FROM tested GROUP BY 1, 2),
    whole AS (SELECT candidate, sqrt(sum(s) / sum(n)) AS metric, sum(s) AS s, sum(n) AS n FROM losses GROUP BY 1), top AS (SELECT arg_min(candidate, metric) AS best, min(metric) AS least FROM whole),
    theta AS (SELECT l.candidate, l.split, sqrt((w.s - l.s) / (w.n - l.n)) AS t FROM losses l JOIN whole w USING (candidate)),
    errs AS (SELECT t.candidate, sqrt((count(*) - 1)::DOUBLE / count(*) * (count(*) * var_pop(t.t))) AS std_err, sqrt((count(*) - 1)::DOUBLE / count(*) * (count(*) * var_pop(t.t - b.t))) AS paired_err
             FROM theta t JOIN theta b ON b.split = t.split AND b.candidate = (SELECT best FROM top) GROUP BY 1)"""
TUNED = f"{SCORES} SELECT candidate, round(metric, 4) AS metric, round(std_err, 4) AS std_err, round(paired_err, 4) AS paired_err FROM whole JOIN errs USING (candidate)"
register("t4_expanding_fits", lambda spark, sf_dir: expanding_fits(cross_validated(spark, sf_dir)[0]).where("period > 2").select("candidate", "period", r("intercept", 3), r("slope", 5)),
    CV + least_squares_sql("z", ["z"]) + " SELECT candidate, a::INT AS period, round(b0, 3) AS intercept, round(b_z, 5) AS slope FROM fits WHERE a > 2")
register("t1_tune_carryover", tuned, CV + tested_sql("z", ["z"], 200, 4) + ", " + TUNED)
register("t5_controls", lambda spark, sf_dir: tuned(spark, sf_dir, ("medium",)), CV + tested_sql("z", ["z", "c"], 200, 4) + ", " + TUNED)
register("t8_one_standard_error", picked, CV + tested_sql("z", ["z"], 200, 4) + f""", {SCORES},
    grid AS (SELECT unnest(range({len(CANDIDATES)})) AS candidate, unnest({[k.decay for k in CANDIDATES]}) AS decay)
    SELECT 'best' AS pick, decay::DOUBLE AS decay, 8.0::DOUBLE AS max_lag FROM grid JOIN top ON candidate = best
    UNION ALL SELECT 'best_1se', min(decay)::DOUBLE, 8.0::DOUBLE FROM grid JOIN whole USING (candidate) JOIN errs USING (candidate), top WHERE metric - least <= paired_err""")
register("t11_predictions", lambda spark, sf_dir: predictions(*cross_validated(spark, sf_dir)).select("candidate", "split", "geo", "period", r("y", 4), r("predicted", 3)),
    CV + tested_sql("z", ["z"], 200, 4) + " SELECT candidate, split::INT AS split, geo, period::INT AS period, round(y, 4) AS y, round(predicted, 3) AS predicted FROM tested")


def search_jointly(spark, sf_dir):
    return tune_carryover_joint(panel(spark, sf_dir, kpi=True), ["urgent", "low"], "kpi", "wk", ["geo"], CANDIDATES, initial=250, assess=10)


def tuned_jointly(spark, sf_dir):
    found = search_jointly(spark, sf_dir)
    return spark.createDataFrame(sorted((c, k.decay, found.metric) for c, k in found.best.items()), "channel string, decay double, metric double").select("channel", "decay", r("metric", 4))


def joint_profiles(spark, sf_dir):
    found = search_jointly(spark, sf_dir).profiles[["channel", "candidate", "metric"]]
    return spark.createDataFrame(found, "channel string, candidate int, metric double").select("channel", "candidate", r("metric", 4))


#: pairs (u, l, metric): every pair of candidates by normal equations; walk: one channel's best beside the other's, in turns.
JOINT = f"""WITH RECURSIVE {PANEL}{KPI}, per AS (SELECT *, dense_rank() OVER (ORDER BY wk) AS period FROM full_panel), zu AS ({carried_sql('urgent')}), zl AS ({carried_sql('low')}),
    paired AS (SELECT zu.candidate * 100 + zl.candidate AS candidate, geo, period, zu.y AS y, zu.z AS z, zl.z AS w FROM zu JOIN zl USING (geo, period)), {tested_sql('paired', ['z', 'w'], 250, 10)},
    pairs AS (SELECT candidate // 100 AS u, candidate % 100 AS l, sqrt(avg(pow(y - predicted, 2))) AS metric FROM tested GROUP BY candidate),
    best_u AS (SELECT l, arg_min(u, metric) AS u FROM pairs GROUP BY l), best_l AS (SELECT u, arg_min(l, metric) AS l FROM pairs GROUP BY u),
    walk AS (SELECT 0 AS i, {len(CANDIDATES) // 2}::BIGINT AS u, {len(CANDIDATES) // 2}::BIGINT AS l UNION ALL
             SELECT i + 1, CASE WHEN i % 2 = 0 THEN b.u ELSE w.u END, CASE WHEN i % 2 = 1 THEN c.l ELSE w.l END FROM walk w JOIN best_u b ON b.l = w.l JOIN best_l c ON c.u = w.u WHERE i < 20),
    fin AS (SELECT u, l, metric FROM walk JOIN pairs USING (u, l) WHERE i = 20),
    grid AS (SELECT unnest(range({len(CANDIDATES)})) AS candidate, unnest({[k.decay for k in CANDIDATES]}) AS decay)"""
register("t12_tune_joint", tuned_jointly, f"""{JOINT} SELECT 'urgent' AS channel, decay::DOUBLE AS decay, round(metric, 4) AS metric FROM fin JOIN grid ON candidate = u UNION ALL SELECT 'low', decay::DOUBLE, round(metric, 4) FROM fin JOIN grid ON candidate = l""")
register("t12_joint_profiles", joint_profiles, f"""{JOINT} SELECT 'urgent' AS channel, p.u::INT AS candidate, round(p.metric, 4) AS metric FROM pairs p JOIN fin ON p.l = fin.l UNION ALL SELECT 'low', p.l::INT, round(p.metric, 4) FROM pairs p JOIN fin ON p.u = fin.u""")
register("t13_block_bootstrap", lambda spark, sf_dir: block_bootstrap(panel(spark, sf_dir), lambda d: {"mean_urgent": d["urgent"].mean(), "mean_low": d["low"].mean()}, "wk", by=["geo"])[0])
register("s6_import_hyper", lambda spark, sf_dir: (lambda s: spark.createDataFrame([(s.adstock.decay, s.saturation.parameters["half_max"], s.saturation.parameters["shape"])], "decay double, half_max double, shape double").select("decay", r("half_max", 4), "shape"))(from_theta_alpha_gamma(panel(spark, sf_dir).where("geo = 'ASIA'"), "urgent", "wk", theta=0.3, alpha=2.0, gamma=0.4)),
    f"WITH {PANEL}, asia AS (SELECT * FROM panel WHERE geo = 'ASIA'), {iir_sql('asia', 'urgent', 0.3)} SELECT 0.3::DOUBLE AS decay, round(0.4::DOUBLE * max(a), 4) AS half_max, 2.0::DOUBLE AS shape FROM iir")
register("a19_unmatched_cells", lambda spark, sf_dir: unmatched(decomposed(spark, sf_dir).where(F.col("period") < dt.date(2000, 1, 1)), panel(spark, sf_dir).select("geo", "wk", *SPEC).where(F.col("wk") >= dt.date(1996, 1, 1)), "wk", ["geo"]),
    f"WITH {PANEL} SELECT wk AS period, geo, CASE WHEN wk < DATE '1996-01-01' THEN 'spend' ELSE 'contribution' END AS missing FROM panel WHERE wk < DATE '1996-01-01' OR wk >= DATE '2000-01-01'")
def channels_apart(spark, sf_dir):
    """Contributions of three channels and spend of others, of which one is the same."""
    return unmatched_channels(decomposed(spark, sf_dir), panel(spark, sf_dir).select("geo", "wk", "urgent", "medium"), "wk", ["geo"])


register("j6_unmatched_channels", channels_apart,
    f"WITH {PANEL}, {transformed_sql()}, long AS ({LONG}), l AS (SELECT DISTINCT channel FROM long WHERE channel <> '(baseline)'), r AS (SELECT unnest(['urgent', 'medium']) AS channel) SELECT coalesce(l.channel, r.channel) AS channel, CASE WHEN l.channel IS NULL THEN 'contribution' ELSE 'spend' END AS missing FROM l FULL JOIN r ON l.channel = r.channel WHERE l.channel IS NULL OR r.channel IS NULL")


def orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def vocabulary(spark, sf_dir):
    """A half-life of 1 to 52 weeks for each order, as its decay, back again, and the window of half its carryover."""
    h = (1 + F.col("o_orderkey") % 52).cast("double")
    rows = orders(spark, sf_dir).select("o_orderkey", decay_column(h).alias("decay"))
    return rows.select("o_orderkey", r("decay"), F.round(half_life_column(F.col("decay")), 6).alias("back"), effective_window_column(F.col("decay"), 0.5).alias("window50"))


register("f1_decay_vocabulary", vocabulary, "SELECT o_orderkey, round(pow(0.5::DOUBLE, 1.0::DOUBLE / (1 + o_orderkey % 52)), 6) AS decay, (1 + o_orderkey % 52)::DOUBLE AS back, (1 + o_orderkey % 52)::BIGINT AS window50 FROM orders")
register("f14_spend_for", lambda spark, sf_dir: orders(spark, sf_dir).select("o_orderkey", F.round(spend_for_column(F.col("o_totalprice") % 95, 100.0, "hill", half_max=50.0, shape=2.0), 6).alias("spend")),
    "SELECT o_orderkey, round(50 * pow((o_totalprice % 95) / 100 / (1 - (o_totalprice % 95) / 100), 0.5::DOUBLE), 6) AS spend FROM orders")
register("f13_response_curve", lambda spark, sf_dir: response_curve(panel(spark, sf_dir), "urgent", 40.0, "hill", half_max=300.0, shape=1.5).select(r("spend"), r("response"), r("slope")),
    f"""WITH {PANEL}, x AS (SELECT urgent AS x FROM panel), h AS (SELECT x, greatest(x * 0.01::DOUBLE, pow(2.220446049250313e-16::DOUBLE, 1 / 3.0::DOUBLE) * 300) AS h FROM x),
       e AS (SELECT x, greatest(0, x - h) AS lo, x + h AS hi FROM h), f AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE 1 / (1 + pow(300 / nullif(x, 0), 1.5)) END AS y, CASE WHEN lo = 0 THEN 0 ELSE 1 / (1 + pow(300 / nullif(lo, 0), 1.5)) END AS a, 1 / (1 + pow(300 / hi, 1.5)) AS b FROM e)
       SELECT round(x, 6) AS spend, round(40 * y, 6) AS response, round(40 * (b - a) / (hi - lo), 6) AS slope FROM f""")
#: Kernels, each with its weights in SQL as a function of the lag l.
BY_LAG = {
    "f4_geometric_weights": (Adstock("geometric", 0.8, 12, normalise=True), "pow(0.8::DOUBLE, l)", "sum"),
    "f5_weibull_weights": (Adstock("weibull", max_lag=8, shape=2, scale=3, type="pdf", normalise=False), "(2.0::DOUBLE / 3) * ((l + 1) / 3.0::DOUBLE) * exp(-pow((l + 1) / 3.0::DOUBLE, 2))", "max"),
    "f6_delayed_weights": (Adstock("delayed", 0.7, 6, peak=2, normalise=True), "pow(0.7::DOUBLE, (l - 2) * (l - 2))", "sum"),
}
for _name, (_kernel, _sql, _over) in BY_LAG.items():
    register(
        _name,
        lambda spark, sf_dir, k=_kernel: carried_by_lag(panel(spark, sf_dir), "urgent", k, "wk", ["geo"]).select("geo", "lag", r("weight"), r("carried", 4)),
        f"""WITH {PANEL}, k AS (SELECT l, {_sql} AS f FROM range({int(_kernel.lags)}) t(l)), w AS (SELECT l, f / (SELECT {_over}(f) FROM k) AS w FROM k), o AS (SELECT geo, urgent, row_number() OVER (PARTITION BY geo ORDER BY wk DESC) - 1 AS rest FROM panel)
            SELECT geo, l::INT AS lag, round(any_value(w), 6) AS weight, round(any_value(w) * sum(urgent), 4) AS carried FROM o JOIN w ON l <= rest GROUP BY geo, l""",
    )


def carried_by_candidate(spark, sf_dir):
    """What each candidate of the grid makes of the spend of each geo."""
    decays = F.array(*[F.lit(k.decay) for k in CANDIDATES])
    rows = filtered(panel(spark, sf_dir, kpi=True), "urgent", "kpi", "wk", CANDIDATES, ["geo"])
    return rows.groupBy("geo", F.element_at(decays, F.col("candidate") + 1).alias("decay")).agg(F.round(F.sum("z"), 4).alias("carried"))


register("t1_grid", carried_by_candidate, CV.rstrip(", ") + " SELECT geo, round(0.1::DOUBLE + candidate * 0.05::DOUBLE, 2) AS decay, round(sum(z), 4) AS carried FROM z GROUP BY ALL")
register("s2_touchpoints", lambda spark, sf_dir: touchpoints(spark, spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")))
register("s2_weekly_panel", lambda spark, sf_dir: weekly_panel(spark, geos=spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("geo"), (1 + F.col("n_nationkey") / 10).alias("size"))))
