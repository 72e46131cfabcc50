"""Seeded look-alikes of the two example tables: a touchpoint log and a weekly media panel."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendtrail.functions.saturation import saturate_hill
from spendtrail.operators.adstock import Adstock, adstock

#: Fixed values of the panel: kernel decay, half-saturation, curve shape and effect of each channel.
TRUTH = {
    "tv": (0.85, 2250, 1.6, 5200),
    "video": (0.70, 600, 1.0, 2400),
    "search": (0.15, 450, 1.0, 4100),
    "social": (0.45, 350, 1.0, 1800),
    "display": (0.55, 300, 1.0, 900),
}
GEOS = {"north": 1.0, "central": 0.72, "south": 1.35}
#: Fixed values of the log: how likely each channel opens and closes a journey; touches between go from one mix to the other.
OPENING = {"paid_search": 0.10, "organic_search": 0.14, "social": 0.26, "display": 0.32, "email": 0.06, "affiliate": 0.12}
CLOSING = {"paid_search": 0.34, "organic_search": 0.22, "social": 0.09, "display": 0.05, "email": 0.22, "affiliate": 0.08}
DIRECT = ["direct", "(none)", ""]
CONVERSIONS = (0.62, 0.28, 0.07, 0.03)  # of 0 to 3 conversions a customer
DAY = 86400.0


def uniform(seed: int, use: str, *keys) -> Column:
    """A draw between 0 and 1, never either, that belongs to the keys: a hash of the seed, what it is for and them."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(use), *keys), F.lit(2**53)) + 0.5) / float(2**53)


def touchpoints(spark: SparkSession, customers: int | DataFrame = 5400, seed: int = 1) -> DataFrame:
    """customer_id, channel, timestamp, conversion, value: repeat converters, bursts, ties, exact duplicates, missing labels.
    ``customers`` is how many, or a table whose first column numbers them.

    Every number is drawn from a hash of the seed, what it is for and the customer, burst and touch it belongs to, so executors
    make the log from a range of customers, without a shuffle, and the same one however it is cut into tasks.
    """

    def u(use: str, *keys) -> Column:
        return uniform(seed, use, *keys)

    def one_of(draw: Column, chances) -> Column:
        """The number, from 0, of the chance that the draw falls on."""
        out = F.lit(len(chances) - 1)
        for i in range(len(chances) - 2, -1, -1):
            out = F.when(draw < sum(chances[1 : i + 1], chances[0]), i).otherwise(out)
        return out

    poisson = [math.exp(-2.4) * 2.4**k / math.factorial(k) for k in range(16)]
    who = F.col("id")
    touches = lambda b: F.lit(1) + one_of(u("touches", who, b), [*poisson, 1.0])
    tie = lambda b: u("tie", who, b) < 0.15

    def pause(b, k) -> Column:
        """Seconds between the touch and the one before; the third sometimes comes with the second."""
        return F.when((k == 1) | ((k == 3) & tie(b)), 0.0).otherwise(-2.5 * DAY * F.log(u("pause", who, b, k)))

    def offset(b, k) -> Column:
        return F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda total, i: total + pause(b, i))

    def start(b) -> Column:
        before = F.aggregate(F.sequence(F.lit(1), F.greatest(b - 1, F.lit(1))), F.lit(0.0), lambda total, j: total + offset(j, touches(j)) + DAY * (20 + 120 * u("rest", who, j)))
        return 300 * DAY * u("start", who) + F.when(b > 1, before).otherwise(0.0)

    b, k, n = F.col("burst"), F.col("k"), F.col("n")
    everyone = customers.select(F.col(customers.columns[0]).cast("long").alias("id")) if isinstance(customers, DataFrame) else spark.range(1, customers + 1)
    bursts = everyone.withColumn("wins", one_of(u("wins", who), CONVERSIONS))
    bursts = bursts.select("id", "wins", F.explode(F.sequence(F.lit(1), F.greatest("wins", F.lit(1)))).alias("burst"))
    rows = bursts.withColumns({"n": touches(b), "start": start(b)}).withColumn("k", F.explode(F.sequence(F.lit(1), n)))

    names = list(OPENING)
    # one touch in a burst may repeat the channel of the one before
    again = (n > 1) & (u("again", who, b) < 0.35) & (k == 2 + F.floor((n - 1) * u("again at", who, b)))
    drawn = F.when(again, k - 1).otherwise(k)
    late = F.when(n == 1, 0.5).otherwise((drawn - 1) / (n - 1))
    mix = [(1 - late) * OPENING[c] + late * CLOSING[c] for c in names]
    label = F.element_at(F.array(*map(F.lit, names)), one_of(u("channel", who, b, drawn), mix) + 1)
    spot = lambda use: 1 + F.floor(n * u(use, who, b))
    label = F.when((u("direct", who, b) < 0.22) & (k == spot("direct at")), F.element_at(F.array(*map(F.lit, DIRECT)), (1 + F.floor(3 * u("direct as", who, b))).cast("int"))).otherwise(label)
    label = F.when((u("missing", who, b) < 0.04) & (k == spot("missing at")), None).otherwise(label)
    won = (b <= F.col("wins")) & (k == n)
    value = F.round(-42 * sum((F.log(u(f"value {i}", who, b)) for i in range(3)), F.lit(0.0)), 2)  # a gamma draw of shape 3
    seconds = F.floor(F.col("start") + offset(b, k))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(u("copy", who, b, k) < 1 / 180, 2).otherwise(1)))
    made = rows.select(
        F.format_string("cust_%05d", who).alias("customer_id"), label.alias("channel"), (F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)).alias("timestamp"),
        won.cast("int").alias("conversion"), F.when(won, value).alias("value"), copies.alias("copy"),
    )
    return made.drop("copy")


def weekly_panel(spark: SparkSession, weeks: int = 156, seed: int = 1, geos: DataFrame | None = None) -> DataFrame:
    """date, geo, five spend columns with dark weeks, price, seasonality, holiday, revenue, for each row (geo, size) of ``geos``, by
    default those of GEOS. Drawn like ``touchpoints``; revenue follows TRUTH, with noise."""
    geos = spark.createDataFrame(list(GEOS.items()), "geo string, size double") if geos is None else geos.select(F.col("geo").cast("string").alias("geo"), F.col("size").cast("double").alias("size"))
    rows = geos.select("geo", "size", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("week"))
    u = lambda use: uniform(seed, use, "geo", "week")
    normal = lambda use: F.sqrt(-2 * F.log(u(f"{use} length"))) * F.cos(2 * math.pi * u(f"{use} angle"))
    gamma4 = lambda use, mean: -mean / 4 * sum((F.log(u(f"{use} {i}")) for i in range(4)), F.lit(0.0))
    rows = rows.withColumns({c: F.when(u(f"{c} dark") < 0.3, 0.0).otherwise(gamma4(c, half)) for c, (_, half, _, _) in TRUTH.items()})
    held = adstock(rows, {f"_{c}": (c, Adstock("geometric", decay)) for c, (decay, _, _, _) in TRUTH.items()}, "week", ["geo"])
    effect = sum((beta * saturate_hill(F.col(f"_{c}"), half, shape) for c, (_, half, shape, beta) in TRUTH.items()), F.lit(0.0))
    date = F.date_add(F.lit(dt.date(2023, 1, 2)), 7 * F.col("week"))
    season, holiday = 0.35 * F.sin(2 * math.pi * F.col("week") / 52.18), (F.month(date) == 12).cast("long")
    price = 10 + 0.5 * normal("price")
    revenue = F.col("size") * (18000 + 22 * F.col("week") + 3600 * season + effect - 2600 * (price - 10) + 2500 * holiday) + 900 * normal("noise")
    spend = [(F.col(c) * F.col("size")).alias(c) for c in TRUTH]
    return held.select(date.alias("date"), "geo", *spend, price.alias("price"), season.alias("seasonality"), holiday.alias("holiday"), revenue.alias("revenue"))
