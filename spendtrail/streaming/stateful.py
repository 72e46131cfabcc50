"""Streams of media rows and touches: the recursive filter with its state, inactivity sessions, and journeys that conversions end.

The stateful processors need the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle


CARRY = ("unseen", "overlap", "unknown_period", "contiguous", "misaligned", "gap")


class CarryProcessor(StatefulProcessor):
    """Keeps each series' raw accumulator, last time and period; says of every row how it joins on to the row before."""

    def __init__(self, order_by: str, column: str, decay: float, normalise: bool, period: float | None, on_break: str, tolerance: float):
        self.order_by, self.column, self.decay, self.scale = order_by, column, decay, 1 - decay if normalise else 1.0
        self.period, self.on_break, self.tolerance = period, on_break, tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("carry", "acc double, last double, period double")

    def joins(self, t: float, last: float | None, period: float | None) -> str:
        if last is None:
            return "unseen"
        if t <= last:
            return "overlap"
        if period is None:
            return "unknown_period"
        steps = (t - last) / period
        return "misaligned" if steps < 1 - self.tolerance else "contiguous" if steps <= 1 + self.tolerance else "gap"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(self.order_by, kind="stable")
        acc, last, period = self.state.get() if self.state.exists() else (0.0, None, None)
        period = self.period or period
        made, how = [], []
        for t, x in zip(got[self.order_by].astype(float).tolist(), got[self.column].astype(float).tolist(), strict=True):
            how.append(self.joins(t, last, period))
            if how[-1] == "overlap":
                made.append(None)
                continue
            if how[-1] in ("gap", "misaligned") and self.on_break != "continue":
                # a cold start, or the periods without a row as rows of nothing
                acc = 0.0 if self.on_break == "cold" else acc * self.decay ** max(0, round((t - last) / period) - 1)
            if how[-1] == "unknown_period":
                period = t - last
            acc, last = x + self.decay * acc, t
            made.append(acc * self.scale)
        self.state.update((acc, last, period))
        yield pd.DataFrame({"series": key[0], "t": got[self.order_by].astype(float).to_numpy(), "value": made, "late": [h == "overlap" for h in how], "carry": how})

    def close(self) -> None:
        pass


def stream_adstock(rows: DataFrame, series: str, order_by: str, column: str, decay: float, normalise: bool = False, period: float | None = None, on_break: str = "continue", tolerance: float = 0.25) -> DataFrame:
    """(series, t, value, late, carry) of a stream: over all micro-batches the same values as the batch filter has.

    ``series`` is cast to text and ``order_by`` to a number; rows within a micro-batch are put in order. carry says how a row joins
    the one before: unseen (the series' first), contiguous, gap or misaligned (more or less than a ``period`` later, by more
    than ``tolerance`` of it), unknown_period, or overlap (not later: such rows are late and have no value). A series' first step
    is its period unless one is given. on_break: what a gap or a misaligned row does to carryover: continue as the batch filter
    does, decay through the periods left out, or start cold.
    """
    if on_break not in ("continue", "decay", "cold") or not 0 <= tolerance < 0.5 or (period is not None and not period > 0):
        raise ValueError("on_break is continue, decay or cold, tolerance under a half, a period positive")
    keyed = rows.select(F.col(series).cast("string").alias("series"), F.col(order_by).cast("double").alias(order_by), F.col(column).cast("double").alias(column))
    return keyed.groupBy("series").transformWithStateInPandas(
        statefulProcessor=CarryProcessor(order_by, column, decay, normalise, period, on_break, tolerance), outputStructType="series string, t double, value double, late boolean, carry string", outputMode="append", timeMode="none"
    )


def with_side_output(made: DataFrame, path: str, side_path: str, checkpoint: str, side: Sequence[str] = ("overlap", "misaligned", "gap")) -> DataStreamWriter:
    """A writer of ``stream_adstock``'s rows: those whose carry is in ``side`` to a table of their own, all that have a value to the
    first one. Each micro-batch writes its own folder in either, so that one that is run again replaces what it wrote."""

    def split(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where(F.col("value").isNotNull()).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.where(F.col("carry").isin(list(side))).write.mode("overwrite").parquet(f"{side_path}/batch={number}")
        batch.unpersist()

    return made.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)


def stream_sessions(rows: DataFrame, id: str, timestamp: str, gap: str, watermark: str, channel: str | None = None) -> DataFrame:
    """Inactivity sessions (a gap longer than ``gap`` ends one): id, start, end of the last touch's gap, touches, channels in order."""
    window = F.session_window(timestamp, gap)
    sums = [F.count("*").alias("touches")]
    if channel:
        sums.append(F.transform(F.sort_array(F.collect_list(F.struct(F.col(timestamp), F.col(channel)))), lambda s: s[channel]).alias("channels"))
    out = rows.withWatermark(timestamp, watermark).groupBy(F.col(id).alias("id"), window).agg(*sums)
    return out.select("id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in out.columns if c not in ("id", "session_window")])


class JourneyProcessor(StatefulProcessor):
    """Holds each customer's open touches; a conversion closes the journey and sends it on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("touches", "t double, channel string")
        self.number = handle.getValueState("journeys", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["t", "conversion"], kind="stable")
        touches = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        n = self.number.get()[0] if self.number.exists() else 0
        made = []
        for t, channel, won in got[["t", "channel", "conversion"]].itertuples(index=False):
            touches.append((float(t), channel))
            if won:
                n += 1
                made.append((key[0], f"{key[0]}#{n}", " > ".join(c for _, c in touches), len(touches), touches[0][0], float(t)))
                touches = []
        self.open.clear()
        if touches:
            self.open.put(touches)
        self.number.update((n,))
        yield pd.DataFrame(made, columns=["id", "path_id", "path", "touches", "first_t", "conversion_t"])

    def close(self) -> None:
        pass


class TimedJourneyProcessor(StatefulProcessor):
    """Holds a customer's touches until the watermark passes them, then adds them in order to the open journey.

    A conversion closes it; so does a longer pause than ``gap``, by the next touch or by a timer when no touch can come any more
    that would continue it. Times are in microseconds.
    """

    def __init__(self, gap: int, forget: int | None):
        self.gap, self.forget = gap, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, conversion int, channel string")
        self.open = handle.getListState("open", "us long, conversion int, channel string")
        self.number = handle.getValueState("journeys", "n long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [x for part in rows for x in part[["us", "conversion", "channel"]].itertuples(index=False, name=None)]
        yield self.advanced(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.advanced(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def advanced(self, key, new: list[tuple], now: int) -> pd.DataFrame:
        held = lambda state: [tuple(x) for x in state.get()] if state.exists() else []
        waiting, open_ = held(self.waiting) + [(int(us), int(won), channel) for us, won, channel in new], held(self.open)
        n, last = self.number.get() if self.number.exists() else (0, None)
        made = []

        def close() -> None:
            made.append((key[0], f"{key[0]}#{n}", " > ".join(c for _, _, c in open_), len(open_), bool(open_[-1][1]), open_[0][0], open_[-1][0]))
            open_.clear()

        for touch in sorted(x for x in waiting if x[0] <= now):
            if open_ and touch[0] - open_[-1][0] > self.gap:
                close()
            n += not open_
            open_.append(touch)
            last = touch[0]
            if touch[1]:
                close()
        if open_ and now - open_[-1][0] > self.gap:
            close()
        waiting = [x for x in waiting if x[0] > now]
        self.kept(waiting, open_, n, last, now)
        return pd.DataFrame(made, columns=["id", "path_id", "path", "touches", "converted", "first_us", "last_us"])

    def kept(self, waiting: list[tuple], open_: list[tuple], n: int, last: int | None, now: int) -> None:
        for state, items in ((self.waiting, waiting), (self.open, open_)):
            state.clear()
            if items:
                state.put(items)
        gone = self.forget is not None and not waiting and not open_ and last is not None and now - last > self.forget
        if gone:
            self.number.clear()
        elif last is not None:
            self.number.update((n, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [x[0] for x in waiting] + ([open_[-1][0] + self.gap] if open_ else [last + self.forget] if self.forget is not None and last is not None and not gone else [])
        if due:
            self.handle.registerTimer(max(min(due), now) // 1000 + 1)

    def close(self) -> None:
        pass


def stream_journeys(rows: DataFrame, id: str, channel: str, t: str, conversion: str, gap: str | None = None, watermark: str = "0 seconds", forget: str | None = None) -> DataFrame:
    """Journeys as they close.

    With a ``gap`` (as "14 days"): id, path_id, path, touches, converted, first_t, last_t, the same journeys that ``build_paths``
    makes by conversions and gaps, in whatever order touches come within the ``watermark``; later ones are dropped. ``t`` is a
    timestamp. A journey closes by a conversion or a pause, the latter by a timer, so no touches are held for longer than gap
    and watermark; what stays of a customer is the number of journeys, until a pause of ``forget`` (then numbers begin anew).

    Without: converting journeys only, with first_t and conversion_t, by any numeric ``t``. Touches must come in order per id over
    micro-batches, and those of customers who never convert stay.
    """
    name = F.coalesce(F.col(channel).cast("string"), F.lit("(missing)")).alias("channel")
    who, won = F.col(id).cast("string").alias("id"), F.coalesce(F.col(conversion).cast("int"), F.lit(0)).alias("conversion")
    if gap is None:
        keyed = rows.select(who, name, F.col(t).cast("double").alias("t"), won)
        return keyed.groupBy("id").transformWithStateInPandas(
            statefulProcessor=JourneyProcessor(), outputStructType="id string, path_id string, path string, touches int, first_t double, conversion_t double", outputMode="append", timeMode="none"
        )
    spans = {k: _micros(v) for k, v in (("gap", gap), ("forget", forget)) if v is not None}
    if "forget" in spans and spans["forget"] < spans["gap"]:
        raise ValueError("forget must not be shorter than gap")
    keyed = rows.withWatermark(t, watermark).select(who, name, F.col(t).alias("t"), F.unix_micros(F.col(t)).alias("us"), won)
    made = keyed.groupBy("id").transformWithStateInPandas(
        statefulProcessor=TimedJourneyProcessor(spans["gap"], spans.get("forget")), outputStructType="id string, path_id string, path string, touches int, converted boolean, first_us long, last_us long", outputMode="append", timeMode="eventTime"
    )
    return made.select("id", "path_id", "path", "touches", "converted", F.timestamp_micros("first_us").alias("first_t"), F.timestamp_micros("last_us").alias("last_t"))


def _micros(span: str) -> int:
    """Microseconds of "90 seconds", "30 minutes", "12 hours" or "14 days"."""
    count, _, unit = span.strip().partition(" ")
    sizes = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    name = unit.strip().lower().removesuffix("s")
    if name not in sizes or not count.replace(".", "", 1).isdigit():
        raise ValueError(f"{span!r} is no span of seconds, minutes, hours or days")
    return round(float(count) * sizes[name] * 1e6)


def state_store_conf() -> dict[str, str]:
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_to_memory(stream: DataFrame, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """Runs a stream over what is there and returns its rows, for tests and small jobs."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    out = stream.sparkSession.table(name)
    return out.select(*columns) if columns else out
