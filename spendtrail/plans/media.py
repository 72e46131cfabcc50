"""Plans: simulated response, contributions, returns, reallocation and budget allocation."""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegressionModel, LinearRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrail.functions.saturation import curve_inverse, curve_scale, curve_value, inverse_column, saturate
from spendtrail.operators.adstock import ChannelSpec, adstock, media_transform
from spendtrail.validate import require_columns, require_number

BASELINE = "(baseline)"
EPS3 = 2.220446049250313e-16 ** (1 / 3)


def extended(plan: DataFrame, channels: Sequence[str], order_by: str, by: Sequence[str], extend: int) -> DataFrame:
    """``plan`` with ``_ext`` 0 and ``extend`` rows of zero spend after each group, ``_ext`` 1, 2, ...; order by (_ext, order_by)."""
    rows = plan.select(*by, order_by, *[F.col(c).cast("double").alias(c) for c in channels], F.lit(0).alias("_ext"))
    if not extend:
        return rows
    ends = rows.groupBy(*by).agg(F.max(order_by).alias(order_by))
    more = ends.select(*by, order_by, *[F.lit(0.0).alias(c) for c in channels], F.explode(F.sequence(F.lit(1), F.lit(extend))).alias("_ext"))
    return rows.unionByName(more)


def transform_plan(plan: DataFrame, spec: dict[str, ChannelSpec], order_by: str, by: Sequence[str] = ()) -> DataFrame:
    """``plan`` with each channel of ``spec`` replaced by its transform, in its own place."""
    made = media_transform(plan, {f"_new_{c}": (c, s) for c, s in spec.items()}, order_by, by)
    return made.select(*[F.col(f"_new_{c}").alias(c) if c in spec else F.col(c) for c in plan.columns])


def simulate_plan(plan: DataFrame, spec: dict[str, ChannelSpec], coefficients: dict[str, float], order_by: str, by: Sequence[str] = (), baseline: DataFrame | None = None, extend: int = 0) -> DataFrame:
    """(channel, spend, contribution[, and both of ``baseline`` and the differences])."""

    def totals(df: DataFrame) -> DataFrame:
        rows = extended(df, list(spec), order_by, by, extend)
        made = media_transform(rows, {f"_new_{c}": (c, s) for c, s in spec.items()}, ["_ext", order_by], by)
        sums = made.agg(*[F.sum(c).alias(f"spend_{c}") for c in spec], *[(F.sum(f"_new_{c}") * coefficients[c]).alias(f"response_{c}") for c in spec])
        each = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"spend_{c}").alias("spend"), F.col(f"response_{c}").alias("contribution")) for c in spec])
        return sums.select(F.explode(each).alias("x")).select("x.*")

    now = totals(plan)
    if baseline is None:
        return now
    old = totals(baseline).toDF("channel", "baseline_spend", "baseline_contribution")
    return now.join(old, "channel").withColumns({"spend_change": F.col("spend") - F.col("baseline_spend"), "contribution_change": F.col("contribution") - F.col("baseline_contribution")})


@dataclass(frozen=True)
class Fitted:
    """A linear model: what a unit of each column adds to its linear predictor. bare: coefficients only, with no model behind."""

    coefficients: dict[str, float]
    intercept: float | None
    link: str = "identity"
    bare: bool = False


def fitted(model, features: Sequence[str] | None = None) -> Fitted:
    """Of a mapping of coefficients (with or without "(Intercept)"; back-ticks around names don't count), a linear or generalised
    linear model of ``pyspark.ml``, or a pipeline model that ends in one.

    ``features`` names the elements of the model's vector; a pipeline's assembler tells them by itself.
    """
    if isinstance(model, dict):
        named = {str(k).replace("`", ""): float(v) for k, v in model.items()}
        return Fitted({k: v for k, v in named.items() if k != "(Intercept)"}, named.get("(Intercept)"), bare=True)
    if isinstance(model, PipelineModel):
        *before, last = model.stages
        made = {s.getOutputCol(): s.getInputCols() for s in before if isinstance(s, VectorAssembler)}
        return fitted(last, features or made.get(last.getFeaturesCol()))
    if not isinstance(model, LinearRegressionModel | GeneralizedLinearRegressionModel):
        raise TypeError(f"no coefficients are known of {type(model).__name__}; give a mapping")
    values = model.coefficients.toArray().tolist()
    if features is None or len(features) != len(values):
        raise ValueError(f"features must name the {len(values)} elements of the model's vector")
    link = "identity"
    if isinstance(model, GeneralizedLinearRegressionModel):
        canonical = {"gaussian": "identity", "binomial": "logit", "poisson": "log", "gamma": "inverse"}
        link = model.getLink() if model.isDefined("link") else canonical.get(model.getFamily().lower(), "power")
    return Fitted(dict(zip(features, values, strict=True)), float(model.intercept), link)


def contributions(media: DataFrame, model, index: str, by: Sequence[str] = (), intercept: float | None = None, prediction: str | None = None, newdata: DataFrame | None = None, features: Sequence[str] | None = None) -> DataFrame:
    """Long (period, by..., channel, contribution): coefficient times each channel's transformed media, and the baseline, which is
    all else that the model predicts.

    ``model`` as in ``fitted``. The baseline is the ``prediction`` column less the media, or what a fitted model predicts for the
    rows of ``newdata`` (index, by..., all of its columns) less the media, or else the intercept. A row that newdata lacks, and a
    column that both hold with different values, are refused when the table is run. Under a link other than the identity
    contributions are on the scale of the linear predictor, and a warning says so.
    """
    fit = fitted(model, features)
    names = [c for c in media.columns if c in fit.coefficients and c not in (index, *by)]
    if not names:
        raise ValueError(f"no column of the media is one of the model's: {', '.join(fit.coefficients)}")
    if missing := [c for c in names if not np.isfinite(fit.coefficients[c])]:
        raise ValueError(f"these channels have no coefficient, as others determine them: {', '.join(missing)}")
    others = [c for c in fit.coefficients if c not in names]
    if intercept is None:
        intercept = fit.intercept
    if fit.link != "identity":
        warnings.warn(f"contributions are on the scale of the linear predictor, as the model has a {fit.link} link", stacklevel=2)
    effect = {c: F.col(c).cast("double") * fit.coefficients[c] for c in names}
    known = sum(effect.values(), F.lit(0.0))
    if prediction is not None:
        base = F.col(prediction) - known
    elif newdata is not None:
        if fit.bare:
            raise ValueError("newdata needs a fitted model to predict from")
        media, base = _beside(media, newdata, fit, names, index, by)
        base = base - known
    elif intercept is None:
        raise ValueError("give an intercept or a prediction column for the baseline")
    elif others and not fit.bare:
        raise ValueError(f"the model's other columns are needed for its prediction, give newdata with {', '.join(others)}")
    else:
        base = F.lit(float(intercept))
    each = F.array(*[F.struct(F.lit(c).alias("channel"), value.cast("double").alias("contribution")) for c, value in (*effect.items(), (BASELINE, base))])
    return media.select(F.col(index).alias("period"), *by, F.explode(each).alias("x")).select("period", *by, "x.channel", "x.contribution")


def _beside(media: DataFrame, newdata: DataFrame, fit: Fitted, names: Sequence[str], index: str, by: Sequence[str]) -> tuple[DataFrame, Column]:
    """``media`` with newdata's columns beside it, and the model's linear predictor for newdata's row."""
    if lacking := [c for c in fit.coefficients if c not in newdata.columns]:
        raise ValueError(f"newdata lacks {', '.join(lacking)}")
    keys = [index, *by]
    held = newdata.select(*keys, *[F.col(c).cast("double").alias(f"_new_{c}") for c in fit.coefficients], F.lit(True).alias("_found"))
    rows = media.join(held, keys, "left")
    refuse = lambda why: F.raise_error(F.lit(why)).cast("double")
    value = F.when(F.col("_found").isNull(), refuse("newdata lacks a row of the media")).otherwise(F.lit(fit.intercept))
    for c, k in fit.coefficients.items():
        x = F.col(f"_new_{c}")
        if c in names:
            own = F.col(c).cast("double")
            x = F.when(F.abs(own - x) > 1.5e-8 * F.greatest(F.abs(own), F.abs(x)), refuse(f"media and newdata hold different values of {c}")).otherwise(x)
        value = value + x * k
    return rows, value


def roi(contribution: DataFrame, spend: DataFrame, index: str, by: Sequence[str] = (), periods: Sequence | None = None) -> DataFrame:
    """(by..., channel, contribution, spend, roi) over the period x group cells that both sides have; roi is null at no spend.

    ``spend`` is wide: a column for each channel. Highest roi first, nulls last.
    """
    require_columns(contribution, ["period", *by, "channel"], "the contributions", numeric=["contribution"])
    channels = [c for c in spend.columns if c not in (index, *by)]
    require_columns(spend, [index, *by], "the spend", numeric=channels)
    rows = spend.withColumnRenamed(index, "period")
    effect = contribution.where(F.col("channel").isin(channels))
    if periods is not None:
        rows, effect = (x.where(F.col("period").isin(list(periods))) for x in (rows, effect))
    cell = ["period", *by]
    rows, effect = rows.join(effect.select(*cell).distinct(), cell, "left_semi"), effect.join(rows.select(*cell).distinct(), cell, "left_semi")
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("spend")) for c in channels])
    spent = rows.select(*by, F.explode(each).alias("x")).groupBy(*by, "x.channel").agg(F.sum("x.spend").alias("spend"))
    earned = effect.groupBy(*by, "channel").agg(F.sum("contribution").alias("contribution"))
    out = earned.join(spent, [*by, "channel"]).withColumn("roi", F.try_divide(F.col("contribution"), F.col("spend")))
    return out.select(*by, "channel", "contribution", "spend", "roi").orderBy(*by, F.col("roi").desc_nulls_last(), "channel")


def unmatched(contribution: DataFrame, spend: DataFrame, index: str, by: Sequence[str] = ()) -> DataFrame:
    """(period, by..., missing): period x group cells that only one of ``roi``'s inputs has, and which input lacks them."""
    cell = ["period", *by]
    left = contribution.select(*cell).distinct().withColumn("_c", F.lit(1))
    right = spend.withColumnRenamed(index, "period").select(*cell).distinct().withColumn("_s", F.lit(1))
    both = left.join(right, cell, "full")
    return both.where("_c is null or _s is null").select(*cell, F.when(F.col("_c").isNull(), "contribution").otherwise("spend").alias("missing"))


def unmatched_channels(contribution: DataFrame, spend: DataFrame, index: str, by: Sequence[str] = ()) -> DataFrame:
    """(channel, missing): channels that only one of ``roi``'s inputs has, which it leaves out, and which input lacks them. The
    baseline is no channel."""
    spent = [c for c in spend.columns if c not in (index, *by)]
    known = F.array(*map(F.lit, spent)).cast("array<string>")
    both = contribution.where(F.col("channel") != BASELINE).agg(F.collect_set("channel").alias("found"))  # one row, a name a channel
    named = lambda names, what: F.transform(names, lambda c: F.struct(c.alias("channel"), F.lit(what).alias("missing")))
    return both.select(F.explode(F.concat(named(F.array_except("found", known), "spend"), named(F.array_except(known, F.col("found")), "contribution"))).alias("x")).select("x.*")


def marginal_roi(spend: DataFrame, spec: dict[str, ChannelSpec], coefficients: dict[str, float], order_by: str, by: Sequence[str] = (), lift: float = 0.01, rows: Column | None = None, extend: int = 0) -> DataFrame:
    """(channel, spend, contribution, roi, mroi): return of the last ``lift`` of spend in the window ``rows``.

    Both scenarios are columns of one pass over each series. mroi is null where the window has no spend.
    """
    require_number(lift, "lift", 1e-12, 1e6)
    require_number(extend, "extend", 0, whole=True)
    inside = F.coalesce(rows, F.lit(False)) if rows is not None else F.lit(True)
    plan = spend.withColumns({f"_w_{c}": F.when(inside, F.col(c)).otherwise(0.0) for c in spec})
    names = [*spec, *[f"_w_{c}" for c in spec]]
    table = extended(plan, names, order_by, by, extend).withColumns({f"_b_{c}": F.col(c) + lift * F.col(f"_w_{c}") for c in spec})
    made = media_transform(table, {f"_base_{c}": (c, s) for c, s in spec.items()} | {f"_bump_{c}": (f"_b_{c}", s) for c, s in spec.items()}, ["_ext", order_by], by)
    sums = made.agg(*[F.sum(x + c).alias(x + c) for c in spec for x in ("", "_w_", "_base_", "_bump_")])
    parts = []
    for c in spec:
        base, bump = (F.col(x + c) * float(coefficients[c]) for x in ("_base_", "_bump_"))
        parts.append(F.struct(F.lit(c).alias("channel"), F.col(c).alias("spend"), base.alias("contribution"), F.try_divide(base, F.col(c)).alias("roi"), F.try_divide(bump - base, lift * F.col(f"_w_{c}")).alias("mroi")))
    return sums.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def mroi(spend_level: float, coefficient: float, type: str = "hill", delta: float = 0.01, **parameters) -> float:
    """Slope of coefficient x curve at a level: central difference, one-sided at zero."""
    scale = curve_scale(type, **parameters) or 1.0
    h = max(spend_level * delta, EPS3 * scale)
    low, high = max(0.0, spend_level - h), spend_level + h
    return coefficient * (curve_value(high, type, **parameters) - curve_value(low, type, **parameters)) / (high - low)


def mroi_column(spend: Column, coefficient: float, type: str = "hill", delta: float = 0.01, **parameters) -> Column:
    scale = curve_scale(type, **parameters) or 1.0
    h = F.greatest(spend * delta, F.lit(EPS3 * scale))
    low, high = F.greatest(F.lit(0.0), spend - h), spend + h
    return coefficient * (saturate(high, type, **parameters) - saturate(low, type, **parameters)) / (high - low)


def response_curve(levels: DataFrame, spend: str, coefficient: float, type: str = "hill", **parameters) -> DataFrame:
    """(spend, response, slope) for a column of spend levels."""
    x = F.col(spend).cast("double")
    return levels.select(x.alias("spend"), (coefficient * saturate(x, type, **parameters)).alias("response"), mroi_column(x, coefficient, type, **parameters).alias("slope"))


def spend_for(target: float, coefficient: float, type: str = "hill", max_spend: float | None = None, **parameters) -> float | None:
    """Spend at which the response reaches ``target``; None where it isn't reached up to ``max_spend`` (1000 curve scales)."""
    scale = curve_scale(type, **parameters)
    if max_spend is None:
        if scale is None:
            raise ValueError(f"max_spend is required for the curve {type}")
        max_spend = 1000 * scale
    if target * coefficient < 0 or coefficient == 0:
        raise ValueError("target and coefficient must be of one sign")
    level = curve_inverse(target / coefficient, type, **parameters)
    return level if level <= max_spend else None


def spend_for_column(target: Column, coefficient: float, type: str = "hill", max_spend: float | None = None, **parameters) -> Column:
    """``spend_for`` of a column of targets, which must be of the coefficient's sign; null where a target isn't reached."""
    scale = curve_scale(type, **parameters)
    if max_spend is None and scale is None:
        raise ValueError(f"max_spend is required for the curve {type}")
    if coefficient == 0:
        raise ValueError("coefficient must not be 0")
    most = 1000 * scale if max_spend is None else max_spend
    wrong = F.raise_error(F.lit("target and coefficient must be of one sign")).cast("double")
    level = inverse_column(target.cast("double") / float(coefficient), type, **parameters)
    return F.when(target * float(coefficient) < 0, wrong).when(level <= most, level)


def reallocate(plan: DataFrame, source: str, target: str, amount: float | dict, by: str | None = None) -> DataFrame:
    """``plan`` with ``amount`` moved between two channels: taken and added in proportion to what each period spends.

    With ``by`` the amount holds for every group, or is a dict for named groups. Raises, when it runs, if a source spends
    less or a target nothing.
    """
    if source == target:
        raise ValueError("source and target are the same column")
    if any(a < 0 for a in (amount.values() if isinstance(amount, dict) else [amount])):
        raise ValueError("amount must not be negative: swap source and target instead")
    if isinstance(amount, dict):
        if by is None:
            raise ValueError("amounts by group need by")
        a = F.lit(0.0)
        for key, x in amount.items():
            a = F.when(F.col(by) == F.lit(key), float(x)).otherwise(a)
    else:
        a = F.lit(float(amount))
    whole = Window.partitionBy(*([by] if by else []))
    have, room = F.sum(source).over(whole), F.sum(target).over(whole)
    short = a - have > 1.5e-8 * have
    a = F.when(short, F.raise_error(F.lit(f"amount is more than {source} spends")).cast("double")).when((a > 0) & (room == 0), F.raise_error(F.lit(f"{target} has no spend to spread the amount over")).cast("double")).otherwise(a)
    moved = {
        source: F.when(a == 0, F.col(source)).otherwise(F.col(source) * F.greatest(F.lit(0.0), 1 - F.try_divide(a, have))),
        target: F.when(a == 0, F.col(target)).otherwise(F.col(target) + a * F.try_divide(F.col(target).cast("double"), room)),
    }
    return plan.withColumns(moved)


class Responses:
    """The response of every channel's flighting at any spend levels, from one pass over the series.

    Carryover is linear, so where it comes before saturation one filtered series serves all levels, and a grid is one explode and
    sum for all channels; a channel that saturates first is filtered for each level. ``held`` keeps the filtered series in
    executors until it is left.
    """

    def __init__(self, plan: DataFrame, spec: dict[str, ChannelSpec], coefficients: dict[str, float], order_by: str, by: Sequence[str] = (), extend: int = 0):
        self.spec, self.coefficients, self.order, self.by = spec, coefficients, ["_ext", order_by], list(by)
        self.rows = extended(plan, list(spec), order_by, by, extend)
        self.late = {c: s for c, s in spec.items() if not s.saturate_first}
        self.rows = adstock(self.rows, {f"_a_{c}": (c, s.adstock) for c, s in self.late.items()}, self.order, by)
        self.spend = None

    def __enter__(self) -> Responses:
        self.rows = self.rows.persist()
        return self

    def __exit__(self, *_) -> None:
        self.rows.unpersist()

    def current(self) -> dict[str, float]:
        """What each channel spends in all."""
        if self.spend is None:
            self.spend = {c: v or 0.0 for c, v in self.rows.agg(*[F.sum(c).alias(c) for c in self.spec]).first().asDict().items()}
        return self.spend

    def at(self, levels: dict[str, Sequence[float]]) -> DataFrame:
        """(channel, k, level, response)."""
        points = [(c, k, float(x), float(x) / self.current()[c] if self.current()[c] > 0 else 0.0) for c in self.spec for k, x in enumerate(levels[c])]
        fields = "array<struct<channel: string, k: int, level: double, f: double>>"
        held = lambda wanted: F.explode(F.from_json(F.lit(json.dumps([dict(zip(("channel", "k", "level", "f"), p, strict=True)) for p in points if p[0] in wanted])), fields)).alias("g")  # noqa: E731 # one literal
        parts = []
        if self.late:
            each = self.rows.select(*[f"_a_{c}" for c in self.late], held(self.late)).select("*", "g.*")
            y = F.lit(None).cast("double")
            for c, s in self.late.items():
                y = F.when(F.col("channel") == c, s.saturation.column(F.col(f"_a_{c}") * F.col("f")) * float(self.coefficients[c])).otherwise(y)
            parts.append(each.withColumn("y", y))
        for c, s in self.spec.items():
            if s.saturate_first:
                series = self.rows.select(*self.by, *self.order, c, held([c])).select(*self.by, *self.order, "g.*", (F.col(c) * F.col("g.f")).alias("_x"))
                made = media_transform(series, {"_y": ("_x", s)}, self.order, [*self.by, "channel", "k"])
                parts.append(made.withColumn("y", F.col("_y") * float(self.coefficients[c])))
        out = parts[0].select("channel", "k", "level", "y")
        for part in parts[1:]:
            out = out.unionByName(part.select("channel", "k", "level", "y"))
        return out.groupBy("channel", "k", "level").agg(F.sum("y").alias("response"))


def response_grid(plan: DataFrame, spec: dict[str, ChannelSpec], coefficients: dict[str, float], levels: dict[str, Sequence[float]], order_by: str, by: Sequence[str] = (), extend: int = 0) -> DataFrame:
    """(channel, k, level, response): total response of each channel's flighting scaled to each spend level; see ``Responses``."""
    return Responses(plan, spec, coefficients, order_by, by, extend).at(levels)


@dataclass
class Allocation:
    """``table``: channel, current_spend, recommended_spend, current_response, recommended_response, mroi."""

    table: DataFrame
    plan: DataFrame
    total: float
    step: float
    steps: int


def best_split(responses: list[np.ndarray], steps: int) -> list[int] | None:
    """Increments per channel with the largest total response that use all ``steps``; None if there is no such split.

    Exact, by channels in turn: the best of the first channels at every budget, as a table of shifted sums; ties take fewest
    increments for the later channel.
    """
    best = np.full(steps + 1, -np.inf)
    top = min(len(responses[0]), steps + 1)
    best[:top] = responses[0][:top]
    choices = []
    for r in responses[1:]:
        r = r[: steps + 1]
        table = np.full((len(r), steps + 1), -np.inf)
        for j, gain in enumerate(r):
            table[j, j:] = best[: steps + 1 - j] + gain
        choices.append(table.argmax(axis=0))
        best = table.max(axis=0)
    if not np.isfinite(best[steps]):
        return None
    left, picks = steps, []
    for choice in reversed(choices):
        picks.append(int(choice[left]))
        left -= picks[-1]
    return [left, *reversed(picks)]


def allocate_budget(
    plan: DataFrame,
    spec: dict[str, ChannelSpec],
    coefficients: dict[str, float],
    order_by: str,
    total: float | None = None,
    lower: dict[str, float] | None = None,
    upper: dict[str, float] | None = None,
    by: Sequence[str] = (),
    steps: int = 200,
    extend: int = 0,
) -> Allocation:
    """The split of ``total`` over channels, in ``steps`` equal increments above their lower bounds, of the largest response.

    The series are filtered once; response grids are computed on them in Spark, and what reaches the driver is channels x steps
    numbers, searched exactly. A channel without spend has no flighting and gets its lower bound at zero response. Where upper
    bounds leave less than an increment of room each, the rest is shared in proportion to the room left.
    """
    if not 1 <= steps <= 10_000:
        raise ValueError("steps must be from 1 to 10,000")
    channels = list(spec)
    with Responses(plan, spec, coefficients, order_by, by, extend) as responses:
        current = responses.current()
        total = sum(current.values()) if total is None else float(total)
        lower = {c: float((lower or {}).get(c, 0.0)) for c in channels}
        upper = {c: float((upper or {}).get(c, total if current[c] > 0 else lower[c])) for c in channels}
        upper = {c: min(u, total) for c, u in upper.items()}
        if any(lower[c] > upper[c] + 1e-9 * total for c in channels) or sum(lower.values()) > total * (1 + 1e-9) or sum(upper.values()) < total * (1 - 1e-9):
            raise ValueError("no split of the total keeps within the bounds")
        free = max(0.0, total - sum(lower.values()))
        step = free / steps
        tops = {c: int(min(steps, np.floor((upper[c] - lower[c]) / step + 1e-9))) if step else 0 for c in channels}
        levels = {c: [lower[c] + k * step for k in range(tops[c] + 1)] for c in channels}
        grid = {c: np.zeros(len(levels[c])) for c in channels}
        for row in responses.at(levels).collect():
            grid[row["channel"]][row["k"]] = row["response"]
        if not all(np.isfinite(g).all() for g in grid.values()):
            raise ValueError("the response is not finite at every level searched")
        picks = best_split([grid[c] for c in channels], steps) if free else [0] * len(channels)
        if picks is not None:
            spend = {c: lower[c] + k * step for c, k in zip(channels, picks, strict=True)}
        else:
            spend = {c: lower[c] + tops[c] * step for c in channels}
            room = {c: upper[c] - spend[c] for c in channels}
            rest, space = total - sum(spend.values()), sum(room.values())
            spend = {c: spend[c] + (rest * room[c] / space if space > 0 else 0) for c in channels}
        spend = {c: min(upper[c], max(lower[c], x)) for c, x in spend.items()}
        points = {c: [current[c], spend[c], spend[c] * 1.01] for c in channels}
        at = {(r["channel"], r["k"]): r["response"] for r in responses.at(points).collect()}
    rows = [(c, float(current[c]), float(spend[c]), at[c, 0], at[c, 1], (at[c, 2] - at[c, 1]) / (0.01 * spend[c]) if spend[c] > 0 else None) for c in channels]
    fields = "channel string, current_spend double, recommended_spend double, current_response double, recommended_response double, mroi double"
    table = plan.sparkSession.createDataFrame(rows, fields)
    scaled = plan.withColumns({c: F.col(c) * (spend[c] / current[c]) for c in channels if current[c] > 0})
    return Allocation(table, scaled, total, step, steps)
