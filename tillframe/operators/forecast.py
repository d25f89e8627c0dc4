"""Monthly forecasts for many series at once.

A series is a key with one value per month, so its length is bounded by the
number of months; inputs are aggregated to months before they are grouped.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillframe.operators.reports import period_start

# Shortest series, season length and width of the interval.
MIN_MONTHS, SEASON, Z = 3, 12, 1.96
MAX_HORIZON = 12
OK, TOO_SHORT = "ok", "too few months"  # status of a series
STEPS = tuple(i / 10 for i in range(1, 10))
SEASON_STEPS = (0.1, 0.3, 0.5, 0.7, 0.9)


def check_horizon(horizon: int) -> None:
    if not 1 <= horizon <= MAX_HORIZON:
        raise ValueError(f"horizon must lie between 1 and {MAX_HORIZON}")


def monthly_series(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue per country and month, plus the total under the key ``ALL``.

    Lines are first summed per customer and month; what is joined and repeated
    for the total no longer grows with the lines of a hot customer.
    """
    lines = sales.groupBy("customer_id", period_start("month").alias("month")).agg(F.sum("revenue").alias("r"))
    located = lines.join(customers.select("customer_id", "country"), "customer_id")
    per_country = located.groupBy("country", "month").agg(F.sum("r").alias("r"))
    total = per_country.groupBy("month").agg(F.sum("r").alias("r")).withColumn("series", F.lit("ALL"))
    both = per_country.withColumnRenamed("country", "series").unionByName(total.select("series", "month", "r"))
    return both.select("series", "month", F.col("r").cast("double").alias("value"))


def product_series(sales: DataFrame, products: DataFrame, key: str) -> DataFrame:
    """Revenue per month and ``key``: ``product_id`` or ``category``. Lines are summed per product before the join."""
    monthly = sales.groupBy("product_id", period_start("month").alias("month")).agg(F.sum("revenue").alias("r"))
    if key != "product_id":
        monthly = monthly.join(products.select("product_id", key), "product_id").groupBy(key, "month").agg(F.sum("r").alias("r"))
    return monthly.select(F.col(key).alias("series"), "month", F.col("r").cast("double").alias("value"))


def with_status(result: DataFrame, series: DataFrame, min_months: int) -> DataFrame:
    """``result`` with a status, and one row for each series of fewer than ``min_months``."""
    short = series.groupBy("series").agg(F.count("*").alias("n")).where(F.col("n") < min_months)
    short = short.select("series", F.lit(TOO_SHORT).alias("status"))
    return result.withColumn("status", F.lit(OK)).unionByName(short, allowMissingColumns=True)


def _two(c: Column) -> Column:
    return F.round(c.cast("decimal(28,6)"), 2).cast("double")


def _next_month(month: Column, step: Column) -> Column:
    return F.add_months(month.cast("date"), step.cast("int")).cast("timestamp_ntz")


def linear_forecast(series: DataFrame, horizon: int = 3, min_months: int = MIN_MONTHS) -> DataFrame:
    """Least-squares line through the months of each series, carried on; shorter series have a row with a status."""
    check_horizon(horizon)
    numbered = series.withColumn("t", F.row_number().over(Window.partitionBy("series").orderBy("month")) - 1)
    fitted = numbered.groupBy("series").agg(
        F.regr_slope("value", "t").alias("slope"),
        F.regr_intercept("value", "t").alias("intercept"),
        F.count("*").alias("n"),
        F.max("month").alias("last"),
    )
    ahead = fitted.where(F.col("n") >= min_months).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    value = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))
    forecast = ahead.select("series", _next_month(F.col("last"), F.col("step")).alias("month"), _two(value).alias("forecast"))
    return with_status(forecast, series, min_months)


def _fold(values: Column, alpha: Column, beta: Column) -> Column:
    """Level, trend and squared error after the series, one step ahead at a time."""
    start = F.struct(
        values[0].alias("level"), (values[1] - values[0]).alias("trend"), F.lit(0.0).alias("sse")
    )

    def step(state: Column, y: Column) -> Column:
        expected = state["level"] + state["trend"]
        level = alpha * y + (F.lit(1.0) - alpha) * expected
        trend = beta * (level - state["level"]) + (F.lit(1.0) - beta) * state["trend"]
        return F.struct(
            level.alias("level"),
            trend.alias("trend"),
            (state["sse"] + (y - expected) * (y - expected)).alias("sse"),
        )

    return F.aggregate(F.slice(values, F.lit(2), F.size(values) - 1), start, step)


def holt_fit(series: DataFrame, min_months: int = MIN_MONTHS) -> DataFrame:
    """Per series the level and trend weights with the least squared error.

    The weights run over a grid in steps of 0.1; ties go to the smaller ones.
    """
    arrays = series.groupBy("series").agg(
        F.array_sort(F.collect_list(F.struct("month", "value"))).alias("points"), F.max("month").alias("last")
    )
    usable = arrays.where(F.size("points") >= max(2, min_months)).select("series", "last", F.col("points.value").alias("v"))
    steps = F.array(*[F.lit(s) for s in STEPS])
    grid = usable.withColumn("alpha", F.explode(steps)).withColumn("beta", F.explode(steps))
    folded = grid.select(
        "series", "last", F.size("v").alias("n"), "alpha", "beta", _fold(F.col("v"), F.col("alpha"), F.col("beta")).alias("s")
    )
    best = folded.groupBy("series").agg(
        F.min(F.struct("s.sse", "alpha", "beta", "s.level", "s.trend", "n", "last")).alias("b")
    )
    return best.select("series", "b.*")


def holt_forecast(series: DataFrame, horizon: int = 3, min_months: int = MIN_MONTHS) -> DataFrame:
    """Additive-trend smoothing: forecast with a 95 % band from the in-sample error."""
    check_horizon(horizon)
    fitted = holt_fit(series, min_months).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    value = F.col("level") + F.col("step") * F.col("trend")
    rmse = F.sqrt(F.col("sse") / F.col("n"))
    forecast = fitted.select(
        "series",
        _next_month(F.col("last"), F.col("step")).alias("month"),
        "alpha",
        "beta",
        *interval_columns(value, rmse),
    )
    return with_status(forecast, series, max(2, min_months))


def interval_columns(value: Column, rmse: Column) -> list[Column]:
    """Forecast, lower bound (not below zero) and upper bound, two decimals."""
    return [
        _two(value).alias("forecast"),
        _two(F.greatest(value - Z * rmse, F.lit(0.0))).alias("lower"),
        _two(value + Z * rmse).alias("upper"),
    ]


def forecast_interval(series: DataFrame, min_months: int = MIN_MONTHS) -> DataFrame:
    """Per series the weights, the error of the fit and the half width of the band."""
    rmse = F.sqrt(F.col("sse") / F.col("n"))
    months = F.col("n").cast("long").alias("months")
    bands = holt_fit(series, min_months).select(
        "series", months, "alpha", "beta", _two(rmse).alias("rmse"), _two(Z * rmse).alias("half_width")
    )
    return with_status(bands, series, max(2, min_months))


# --- seasonal smoothing, one short series per group -------------------------


def _smooth(y: np.ndarray, trend: bool, season: str | None, horizon: int):
    """Fit one model form over its grid; (sse, forecast) of the best, or None if none is finite."""
    steps = SEASON_STEPS if season else STEPS
    grid = np.array(list(itertools.product(steps, steps if trend else (0.0,), steps if season else (0.0,))))
    alpha, beta, gamma = grid.T
    size = len(grid)
    if season:
        if season == "mul" and (y <= 0).any():
            return None
        first, later = y[:SEASON], y[SEASON : 2 * SEASON]
        slope = (later - first[: len(later)]).mean() / SEASON if trend and len(later) else 0.0
        # The line through the first year; what is left of it is the first season.
        line = first.mean() + slope * (np.arange(SEASON) - (SEASON - 1) / 2)
        level = np.full(size, line[0] - slope)
        base = first / line if season == "mul" else first - line
        cycle = [np.full(size, v) for v in base]
    else:
        level = np.full(size, y[0])
        slope = y[1] - y[0] if trend else 0.0
        cycle = []
    growth = np.full(size, slope)
    sse = np.zeros(size)
    for t, value in enumerate(y):
        if not season and t == 0:
            continue
        effect = cycle[t % SEASON] if season else 0.0
        plain = level + growth
        expected = plain * effect if season == "mul" else plain + effect
        sse += (value - expected) ** 2
        adjusted = value / effect if season == "mul" else value - effect
        new_level = alpha * adjusted + (1 - alpha) * plain
        if trend:
            growth = beta * (new_level - level) + (1 - beta) * growth
        if season:
            seen = value / plain if season == "mul" else value - plain
            cycle[t % SEASON] = gamma * seen + (1 - gamma) * effect
        level = new_level
    usable = np.where(np.isfinite(sse), sse, np.inf)
    best = int(usable.argmin())
    if not np.isfinite(usable[best]):
        return None
    ahead = []
    for h in range(1, horizon + 1):
        value = level[best] + h * growth[best]
        if season:
            effect = cycle[(len(y) + h - 1) % SEASON][best]
            value = value * effect if season == "mul" else value + effect
        ahead.append(float(value))
    return float(usable[best]), ahead


def _cascade(months: int) -> list[tuple[str, bool, str | None]]:
    """Model forms from rich to plain, as far as the length allows."""
    forms: list[tuple[str, bool, str | None]] = []
    if months >= 2 * SEASON:
        forms.append(("trend + additive season", True, "add"))
    if months >= SEASON:
        forms.append(("trend * multiplicative season", True, "mul"))
    return forms + [("trend", True, None), ("level", False, None)]


def holt_winters_forecast(series: DataFrame, horizon: int = 3, min_months: int = MIN_MONTHS) -> DataFrame:
    """The first model form that fits each series on a grid of weights, with forecast and 95 % band.

    ``smoothing.smoothing_forecast`` searches on from the grid and tests convergence.
    """
    check_horizon(horizon)

    def forecast(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("month")
        y = ordered["value"].to_numpy(dtype=float)
        columns = ["series", "month", "model", "forecast", "lower", "upper"]
        if len(y) < max(2, min_months):
            return pd.DataFrame(columns=columns)
        with np.errstate(all="ignore"):
            for label, trend, season in _cascade(len(y)):
                found = _smooth(y, trend, season, horizon)
                if found:
                    break
        if not found:
            return pd.DataFrame(columns=columns)
        band = Z * np.sqrt(found[0] / len(y))
        value = np.array(found[1])
        last = pd.Timestamp(ordered["month"].iloc[-1])
        return pd.DataFrame(
            {
                "series": ordered["series"].iloc[0],
                "month": [last + pd.DateOffset(months=h) for h in range(1, horizon + 1)],
                "model": label,
                "forecast": value,
                "lower": np.maximum(value - band, 0),
                "upper": value + band,
            }
        )

    schema = "series string, month timestamp_ntz, model string, forecast double, lower double, upper double"
    found = series.groupBy("series").applyInPandas(forecast, schema)
    found = found.withColumns({c: _two(F.col(c)) for c in ("forecast", "lower", "upper")})
    return with_status(found, series, max(2, min_months))
