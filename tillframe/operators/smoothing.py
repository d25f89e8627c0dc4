"""Exponential smoothing of many series at once, with weights found by a search that says whether it converged.

Series are rows of an Arrow batch; those of one length are smoothed together.
The weights start from the best point of a grid and move along their axes by
steps that are halved when nothing is gained, so the squared error is never
above that of the grid. A form whose search does not come to rest gives way to
the next plainer one; the last is a straight line.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillframe.operators.forecast import (
    MIN_MONTHS, OK, SEASON, SEASON_STEPS, STEPS, TOO_SHORT, Z, _cascade, _next_month, _two, check_horizon,
)

FIRST_STEP, LAST_STEP = 0.05, 1e-5  # of the search, in units of a weight
ROUNDS = 400  # a search that needs more has not converged
GAIN = 1e-12  # relative; smaller ones are rounding
CELLS = 8192  # points of the grid times series that are folded at once: they stay in the cache
SERIES = 16384  # smoothed at once in a task: of a few series at a time, most of the time goes into calls
LINE = "line"


def smooth(y: np.ndarray, weights: np.ndarray, trend: bool, season: str | None, horizon: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Squared errors (series, candidates) of one step ahead, and forecasts (series, candidates, horizon).

    ``y`` is (series, months), ``weights`` (series, candidates, 3): of level,
    trend and season. Infinite where a form cannot be computed.
    """
    count, months = y.shape
    alpha, beta, gamma = np.moveaxis(np.broadcast_to(weights, (count, *weights.shape[1:])), 2, 0)
    shape = alpha.shape
    alpha_rest, beta_rest, gamma_rest = 1 - alpha, 1 - beta, 1 - gamma
    cycle = []
    if season:
        first, later = y[:, :SEASON], y[:, SEASON : 2 * SEASON]
        width = later.shape[1]
        slope = (later - first[:, :width]).mean(1) / SEASON if trend and width else np.zeros(count)
        line = first.mean(1)[:, None] + slope[:, None] * (np.arange(SEASON) - (SEASON - 1) / 2)
        level = np.broadcast_to((line[:, 0] - slope)[:, None], shape)
        base = first / line if season == "mul" else first - line
        cycle = [np.broadcast_to(base[:, k, None], shape) for k in range(SEASON)]
    else:
        level = np.broadcast_to(y[:, :1], shape)
        slope = y[:, 1] - y[:, 0] if trend else np.zeros(count)
    growth = np.broadcast_to(slope[:, None], shape)
    error = np.zeros(shape)
    for t in range(0 if season else 1, months):
        value, plain = y[:, t, None], level + growth
        effect = cycle[t % SEASON] if season else 0.0
        error = error + (value - (plain * effect if season == "mul" else plain + effect)) ** 2
        new = alpha * (value / effect if season == "mul" else value - effect) + alpha_rest * plain
        if trend:
            growth = beta * (new - level) + beta_rest * growth
        if season:
            cycle[t % SEASON] = gamma * (value / plain if season == "mul" else value - plain) + gamma_rest * effect
        level = new
    error = np.where(np.isfinite(error), error, np.inf)
    if season == "mul":
        error = np.where((y <= 0).any(axis=1)[:, None], np.inf, error)
    ahead = np.zeros((*shape, horizon))
    for h in range(horizon):
        value = level + (h + 1) * growth
        effect = cycle[(months + h) % SEASON] if season else 0.0
        ahead[:, :, h] = value * effect if season == "mul" else value + effect
    return error, ahead


def fit(y: np.ndarray, trend: bool, season: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, squared error, converged) of each series of ``y``."""
    steps = SEASON_STEPS if season else STEPS
    grid = np.array(list(itertools.product(steps, steps if trend else (0.0,), steps if season else (0.0,))))
    best, error = np.zeros(len(y), int), np.full(len(y), np.inf)
    count = max(1, CELLS // len(grid))
    for at in range(0, len(y), count):
        errors, _ = smooth(y[at : at + count], grid[None], trend, season)
        best[at : at + count], error[at : at + count] = errors.argmin(axis=1), errors.min(axis=1)
    point = grid[best].copy()
    moves = [k for k, used in enumerate((True, trend, season is not None)) if used]
    ways = np.array([s * np.eye(3)[k] for k in moves for s in (1, -1)])
    step = np.full(len(y), FIRST_STEP)
    busy = np.isfinite(error)
    for _ in range(ROUNDS):
        at = np.flatnonzero(busy)
        if not len(at):
            break
        tried = np.clip(point[at, None, :] + step[at, None, None] * ways, 0.0, 1.0)
        errors, _ = smooth(y[at], tried, trend, season)
        pick = errors.argmin(axis=1)
        least = errors[np.arange(len(at)), pick]
        better = least < error[at] * (1 - GAIN)
        point[at[better]], error[at[better]] = tried[better, pick[better]], least[better]
        step[at[~better]] /= 2
        busy[at] = step[at] >= LAST_STEP
    return point, error, np.isfinite(error) & (step < LAST_STEP)


def straight(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared error, forecasts) of the least-squares line through each series."""
    months = y.shape[1]
    t = np.arange(months) - (months - 1) / 2
    slope = y @ t / (t @ t) if months > 1 else np.zeros(len(y))
    rest = y - y.mean(1, keepdims=True) - slope[:, None] * t
    ahead = y.mean(1)[:, None] + slope[:, None] * (np.arange(horizon) + (months + 1) / 2)
    return (rest**2).sum(1), ahead


def fitted(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(form, squared error, forecasts) of each series: the first form of the cascade whose search converged."""
    model = np.full(len(y), LINE, object)
    with np.errstate(all="ignore"):
        error, ahead = straight(y, horizon)
        open_ = np.arange(len(y))
        for label, trend, season in _cascade(y.shape[1]):
            if not len(open_):
                break
            weights, own, converged = fit(y[open_], trend, season)
            _, values = smooth(y[open_], weights[:, None], trend, season, horizon)
            done = converged & np.isfinite(values).all((1, 2))
            at = open_[done]
            model[at], error[at], ahead[at] = label, own[done], values[done, 0]
            open_ = open_[~done]
    return model, error, ahead


def _gathered(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``rows`` or a batch more, the last of fewer."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def smoothing_forecast(series: DataFrame, horizon: int = 3, min_months: int = MIN_MONTHS) -> DataFrame:
    """(series, month, model, forecast, lower, upper, status) for ``horizon`` months after each series (series, month, value).

    Months without a row are not filled in; null values are left out. A series
    of fewer than ``min_months`` (at least 2) has one row with a status and nothing
    else. The band is 1.96 times the in-sample error, cut at zero. An empty table
    gives no rows.
    """
    check_horizon(horizon)
    points = series.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("series").agg(
        F.array_sort(F.collect_list(F.struct("month", "value"))).alias("p"), F.max("month").alias("last")
    )  # a value per month: short whatever the size of the data
    arrays = points.select("series", "last", F.col("p.value").alias("values"))
    least = max(2, min_months)
    schema = "series string, last timestamp_ntz, step int, model string, value double, half double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _gathered(frames, SERIES):
            for months, rows in frame.groupby(frame["values"].map(len)):
                if months < least:
                    yield rows[["series", "last"]].assign(step=None, model=None, value=None, half=None)
                    continue
                y = np.vstack(rows["values"].to_numpy()).astype(float)
                model, error, ahead = fitted(y, horizon)
                each = rows.loc[rows.index.repeat(horizon), ["series", "last"]].reset_index(drop=True)
                each["step"] = np.tile(np.arange(1, horizon + 1), len(rows))
                each["model"] = np.repeat(model, horizon)
                each["value"] = ahead.ravel()
                each["half"] = np.repeat(Z * np.sqrt(error / months), horizon)
                yield each

    done, fit_ = arrays.mapInPandas(run, schema), F.col("step").isNotNull()
    values = {"forecast": F.col("value"), "lower": F.greatest(F.col("value") - F.col("half"), F.lit(0.0)), "upper": F.col("value") + F.col("half")}
    return done.select(
        "series",
        _next_month(F.col("last"), F.col("step")).alias("month"),
        "model",
        *[F.when(fit_, _two(v)).alias(n) for n, v in values.items()],
        F.when(fit_, OK).otherwise(TOO_SHORT).alias("status"),
    )
