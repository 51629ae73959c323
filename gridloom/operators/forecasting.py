"""Forecasts and tests on hourly series.

Inputs are resampled first, so a series has at most one row per calendar hour and may be
one unit of work; parallelism comes from the number of series and folds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.operators.aggregates import forecast_errors, hour_profile, resample_filled
from gridloom.operators.recurrences import doubles, segment_map
from gridloom.operators.windows import rolling_origin_folds, split_by_position
from gridloom.session import cut_lineage

# --- Fixed values: search grid, defaults, lag candidates and critical values -----------
SMOOTHING_GRID = (0.1, 0.3, 0.5, 0.7)
DEFAULT_SMOOTHING = (0.3, 0.1, 0.2)
ADF_LAGS = (4, 12, 24, 48, 96, 168)
ADF_STEPS = ((-3.96, 0.01), (-3.41, 0.05), (-3.12, 0.10))
FEATURES = ("hour", "weekday", "month", "is_weekend", "lag_1d", "lag_7d", "temp")
# --- End of fixed values ------------------------------------------------------------


def _smooth(y: np.ndarray, m: int, alpha, beta, gamma, level, trend, season, first: int):
    """Additive level/trend/season updates from row ``first``; parameters may be arrays.

    Returns the final state and the mean squared one-step error.
    """
    sse = 0.0
    for t in range(first, len(y)):
        i = t % m
        s = season[i]
        sse = sse + (y[t] - (level + trend + s)) ** 2
        new = alpha * (y[t] - s) + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend
        season[i] = gamma * (y[t] - new) + (1 - gamma) * s
        level = new
    return level, trend, season, sse / max(len(y) - first, 1)


def _tune(y: np.ndarray, m: int, rows: int | None = None):
    """Grid search on the series (or its last ``rows``), all combinations advanced together.

    Fewer than two cycles give the default setting.
    """
    y = y[-rows:] if rows else y
    if len(y) < 2 * m:
        return DEFAULT_SMOOTHING, None
    grid = np.array([(a, b, g) for a in SMOOTHING_GRID for b in SMOOTHING_GRID for g in SMOOTHING_GRID])
    a, b, g = grid.T
    level = np.full(len(grid), y[:m].mean())
    trend = np.full(len(grid), (y[m : 2 * m].mean() - y[:m].mean()) / m)
    season = np.repeat((y[:m] - y[:m].mean())[:, None], len(grid), axis=1)
    mse = _smooth(y, m, a, b, g, level, trend, season, m)[3]
    best = int(np.argmin(mse))
    return tuple(float(v) for v in grid[best]), float(mse[best])


def _holt_winters(y: np.ndarray, horizon: int, m: int, params) -> np.ndarray:
    season = (y[:m] - y[:m].mean()).copy() if len(y) >= m else np.zeros(m)
    level = y[:m].mean() if len(y) >= m else y[0]
    trend = (y[m : 2 * m].mean() - y[:m].mean()) / m if len(y) >= 2 * m else 0.0
    level, trend, season, _ = _smooth(y, m, *params, level, trend, season, 0)
    steps = np.arange(horizon)
    return np.maximum(0.0, level + (steps + 1) * trend + season[(len(y) + steps) % m])


def _key_schema(df: DataFrame, keys, extra: str) -> StructType:
    return StructType([df.schema[k] for k in keys] + StructType.fromDDL(extra).fields)


def _repeat(t: pa.Table, keys, n: int) -> dict:
    return {k: pa.array([t.column(k)[0].as_py()] * n, t.schema.field(k).type) for k in keys}


def holt_winters_tune(hourly: DataFrame, keys, order, col="usage_kwh", m=24, tune_rows: int | None = None) -> DataFrame:
    """Best (alpha, beta, gamma) of 64 per series by one-step error."""
    keys = list(keys)

    def run(t):
        (a, b, g), mse = _tune(doubles(t, col), m, tune_rows)
        return pa.table(_repeat(t, keys, 1) | {
            "alpha": [a], "beta": [b], "gamma": [g], "mse": pa.array([mse], pa.float64()),
        })

    return segment_map(hourly.select(*keys, *order, col), keys, order, run,
                       _key_schema(hourly, keys, "alpha double, beta double, gamma double, mse double"))


def holt_winters(train: DataFrame, keys, order, horizon: int, col="usage_kwh", m=24, params=None) -> DataFrame:
    """``horizon`` steps ahead of each series' end; tuned per series unless given."""
    keys = list(keys)

    def run(t):
        y = doubles(t, col)
        out = _holt_winters(y, horizon, m, params or _tune(y, m)[0])
        return pa.table(_repeat(t, keys, horizon) | {"step": np.arange(horizon), "predicted": out})

    return segment_map(train.select(*keys, *order, col), keys, order, run,
                       _key_schema(train, keys, "step bigint, predicted double"))


def _adf(y: np.ndarray):
    """(lag, t-statistic, p): trend regression with the lag order of least AIC.

    Lag orders that leave no degrees of freedom are passed over.
    """
    best = None
    n = len(y)
    dy = np.diff(y)
    for lag in (c for c in ADF_LAGS if n > c + 20):
        rows = np.arange(lag, n - 1)
        lagged = np.lib.stride_tricks.sliding_window_view(dy, lag)[: len(rows), ::-1]
        x = np.column_stack([np.ones(len(rows)), rows, y[lag:-1], lagged])
        z = dy[lag:]
        free = len(z) - x.shape[1]
        if free <= 0:
            continue
        coef = np.linalg.lstsq(x, z, rcond=None)[0]
        sse = float(((z - x @ coef) ** 2).sum())
        aic = len(z) * np.log(max(1e-10, sse / len(z))) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            try:
                se = np.sqrt(np.linalg.inv(x.T @ x)[2, 2] * sse / free)
            except np.linalg.LinAlgError:
                continue
            best = (aic, lag, float(coef[2] / se) if se > 0 else 0.0)
    if best is None:
        return None, 0.0, 1.0
    p = next((p for limit, p in ADF_STEPS if best[2] < limit), 0.99)
    return best[1], best[2], p


def adf(hourly: DataFrame, keys, order, col="usage_kwh") -> DataFrame:
    """Unit-root test per series; stationary where p < 0.05."""
    keys = list(keys)

    def run(t):
        lag, stat, p = _adf(doubles(t, col))
        return pa.table(_repeat(t, keys, 1) | {
            "lag": pa.array([lag], pa.int32()), "t_stat": [stat], "p_value": [p], "is_stationary": [p < 0.05],
        })

    return segment_map(hourly.select(*keys, *order, col), keys, order, run,
                       _key_schema(hourly, keys, "lag int, t_stat double, p_value double, is_stationary boolean"))


def hour_mean_forecast(parts: DataFrame, keys, ts="ts", col="usage_kwh", min_train=48) -> DataFrame:
    """Training mean by clock hour, else the training mean; test rows with ``predicted``."""
    keys = list(keys)
    train, test = parts.filter("part = 'train'"), parts.filter("part <> 'train'")
    overall = train.groupBy(*keys).agg(F.avg(col).alias("_mean"), F.count(F.lit(1)).alias("_rows"))
    by_hour = hour_profile(train, keys, ts, [col]).withColumnRenamed(col, "_hour_mean")
    out = test.withColumn("hour", F.hour(ts)).join(by_hour, [*keys, "hour"], "left").join(overall, keys)
    guess = F.when(F.col("_rows") >= min_train, F.coalesce("_hour_mean", "_mean")).otherwise(F.col("_mean"))
    return out.withColumn("predicted", guess).drop("_hour_mean", "_mean", "_rows", "hour")


def persistence_forecast(parts: DataFrame, keys, order, col="usage_kwh", n=24) -> DataFrame:
    """Test rows with the value n rows earlier (else the training mean) as ``predicted``."""
    keys = list(keys)
    mean = parts.filter("part = 'train'").groupBy(*keys).agg(F.avg(col).alias("_mean"))
    w = Window.partitionBy(*keys).orderBy(*order)  # hourly rows: bounded by the calendar
    out = parts.withColumn("_back", F.lag(col, n).over(w)).filter("part <> 'train'")
    return out.join(mean, keys).withColumn("predicted", F.coalesce("_back", "_mean")).drop("_back", "_mean")


# --- random forest with block recursion -------------------------------------------------

def temporal_features(hourly: DataFrame, keys, ts="ts", col="usage_kwh") -> DataFrame:
    """Calendar columns, row lags of 24 and 168 filled with the series mean, temperature."""
    w = Window.partitionBy(*keys).orderBy(ts)  # hourly rows: bounded by the calendar
    means = hourly.groupBy(*keys).agg(F.avg(col).alias("_mean"))
    out = hourly.withColumn("_l1", F.lag(col, 24).over(w)).withColumn("_l7", F.lag(col, 168).over(w))
    out = out.join(means, list(keys)).withColumns({
        "lag_1d": F.coalesce("_l1", "_mean"), "lag_7d": F.coalesce("_l7", "_mean"),
    }).drop("_l1", "_l7", "_mean")
    return with_calendar(out, ts)


def with_calendar(df: DataFrame, ts="ts") -> DataFrame:
    out = df.withColumns({
        "hour": F.hour(ts), "weekday": F.weekday(ts), "month": F.month(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
    })
    return out if "temp" in out.columns else out.withColumn("temp", F.lit(28.0))


def _vector(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def series_scale(train: DataFrame, keys, col="usage_kwh") -> DataFrame:
    """(keys, _mean, _sd) of the training rows; a constant series has deviation 1."""
    sd = F.stddev_pop(col)
    return train.groupBy(*keys).agg(F.avg(col).alias("_mean"), F.when(sd > 0, sd).otherwise(1.0).alias("_sd"))


def to_scale(df: DataFrame, scale: DataFrame, keys, cols) -> DataFrame:
    """``cols`` in deviations from their series' training mean; ``_floor`` is the scaled zero."""
    return df.join(scale, list(keys)).withColumns(
        {c: (F.col(c) - F.col("_mean")) / F.col("_sd") for c in cols}
    ).withColumn("_floor", -F.col("_mean") / F.col("_sd")).drop("_mean", "_sd")


def from_scale(df: DataFrame, scale: DataFrame, keys, col="predicted") -> DataFrame:
    return df.join(scale, list(keys)).withColumn(col, F.col(col) * F.col("_sd") + F.col("_mean")).drop("_mean", "_sd")


def rf_fit(train: DataFrame, col="usage_kwh", trees=50, depth=10, seed=42):
    """Random-forest regression over the training rows of all series.

    One model serves all series, so its target and lags should be on each series' own scale
    (``to_scale``): then no series is drawn to the level of the others.
    """
    from pyspark.ml.regression import RandomForestRegressor

    rf = RandomForestRegressor(labelCol=col, numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features")
    return rf.fit(_vector(train.select(*FEATURES, col)))


def rf_forecast(model, history: DataFrame, future: DataFrame, keys, horizon: int, ts="ts", col="usage_kwh") -> DataFrame:
    """Recursive forecast in blocks of 24 steps.

    The shortest lag is 24 rows, so the 24 rows of a block depend only on rows before it:
    ceil(horizon/24) passes replace one pass per step.  ``future`` holds (keys, ts, step,
    temp), and the least possible value in ``_floor`` where that is not 0.  The known rows a
    block needs are the last 168, so only those are carried.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    known = (
        history.select(*keys, ts, F.col(col).alias("y"))
        .withColumn("_b", F.row_number().over(w)).filter("_b <= 168")
        .select(*keys, (-F.col("_b")).cast("bigint").alias("step"), "y")
    )
    ends = known.groupBy(*keys).agg(F.min("step").alias("_first"), F.max_by("y", "step").alias("_newest"))
    out, floor = None, F.col("_floor") if "_floor" in future.columns else F.lit(0.0)
    for start in range(0, horizon, 24):
        block = future.filter((F.col("step") >= start) & (F.col("step") < min(start + 24, horizon)))
        rows = block.join(ends, keys)
        for name, lag in (("lag_1d", 24), ("lag_7d", 168)):
            past = known.select(*keys, (F.col("step") + lag).alias("step"), F.col("y").alias(f"_{name}"))
            rows = rows.join(past, [*keys, "step"], "left")
        # a series shorter than the lag repeats its newest known value
        rows = rows.withColumns({n: F.coalesce(f"_{n}", "_newest") for n in ("lag_1d", "lag_7d")})
        done = model.transform(_vector(with_calendar(rows, ts))).select(
            *keys, "step", F.greatest(floor, F.col("prediction")).alias("y")
        )
        if start + 24 < horizon:
            done = cut_lineage(done)
            known = known.unionByName(done)
            ends = known.groupBy(*keys).agg(F.min("step").alias("_first"), F.max_by("y", "step").alias("_newest"))
        out = done if out is None else out.unionByName(done)
    return out.withColumnRenamed("y", "predicted")


# --- evaluation ---------------------------------------------------------------------------

def backtest(hourly: DataFrame, keys, folds=3, horizon=48, ts="ts", col="usage_kwh", with_forest=True) -> DataFrame:
    """Mean error per model over rolling origins; folds are rows, not driver loops.

    Only the forest is fitted fold by fold, since each fold needs its own model.
    """
    keys = list(keys)
    parts = rolling_origin_folds(hourly, keys, [ts], folds, horizon)
    fkeys = [*keys, "fold"]
    truth = parts.filter("part = 'validate'").select(*fkeys, "step", ts, F.col(col).alias("actual"))
    naive = persistence_forecast(parts, fkeys, [ts], col).select(*fkeys, "step", "predicted")
    smooth = holt_winters(parts.filter("part = 'train'"), fkeys, [ts], horizon, col)
    guesses = [("persistence", naive), ("holt_winters", smooth)]
    if with_forest:
        feats = temporal_features(hourly, keys, ts, col)
        fparts = cut_lineage(rolling_origin_folds(feats, keys, [ts], folds, horizon))
        per_fold = []
        for f in range(folds):
            one = fparts.filter(F.col("fold") == f)
            scale = cut_lineage(series_scale(one.filter("part = 'train'"), keys, col))
            one = to_scale(one, scale, keys, [col, "lag_1d", "lag_7d"])
            model = rf_fit(one.filter("part = 'train'"), col, trees=30, depth=8)
            ahead = one.filter("part = 'validate'").select(*keys, ts, "step", "temp", "_floor")
            guess = rf_forecast(model, one.filter("part = 'train'"), ahead, keys, horizon, ts, col)
            guess = from_scale(guess, scale, keys)
            per_fold.append(guess.withColumn("fold", F.lit(f)).select(*fkeys, "step", "predicted"))
        forest = per_fold[0]
        for p in per_fold[1:]:
            forest = forest.unionByName(p)
        guesses.append(("random_forest", forest))
    scored = None
    for name, g in guesses:
        one = truth.join(g, [*fkeys, "step"]).withColumn("model", F.lit(name))
        scored = one if scored is None else scored.unionByName(one)
    errors = forecast_errors(scored, [*fkeys, "model"])
    return errors.groupBy(*keys, "model").agg(
        F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("mape").alias("mape"),
        F.count(F.lit(1)).alias("folds"),
    )


def combine_leaderboard(tables: Sequence[tuple[str, DataFrame]], keys, actual="usage_kwh") -> DataFrame:
    """Forecasts of several models (rows with ``predicted``) as one ranked error table."""
    rows = None
    for name, df in tables:
        one = df.select(*keys, F.col(actual).alias("actual"), "predicted", F.lit(name).alias("model"))
        rows = one if rows is None else rows.unionByName(one)
    errors = forecast_errors(rows, [*keys, "model"])
    w = Window.partitionBy(*keys).orderBy("rmse", "model")  # one row per model
    return errors.withColumn("rank", F.row_number().over(w))


def leaderboard(hourly: DataFrame, keys, order, ratio=0.8, ts="ts", col="usage_kwh") -> DataFrame:
    parts = split_by_position(hourly, keys, order, ratio)
    return combine_leaderboard(
        [("hour_mean", hour_mean_forecast(parts, keys, ts, col)),
         ("persistence", persistence_forecast(parts, keys, order, col))],
        keys, col,
    )


__all__ = [
    "adf", "backtest", "combine_leaderboard", "holt_winters", "holt_winters_tune", "hour_mean_forecast",
    "from_scale", "leaderboard", "persistence_forecast", "resample_filled", "rf_fit", "rf_forecast", "series_scale",
    "temporal_features", "to_scale",
]
