"""End-to-end programs composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import dims
from gridloom.operators import aggregates, cleaning, emissions, forecasting, forest, recurrences, windows
from gridloom.operators.evaluation import standard_scale
from gridloom.operators.ranking import best_model
from gridloom.session import cut_lineage


def hourly_load_cost_emissions(readings: DataFrame, keys: Sequence[str] = ("meter_id",), ts="ts") -> DataFrame:
    """Hourly load, cost and scope 2/3 emissions per meter with gaps filled."""
    curve = dims.hour_curve(readings.sparkSession)
    rows = emissions.scope23(readings.select(*keys, ts, "usage_kwh"), curve, ts)
    cols = ("usage_kwh", "cost", "scope2_co2_kg", "scope3_co2_kg")
    return aggregates.resample_filled(rows, list(keys), ts, cols)


ANOMALY_FEATURES = (
    "usage_kwh", "reactive_lagging_kvarh", "reactive_leading_kvarh", "power_factor_lagging", "power_factor_leading",
    "usage_mean_1h", "usage_std_1h", "usage_mean_4h", "usage_std_4h", "hour_sin", "hour_cos", "thd_pct", "voltage_v",
)


def anomaly_features(df: DataFrame, keys, order, ts="ts") -> DataFrame:
    """Defaults, power-quality estimates, rolling and cyclic columns, imputed means."""
    out = cleaning.default_missing_columns(df)
    out = emissions.power_quality_proxy(out, keys)
    out = windows.rolling(
        out, keys, order, "usage_kwh",
        {"usage_mean_1h": (4, "mean"), "usage_std_1h": (4, "std"),
         "usage_mean_4h": (16, "mean"), "usage_std_4h": (16, "std")},
    )
    out = cleaning.cyclic_hour(out, ts)
    return cleaning.mean_impute(out, keys, ["reactive_lagging_kvarh", "power_factor_lagging"])


def detect_anomalies(
    df: DataFrame, keys=("meter_id",), order=("ts", "reading_id"), ts="ts", rate: float | None = None,
    trees=100, sample=256, seed=42,
) -> DataFrame:
    """Flag unusual readings with a forest and explain them with rules; all rows, all meters.

    ``rate`` None: the share of robust outliers, between 0.5 % and 4 %.  The readings
    feed peaks, chunks and rolling frames, the feature table the rate, the fit, the scores and
    the rules, so both are materialised once.
    """
    keys, order = list(keys), list(order)
    feats = cut_lineage(anomaly_features(cut_lineage(df), keys, order, ts))
    # one forest serves all meters: each feature counts in deviations of its own meter
    scaled = standard_scale(feats, keys, ANOMALY_FEATURES)
    columns = [f"{c}_z" for c in ANOMALY_FEATURES]
    if rate is None:
        rate = aggregates.outlier_rate(feats.withColumn("_all", F.lit(1)), ["_all"], ANOMALY_FEATURES).first()["rate"]
    nodes = forest.fit(scaled, columns, [*keys, order[-1]], trees, sample, seed)
    scored = cut_lineage(forest.score(scaled, nodes, columns, sample).select(*feats.columns, "score"))
    flagged = forest.flag(scored, rate).filter("is_outlier")
    return emissions.classify_anomaly(flagged, aggregates.baseline_thresholds(feats, keys), keys)


def forecast(df: DataFrame, keys=("meter_id",), ts="ts", horizon=48, ratio=0.9, col="usage_kwh") -> DataFrame:
    """Actuals and forecasts per meter, model and step, as one long table.

    The forest works on each meter's own scale.
    """
    keys = list(keys)
    cols = [col] + (["temp"] if "temp" in df.columns else [])
    hourly = cut_lineage(aggregates.resample_filled(df, keys, ts, cols))
    feats = forecasting.temporal_features(hourly, keys, ts, col)
    parts = cut_lineage(windows.split_by_position(feats, keys, [ts], ratio, horizon))
    train = parts.filter("part = 'train'")
    from pyspark.sql import Window

    steps = Window.partitionBy(*keys).orderBy(ts)  # at most ``horizon`` rows per key
    ahead = parts.filter("part = 'test'").withColumn("step", (F.row_number().over(steps) - 1).cast("bigint"))
    truth = ahead.select(*keys, ts, "step", F.col(col).alias("actual"))
    naive = forecasting.persistence_forecast(parts, keys, [ts], col).select(*keys, ts, "predicted")
    smooth = forecasting.holt_winters(train, keys, [ts], horizon, col)
    scale = cut_lineage(forecasting.series_scale(train, keys, col))
    scaled = forecasting.to_scale(train, scale, keys, [col, "lag_1d", "lag_7d"])
    model = forecasting.rf_fit(scaled, col)
    future = forecasting.to_scale(ahead.select(*keys, ts, "step", "temp"), scale, keys, [])
    wood = forecasting.from_scale(forecasting.rf_forecast(model, scaled, future, keys, horizon, ts, col), scale, keys)
    named = [
        ("persistence", truth.join(naive, [*keys, ts])),
        ("holt_winters", truth.join(smooth, [*keys, "step"])),
        ("random_forest", truth.join(wood, [*keys, "step"])),
    ]
    out = None
    for name, rows in named:
        one = rows.select(*keys, ts, "step", "actual", "predicted", F.lit(name).alias("model"))
        out = one if out is None else out.unionByName(one)
    return out


def forecast_summary(long: DataFrame, keys=("meter_id",)) -> DataFrame:
    """Errors per meter and model with the best model marked."""
    keys = list(keys)
    errors = aggregates.forecast_errors(long, [*keys, "model"])
    best = best_model(errors, keys).select(*keys, "best_model")
    return errors.join(best, keys).withColumn("is_best", F.col("model") == F.col("best_model"))


def forecast_report(df: DataFrame, keys=("meter_id",), ts="ts", horizon=48, ratio=0.9, folds=3, col="usage_kwh") -> DataFrame:
    """Errors per meter and model, with the unit-root test of the meter and the errors of a backtest."""
    keys = list(keys)
    hourly = cut_lineage(aggregates.resample_filled(df, keys, ts, [col]))
    summary = forecast_summary(forecast(df, keys, ts, horizon, ratio, col), keys)
    stationary = forecasting.adf(hourly, keys, [ts], col).select(
        *keys, F.col("p_value").alias("adf_p"), "is_stationary"
    )
    tested = forecasting.backtest(hourly, keys, folds, horizon, ts, col).select(
        *keys, "model", F.col("rmse").alias("backtest_rmse"), F.col("mae").alias("backtest_mae")
    )
    return summary.join(stationary, keys, "left").join(tested, [*keys, "model"], "left")


def retrain(df: DataFrame, keys=("meter_id",), order=("ts",), ts="ts", col="usage_kwh") -> DataFrame:
    """One status row per meter: rejected with its reason, or rows, drift and best model.

    Models are ranked on hourly means, at most one row per meter and calendar hour.
    """
    keys, order = list(keys), list(order)
    checks = cleaning.validate_table(
        df.withColumnRenamed(ts, "timestamp"), required=("timestamp", col), keys=keys
    )
    verdict = checks.groupBy(*keys).agg(
        F.min(F.col("ok")).alias("valid"),
        F.concat_ws(", ", F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("rule"))))).alias("reason"),
    )
    good = df.join(verdict.filter("valid").select(*keys), keys)
    cleaned = cut_lineage(cleaning.clean_series(good, keys, ts, col, order))
    rows = cleaned.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_processed"))
    drift = recurrences.drift_summary(recurrences.cusum(cleaned.select(*keys, *order, col), keys, order, col), keys)
    hourly = cut_lineage(aggregates.resample_filled(cleaned, keys, ts, [col]))
    board = forecasting.leaderboard(hourly, keys, [ts], 0.8, ts, col)
    best = best_model(board, keys)
    return (
        verdict.join(rows, keys, "left").join(drift, keys, "left").join(best, keys, "left")
        .withColumn("status", F.when(F.col("valid"), "success").otherwise("error"))
    )
