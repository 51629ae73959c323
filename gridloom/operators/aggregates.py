"""Resampling, profiles, summaries, robust rates, error and detection measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.robust import median_and_mad
from gridloom.session import stored


def resample(df: DataFrame, keys: Sequence[str], ts="ts", unit="hour", cols: Sequence[str] = ("usage_kwh",), fn="avg"):
    """Aggregate to a regular grid: partial sums are combined before the shuffle."""
    agg = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[fn]
    return df.groupBy(*keys, F.date_trunc(unit, ts).alias(ts)).agg(*[agg(c).alias(c) for c in cols])


def fill_grid(grid: DataFrame, keys: Sequence[str], ts="ts", step="1 hour", cols: Sequence[str] = ("usage_kwh",)):
    """Add the missing grid points; fill forward, then backward, then 0.

    Works on resampled rows: a key has at most one row per calendar step.  After the
    forward fill only leading gaps remain, and those take the key's first known value.
    """
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_f_{c}") for c in cols]
    span = grid.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"), *first)
    spine = span.withColumn(ts, F.explode(F.sequence("_a", "_b", F.expr(f"interval {step}")))).drop("_a", "_b")
    full = spine.join(grid, [*keys, ts], "left")
    back = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, True).over(back), F.col(f"_f_{c}"), F.lit(0.0)) for c in cols}
    return full.withColumns(filled).drop(*[f"_f_{c}" for c in cols])


def resample_filled(df, keys, ts="ts", cols=("usage_kwh",)) -> DataFrame:
    return fill_grid(resample(df, keys, ts, "hour", cols), keys, ts, "1 hour", cols)


def hour_profile(df: DataFrame, keys: Sequence[str], ts="ts", cols=("usage_kwh",)) -> DataFrame:
    return df.groupBy(*keys, F.hour(ts).alias("hour")).agg(*[F.avg(c).alias(c) for c in cols])


def monthly_peak_reduction(df: DataFrame, keys, ts="ts", before="original_load", after="grid_draw", steps_per_hour=4.0):
    """Mean over calendar months of the drop in peak power, negative drops counted as 0."""
    peaks = df.groupBy(*keys, F.date_trunc("month", ts).alias("month")).agg(
        (F.max(before) * steps_per_hour).alias("_a"), (F.max(after) * steps_per_hour).alias("_b")
    )
    return peaks.groupBy(*keys).agg(
        F.avg(F.greatest(F.lit(0.0), F.col("_a") - F.col("_b"))).alias("peak_reduction_kw"),
        F.count(F.lit(1)).alias("months"),
    )


def recent_summary(df: DataFrame, keys: Sequence[str], ts="ts", order=None, n=96, col="usage_kwh") -> DataFrame:
    """Average, peak and time of peak over the last n rows, and the total row count."""
    from gridloom.operators.ranking import recent_rows

    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_rows"))
    last = recent_rows(df, keys, order or [ts], n).groupBy(*keys).agg(
        F.avg(col).alias("avg_load"), F.max(col).alias("peak_load"),
        F.min(F.struct(-F.col(col), F.col(ts).alias("t")))["t"].alias("peak_time"),  # first among equals
    )
    return last.join(total, list(keys))


def severity_breakdown(df: DataFrame, keys: Sequence[str], levels=("Critical", "High", "Medium", "Low")) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in levels],
    )


def health_score(breakdown: DataFrame) -> DataFrame:
    return breakdown.withColumn(
        "health_score", F.greatest(F.lit(0), 100 - 10 * F.col("critical") - 5 * F.col("high"))
    )


def robust_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return median_and_mad(df, keys, cols)


def outlier_rate(df: DataFrame, keys: Sequence[str], cols: Sequence[str], lo=0.005, hi=0.040, threshold=3.0) -> DataFrame:
    """Share of rows with any modified z-score above the threshold, clipped to [lo, hi]."""
    stats = robust_stats(df, keys, cols)
    wide = stats.groupBy(*keys).pivot("feature", list(cols)).agg(F.first("median").alias("med"), F.first("mad").alias("mad"))
    rows = df.select(*keys, *cols).join(stored(wide, "spread"), list(keys))
    marks = [
        F.coalesce(
            (F.col(f"{c}_mad") > 1e-5)
            & (F.abs(F.try_divide(0.6745 * (F.col(c) - F.col(f"{c}_med")), F.col(f"{c}_mad"))) > threshold),
            F.lit(False),
        )
        for c in cols
    ]
    any_mark = marks[0]
    for m in marks[1:]:
        any_mark = any_mark | m
    out = rows.groupBy(*keys).agg(F.avg(any_mark.cast("double")).alias("raw_rate"))
    return out.withColumn("rate", F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("raw_rate"))))


def baseline_thresholds(df: DataFrame, keys: Sequence[str], col="usage_kwh") -> DataFrame:
    """Overall mean and deviation, leak and spike thresholds, in one aggregation."""
    light = F.when(F.contains(F.lower("load_type"), F.lit("light")), F.col(col))
    return (
        df.groupBy(*keys)
        .agg(
            F.avg(col).alias("mean_all"), F.stddev_samp(col).alias("std_all"),
            F.avg(light).alias("_ml"), F.stddev_samp(light).alias("_sl"), F.count(light).alias("_nl"),
        )
        .withColumn(
            "leak_threshold",
            F.when(F.col("_nl") == 0, F.lit(5.0 + 2.0 * 2.0)).otherwise(F.col("_ml") + 2.0 * F.col("_sl")),
        )
        .withColumn("spike_threshold", F.col("mean_all") + 3.0 * F.col("std_all"))
        .drop("_ml", "_sl", "_nl")
    )


def moments(df: DataFrame, keys: Sequence[str], col="usage_kwh") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.coalesce(F.var_samp(col), F.lit(0.0)).alias("variance"),
        F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias("std"),
    )


def forecast_errors(df: DataFrame, keys: Sequence[str], actual="actual", predicted="predicted") -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return (
        df.groupBy(*keys)
        .agg(
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"),
            (F.avg(F.abs(e / F.greatest(F.col(actual), F.lit(1.0)))) * 100).alias("mape"),
            F.sum(e * e).alias("_sse"),
            (F.var_pop(actual) * F.count(actual)).alias("_sst"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("r2", F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")))
        .drop("_sse", "_sst")
    )


def detection_metrics(df: DataFrame, keys: Sequence[str] = (), truth="y_true", pred="y_pred") -> DataFrame:
    """False-alarm rate here is the share of flagged rows that are wrong."""
    hit, flagged, real = (F.col(truth) == 1) & (F.col(pred) == 1), F.col(pred) == 1, F.col(truth) == 1
    out = df.groupBy(*keys).agg(
        F.count_if(flagged).alias("flagged"),
        F.count_if(hit).alias("tp"),
        F.count_if(flagged & ~real).alias("fp"),
        F.count_if(real).alias("_real"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("flagged")),
            "recall": ratio(F.col("tp"), F.col("_real")),
            "far": ratio(F.col("fp"), F.col("flagged")),
        }
    )
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1).drop("_real")


LEAK_TYPES = ("Idle Energy Leak", "Weekend Energy Leak", "Machinery Idling")


def leak_totals(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (
        df.filter(F.col("anomaly_type").isin(*LEAK_TYPES))
        .groupBy(*keys, "anomaly_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("usage_kwh").alias("leak_kwh"))
    )


def self_consumption(df: DataFrame, keys: Sequence[str], used="solar_used", generated="solar_generated") -> DataFrame:
    total = F.sum(generated)
    share = F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(used) / total))).otherwise(1.0)
    return df.groupBy(*keys).agg(share.alias("self_consumption"), total.alias("solar_generated"))


def exact_sum(col: Column | str, scale=6) -> Column:
    """Sum in decimals, so the result does not depend on the order of addition."""
    col = F.col(col) if isinstance(col, str) else col
    return F.sum(F.round(col, scale).cast(f"decimal(28,{scale})")).cast("double")


def emission_totals(df: DataFrame, keys: Sequence[str], scopes: Mapping[str, str] | None = None) -> DataFrame:
    scopes = scopes or {"scope1_co2_kg": "scope1_kg", "scope2_co2_kg": "scope2_kg", "scope3_co2_kg": "scope3_kg"}
    out = df.groupBy(*keys).agg(*[exact_sum(c).alias(n) for c, n in scopes.items()])
    total = sum((F.col(n) for n in scopes.values()), F.lit(0.0))
    return out.withColumn("total_tco2", total / 1000.0)


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: name, type, non-null count and table rows; a single pass."""
    cols = df.schema.fields
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{f.name}`")).alias(f"_c{i}") for i, f in enumerate(cols)])
    entries = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"),
                F.col(f"_c{i}").alias("non_null"), F.col("_n").alias("row_count"),
            )
            for i, f in enumerate(cols)
        ]
    )
    return counts.select(F.inline(entries))
