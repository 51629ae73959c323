"""Dimension joins, weather, membership flags and parameter fan-out.

Literal dimensions carry their broadcast hint from ``gridloom.dims``: their size is fixed.
No hint is given here, so Spark broadcasts any other side only when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.dims import band_hours


def join_hour_curve(df: DataFrame, curve: DataFrame, ts="ts") -> DataFrame:
    """Adds tariff, carbon_g and solar_factor of the row's clock hour."""
    c = curve.withColumnRenamed("hour", "_h")
    return df.join(c, F.hour(ts) == F.col("_h")).drop("_h")


def join_tod_bands(df: DataFrame, bands: DataFrame, tariffs: DataFrame, utility="utility", ts="ts") -> DataFrame:
    """Adds ``band`` and ``rate``: base plus peak surcharge or minus off-peak rebate.

    Bands are unrolled to clock hours first, so the range join becomes an equi-join.
    """
    hours = band_hours(bands).select(F.col("utility").alias("_u"), F.col("hour").alias("_h"), "band")
    rates = tariffs.select(F.col("utility").alias("_u2"), "base_rate", "peak_surcharge", "offpeak_rebate")
    out = df.join(hours, (F.col(utility) == F.col("_u")) & (F.hour(ts) == F.col("_h")), "left")
    out = out.join(rates, F.col(utility) == F.col("_u2"))
    rate = (
        F.when(F.col("band") == "peak", F.col("base_rate") + F.col("peak_surcharge"))
        .when(F.col("band") == "offpeak", F.col("base_rate") - F.col("offpeak_rebate"))
        .otherwise(F.col("base_rate"))
    )
    return (
        out.withColumn("rate", rate)
        .withColumn("band", F.coalesce("band", F.lit("normal")))
        .drop("_u", "_u2", "_h", "base_rate", "peak_surcharge", "offpeak_rebate")
    )


def join_dim(df: DataFrame, dim: DataFrame, key: str, default: Mapping[str, object]) -> DataFrame:
    """Look up a dimension; keys it lacks take the default row."""
    out = df.join(dim.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k"), "left").drop("_k")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in default.items()})


def join_weather(df: DataFrame, weather: DataFrame, ts="ts", on: Sequence[str] = ()) -> DataFrame:
    """Exact-time match of temperature and cloud; what is missing reads 20.0 and 0.3."""
    cols = [*on, ts]
    return df.join(weather.select(*cols, "temp", "cloud"), cols, "left").withColumns(
        {"temp": F.coalesce("temp", F.lit(20.0)), "cloud": F.coalesce("cloud", F.lit(0.3))}
    )


def flag_members(df: DataFrame, keys_df: DataFrame, on: Sequence[str], name="flagged") -> DataFrame:
    """Mark rows whose key appears in ``keys_df``."""
    marks = keys_df.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(marks, list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def fan_out(df: DataFrame, params: Mapping[str, Sequence]) -> DataFrame:
    """One copy of each row per combination of literal parameter values."""
    for name, values in params.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def site_factor_join(df: DataFrame, factors: DataFrame, key="region", default=0.73) -> DataFrame:
    return join_dim(df, factors, key, {"grid_factor": default})
