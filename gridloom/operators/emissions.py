"""Scope 1/2/3 emissions, solar yield, anomaly rules, alerts and message parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.physics import solar_columns
from gridloom.operators.joins import join_hour_curve
from gridloom.operators.recurrences import ewma, thermal_state
from gridloom.session import stored

# --- Fixed values: emission coefficients and rule limits ------------------------------
GAS_PER_KWH = 0.062176
CO2_PER_GAS = 1.93
SCOPE3_PER_KWH = 0.220
SCOPE3_PER_DAY = 5.0
SAG_V, SWELL_V, THD_LIMIT, IDLE_PF, IDLE_KWH = 390.0, 430.0, 8.0, 45.0, 10.0
# --- End of fixed values ------------------------------------------------------------


def priced_scopes(smoothed: DataFrame, curve: DataFrame, ts="ts", smooth="_smooth", given="") -> DataFrame:
    """Scopes and total of readings with their smoothed load, unrounded.

    A value that came with a reading, in a column of the result's name behind ``given``, wins
    over the computed one; so does ``nsm``, the seconds since midnight.
    """
    def nsm():
        hour = F.hour(ts) * 3600
        return F.coalesce(F.col(f"{given}nsm"), hour) if f"{given}nsm" in smoothed.columns else hour

    def supplied(name, computed):
        return F.coalesce(F.col(f"{given}{name}"), computed) if f"{given}{name}" in smoothed.columns else computed

    out = join_hour_curve(smoothed.withColumn("nsm", nsm()), curve, ts)
    out = out.withColumns({
        "scope1_co2_kg": supplied("scope1_co2_kg", F.col(smooth) * GAS_PER_KWH * CO2_PER_GAS),
        "scope2_co2_kg": supplied("scope2_co2_kg", F.col("usage_kwh") * (F.col("carbon_g") / 1000.0)),
        "scope3_co2_kg": supplied("scope3_co2_kg", F.col("usage_kwh") * SCOPE3_PER_KWH + SCOPE3_PER_DAY * (F.col("nsm") / 86400.0)),
    })
    total = (F.col("scope1_co2_kg") + F.col("scope2_co2_kg") + F.col("scope3_co2_kg")) / 1000.0
    return out.withColumn("co2_tco2", supplied("co2_tco2", total)).drop("tariff", "carbon_g", "solar_factor")


def emissions_ingest(df: DataFrame, curve: DataFrame, keys: Sequence[str], ts="ts", order=None) -> DataFrame:
    """Scopes for arriving readings, unrounded; supplied values win over computed ones."""
    return priced_scopes(ewma(df, keys, order or [ts], "usage_kwh", alpha=0.2, name="_smooth"), curve, ts).drop("_smooth")


def scope23(df: DataFrame, curve: DataFrame, ts="ts") -> DataFrame:
    """Row-wise scopes 2 and 3 with tariff cost; no ordering needed."""
    out = join_hour_curve(df, curve, ts)
    return out.withColumns(
        {
            "cost": F.col("usage_kwh") * F.col("tariff"),
            "scope2_co2_kg": F.col("usage_kwh") * (F.col("carbon_g") / 1000.0),
            "scope3_co2_kg": F.col("usage_kwh") * SCOPE3_PER_KWH + SCOPE3_PER_DAY * (F.hour(ts) * 3600 / 86400.0),
        }
    ).drop("tariff", "carbon_g", "solar_factor")


def carbon_intensity(df: DataFrame, curve: DataFrame, ts="ts") -> DataFrame:
    """Grid intensity corrected for cloud and solar share, kept within [150, 600]."""
    out = join_hour_curve(df, curve, ts)
    raw = F.col("carbon_g") - 120.0 * (1.0 - F.col("cloud")) * (F.col("solar_factor") / 1.2)
    return out.withColumn("carbon_intensity", F.greatest(F.lit(150.0), F.least(F.lit(600.0), raw))).drop(
        "tariff", "carbon_g", "solar_factor"
    )


def emissions_batch(df: DataFrame, curve: DataFrame, keys: Sequence[str], ts="ts", order=None) -> DataFrame:
    """Scopes for a loaded history, unrounded; needs ``temp`` and ``cloud``."""
    out = carbon_intensity(thermal_state(df, keys, order or [ts], "usage_kwh", "temp"), curve, ts)
    gas = F.greatest(F.lit(0.0), (200.0 - F.col("thermal_state_c")) * 0.12 + 0.05 * F.col("usage_kwh"))
    out = out.withColumns(
        {
            "scope1_co2_kg": gas * CO2_PER_GAS,
            "scope2_co2_kg": F.col("usage_kwh") * (F.col("carbon_intensity") / 1000.0),
            "scope3_co2_kg": F.col("usage_kwh") * SCOPE3_PER_KWH
            + SCOPE3_PER_DAY * ((F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / 86400.0),
        }
    )
    return out.withColumn(
        "co2_tco2",
        (F.col("scope1_co2_kg") + F.col("scope2_co2_kg") + F.col("scope3_co2_kg")) / 1000.0,
    )


def solar_yield(df: DataFrame, ts="ts", lat="lat_deg", temp="temp", cloud="cloud") -> DataFrame:
    return df.withColumns(solar_columns(F.col(ts), F.col(lat), F.col(temp), F.col(cloud)))


def power_quality_proxy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distortion and voltage estimated from load; measured columns stay as they are."""
    peaks = stored(df.groupBy(*keys).agg(F.max("usage_kwh").alias("_peak")), "peaks")
    out = df.join(peaks, list(keys))
    thd = 1.5 + 5.0 * (F.col("reactive_lagging_kvarh") / (F.col("usage_kwh") + 1.0))
    volts = 415.0 - 15.0 * (F.col("usage_kwh") / (F.col("_peak") + 1.0))
    new = {}
    if "thd_pct" not in df.columns:
        new["thd_pct"] = F.round(F.greatest(F.lit(0.5), F.least(F.lit(15.0), thd)), 2)
    if "voltage_v" not in df.columns:
        new["voltage_v"] = F.round(volts, 1)
    return out.withColumns(new).drop("_peak")


def classify_anomaly(df: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First matching rule gives type, severity and explanation."""
    t = thresholds.select(*keys, "mean_all", "std_all", "leak_threshold", "spike_threshold")
    rows = df.join(t, list(keys))
    kwh, volts, thd, pf = (F.col(c) for c in ("usage_kwh", "voltage_v", "thd_pct", "power_factor_lagging"))
    light = F.contains("load_type", F.lit("Light"))
    rules = [
        (kwh > F.col("spike_threshold"), "Critical Power Spike", "Critical",
         F.format_string("%.2f kWh is more than three deviations above the mean of %.2f kWh", kwh, F.col("mean_all"))),
        (volts < SAG_V, "Voltage Sag", "High", F.format_string("voltage fell to %.1f V", volts)),
        (volts > SWELL_V, "Voltage Swell", "High", F.format_string("voltage rose to %.1f V", volts)),
        (thd > THD_LIMIT, "Harmonic Distortion Spike", "High", F.format_string("distortion of %.2f%% passes the limit", thd)),
        (light & (kwh > F.col("leak_threshold")), "Idle Energy Leak", "Medium",
         F.format_string("%.2f kWh at light load, expected at most %.2f kWh", kwh, F.col("leak_threshold"))),
        (F.contains("week_status", F.lit("Weekend")) & light & (kwh > F.col("mean_all") + 0.5 * F.col("std_all")),
         "Weekend Energy Leak", "High", F.format_string("%.2f kWh while closed for the weekend", kwh)),
        ((pf < IDLE_PF) & (kwh > IDLE_KWH), "Machinery Idling", "Medium",
         F.format_string("power factor of %.2f%% while drawing %.2f kWh", pf, kwh)),
    ]
    kind, sev, text = F.lit("Unspecified Outlier"), F.lit("Medium"), F.lit("unusual combination of readings")
    for cond, name, level, why in reversed(rules):
        kind, sev, text = (F.when(cond, v).otherwise(old) for v, old in ((name, kind), (level, sev), (why, text)))
    return rows.withColumns({"anomaly_type": kind, "severity": sev, "explanation": text}).drop(
        "mean_all", "std_all", "leak_threshold", "spike_threshold"
    )


def threshold_alerts(df: DataFrame, limits: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per (reading, broken limit); ``limits`` is a literal table.

    Where three phase currents are given, their imbalance is the largest deviation from
    their mean, as a share of the mean in percent.
    """
    if {"current_r", "current_y", "current_b"} <= set(df.columns):
        mean = (F.col("current_r") + F.col("current_y") + F.col("current_b")) / 3.0
        worst = F.greatest(*[F.abs(F.col(c) - mean) for c in ("current_r", "current_y", "current_b")])
        df = df.withColumn("phase_imbalance_pct", F.when(mean > 0, 100.0 * worst / mean))
    names = [c for c in ("transformer_temp_c", "power_factor", "phase_imbalance_pct") if c in df.columns]
    measures = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in names])
    long = df.select(*keep, F.explode(measures).alias("_m")).select(*keep, "_m.measure", "_m.value")
    broken = F.when(F.col("direction") == "above", F.col("value") > F.col("limit_value")).otherwise(
        F.col("value") < F.col("limit_value")
    )
    return long.join(limits, "measure").filter(broken).drop("direction")


# --- Fixed values: number patterns and intent words in messages -----------------------
MESSAGE_NUMBERS = {
    "load_kw": r"(\d+(?:\.\d+)?)\s*(?:kw|kilowatt|load)",
    "duration_h": r"(\d+)\s*(?:hour|hr|h|duration)",
    "solar_kw": r"(\d+(?:\.\d+)?)\s*(?:kw\s*solar|solar\s*capacity|solar)",
    "battery_kwh": r"(\d+(?:\.\d+)?)\s*(?:kwh\s*battery|battery|storage)",
}
MESSAGE_INTENTS = [
    ("anomaly", ("leak", "anomaly", "waste")),
    ("forecast", ("forecast", "tomorrow", "predict")),
    ("schedule", ("shift", "schedule", "optimize")),
    ("scenario", ("solar", "twin", "battery", "scenario")),
]
DEFAULT_INTENT = "compliance"
# --- End of fixed values ------------------------------------------------------------


def extract_params(messages: DataFrame, text="text") -> DataFrame:
    """Intent by the first matching word group, and the first number of each kind."""
    low = F.lower(F.col(text))
    intent = F.lit(DEFAULT_INTENT)
    for name, words in reversed(MESSAGE_INTENTS):
        hit = F.contains(low, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(low, F.lit(word))
        intent = F.when(hit, name).otherwise(intent)
    numbers = {
        name: F.regexp_extract(low, pattern, 1) for name, pattern in MESSAGE_NUMBERS.items()
    }
    return messages.withColumns(
        {"intent": intent} | {n: F.when(c != "", c.cast("double")) for n, c in numbers.items()}
    )
