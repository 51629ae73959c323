"""Fixed dimension values and the small DataFrames built from them.

Each builder returns a literal table of at most a few hundred rows whose size does not
depend on the data, so joins may broadcast it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values -------------------------------------------------------------------
# Time-of-use tariff per kWh and grid carbon (g/kWh) by clock hour, as inclusive ranges.
TARIFF_RANGES = [(0, 8, 0.06), (9, 9, 0.12), (10, 15, 0.18), (16, 21, 0.12), (22, 23, 0.06)]
CARBON_RANGES = [(0, 8, 400.0), (9, 9, 320.0), (10, 15, 250.0), (16, 17, 320.0), (18, 21, 450.0), (22, 23, 400.0)]
# Clear-sky solar factor for hours 0..23.
SOLAR_FACTOR = [
    0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.05, 0.2, 0.5, 0.8, 1.0, 1.2,
    1.2, 1.0, 0.8, 0.5, 0.2, 0.05, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
]

# tenant, usage multiplier, base power factor, peak hour, kWh offset; first row = default
TENANT_PROFILES = [
    ("steel", 1.0, 0.865, 14, 0.0),
    ("textile", 0.68, 0.920, 11, 5.0),
    ("rice", 0.50, 0.895, 16, -2.0),
    ("auto", 1.68, 0.840, 10, 12.0),
    ("chemical", 1.12, 0.910, 13, 3.0),
]

# utility, base/kWh, peak surcharge, off-peak rebate, demand/kVA, penalty % per 0.01, max incentive %
UTILITY_TARIFFS = [
    ("MSEDCL", 8.50, 1.50, 1.00, 475.0, 1.5, 7.0),
    ("UGVCL", 7.80, 1.25, 0.85, 425.0, 2.0, 5.0),
    ("BESCOM", 8.20, 1.20, 0.80, 450.0, 1.75, 6.0),
    ("TANGEDCO", 7.90, 1.35, 0.75, 440.0, 2.0, 5.5),
]
# utility, band, first hour, end hour (exclusive; an end before the start wraps past midnight)
TARIFF_BANDS = [
    ("MSEDCL", "peak", 9, 12), ("MSEDCL", "peak", 18, 22), ("MSEDCL", "offpeak", 22, 6),
    ("UGVCL", "peak", 7, 11), ("UGVCL", "peak", 18, 22), ("UGVCL", "offpeak", 22, 6),
    ("BESCOM", "peak", 6, 10), ("BESCOM", "peak", 18, 22), ("BESCOM", "offpeak", 22, 6),
    ("TANGEDCO", "peak", 6, 9), ("TANGEDCO", "peak", 18, 21), ("TANGEDCO", "offpeak", 22, 5),
]

# sector, baseline, target, unit; first row = default
SECTOR_NORMS = [
    ("Steel", 0.635, 0.585, "TOE/ton"),
    ("Cement", 76.2, 68.5, "kWh/ton"),
    ("Textile", 16.8, 14.2, "MJ/kg"),
]
KWH_PER_TOE = 11630.0
CERTIFICATE_PRICE = 1840.0
PENALTY_PER_TOE = 10000.0

# region, kg CO2 per kWh
GRID_FACTORS = [
    ("Northern", 0.71), ("Western", 0.79), ("Southern", 0.68),
    ("Eastern", 0.85), ("North-Eastern", 0.62),
]
NATIONAL_GRID_FACTOR = 0.73
STATE_GRID_FACTORS = [
    ("Maharashtra", 0.82), ("Gujarat", 0.81), ("Karnataka", 0.64), ("Tamil Nadu", 0.67),
    ("Telangana", 0.76), ("Odisha", 0.91), ("West Bengal", 0.88), ("Rajasthan", 0.78),
]

# chemistry, calendar coefficient, cycle coefficient, depth exponent, cycle exponent, activation J/mol
BATTERY_CHEMISTRIES = [
    ("LFP", 0.012, 0.00018, 1.15, 0.85, 28000.0),
    ("NMC", 0.022, 0.00035, 1.30, 0.90, 35000.0),
]

# alert type, measured column, limit, comparison, severity
ALERT_LIMITS = [
    ("Thermal Overload", "transformer_temp_c", 85.0, "above", "CRITICAL"),
    ("Power Factor Drop", "power_factor", 0.90, "below", "HIGH"),
    ("Phase Imbalance", "phase_imbalance_pct", 5.0, "above", "MEDIUM"),
]
SEVERITY_RANK = [("CRITICAL", 3), ("HIGH", 2), ("MEDIUM", 1), ("LOW", 0)]

# year of service, share of capital written off
TAX_DEPRECIATION = [(1, 0.20), (2, 0.32), (3, 0.192), (4, 0.1152), (5, 0.1152), (6, 0.0576)]
# --- End of fixed values ------------------------------------------------------------


def _range_value(ranges, hour):
    for lo, hi, value in ranges:
        if lo <= hour <= hi:
            return value
    raise ValueError(hour)


def _fixed(spark, rows, schema: str) -> DataFrame:
    """A literal table; joins may broadcast it, since its size is that of this module's text."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def hour_curve(spark: SparkSession) -> DataFrame:
    rows = [
        (h, _range_value(TARIFF_RANGES, h), _range_value(CARBON_RANGES, h), SOLAR_FACTOR[h])
        for h in range(24)
    ]
    return _fixed(spark, rows, "hour int, tariff double, carbon_g double, solar_factor double")


def tenant_profiles(spark):
    return _fixed(spark, 
        TENANT_PROFILES, "tenant string, mult double, pf_base double, peak_hour int, kwh_offset double"
    )


def utility_tariffs(spark):
    return _fixed(spark, 
        UTILITY_TARIFFS,
        "utility string, base_rate double, peak_surcharge double, offpeak_rebate double, "
        "demand_rate double, pf_penalty_pct double, max_incentive_pct double",
    )


def tariff_bands(spark):
    return _fixed(spark, TARIFF_BANDS, "utility string, band string, start_hour int, end_hour int")


def band_hours(bands: DataFrame) -> DataFrame:
    """(utility, hour, band): bands unrolled to clock hours, wrapping past midnight."""
    last = F.when(F.col("end_hour") > F.col("start_hour"), F.col("end_hour")).otherwise(F.col("end_hour") + 24) - 1
    return bands.select(
        "utility", "band", F.explode(F.sequence(F.col("start_hour"), last)).alias("_h")
    ).select("utility", "band", (F.col("_h") % 24).alias("hour"))


def sector_norms(spark):
    return _fixed(spark, SECTOR_NORMS, "sector string, baseline_sec double, target_sec double, sec_unit string")


def grid_factors(spark):
    return _fixed(spark, GRID_FACTORS, "region string, grid_factor double")


def state_grid_factors(spark):
    return _fixed(spark, STATE_GRID_FACTORS, "state string, grid_factor double")


def battery_chemistries(spark):
    return _fixed(spark, 
        BATTERY_CHEMISTRIES,
        "chemistry string, b_cal double, b_cyc double, dod_exp double, cycle_exp double, activation double",
    )


def alert_limits(spark):
    return _fixed(spark, 
        ALERT_LIMITS, "alert_type string, measure string, limit_value double, direction string, severity string"
    )


def tax_depreciation(spark):
    return _fixed(spark, TAX_DEPRECIATION, "year int, write_off double")


def sql_values(rows) -> str:
    """The same literals as a VALUES list, for checking queries in another engine."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
