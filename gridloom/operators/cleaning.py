"""Header alignment, validation, coercion, defaults, calendar columns and clipping."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.robust import median_and_mad
from gridloom.session import cut_lineage, stored

# --- Fixed values: source headers and accepted aliases (compared in lower case) --------
SOURCE_HEADERS = {
    "Usage_kWh": "usage_kwh",
    "Lagging_Current_Reactive.Power_kVarh": "reactive_lagging_kvarh",
    "Leading_Current_Reactive_Power_kVarh": "reactive_leading_kvarh",
    "CO2(tCO2)": "co2_tco2",
    "Lagging_Current_Power_Factor": "power_factor_lagging",
    "Leading_Current_Power_Factor": "power_factor_leading",
    "NSM": "nsm",
    "WeekStatus": "week_status",
    "Day_of_week": "day_of_week",
    "Load_Type": "load_type",
}
ALIASES = {
    "timestamp": "date",
    "time": "date",
    "usage": "usage_kwh",
    "kwh": "usage_kwh",
    "reactive_lagging": "reactive_lagging_kvarh",
    "reactive_leading": "reactive_leading_kvarh",
    "power_factor": "power_factor_lagging",
    "pf": "power_factor_lagging",
    "temp": "ambient_temperature_c",
    "temperature": "ambient_temperature_c",
}
DEFAULT_VALUES = {
    "usage_kwh": 100.0,
    "reactive_lagging_kvarh": 20.0,
    "reactive_leading_kvarh": 10.0,
    "power_factor_lagging": 90.0,
    "power_factor_leading": 95.0,
    "ambient_temperature_c": 28.0,
    "load_type": "Medium_Load",
    "week_status": "Weekday",
    "day_of_week": "Monday",
}
DAY_FIRST_PATTERNS = [
    "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm",
]
# --- End of fixed values ------------------------------------------------------------


def align_headers(df: DataFrame) -> DataFrame:
    """Rename known headers; two headers that map to one name are an error."""
    renames = {}
    for name in df.columns:
        target = SOURCE_HEADERS.get(name) or ALIASES.get(name.strip().lower()) or name
        renames[name] = target
    targets = list(renames.values())
    twice = sorted({t for t in targets if targets.count(t) > 1})
    if twice:
        raise ValueError(f"several headers map to {twice}")
    for required in ("date", "usage_kwh"):
        if required not in targets:
            raise ValueError(f"column {required} is missing")
    return df.select([F.col(f"`{old}`").alias(new) for old, new in renames.items()])


def parse_ts(col: Column, patterns: Sequence[str] = DAY_FIRST_PATTERNS) -> Column:
    """ISO text first, then the patterns, day before month; null when nothing fits."""
    return F.coalesce(col.try_cast("timestamp"), *[F.try_to_timestamp(col, F.lit(p)) for p in patterns])


def coerce_numeric(df: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Text that is no number, and null, become the default."""
    return df.withColumns(
        {c: F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(float(d))) for c, d in defaults.items()}
    )


def default_missing_columns(df: DataFrame, defaults: Mapping | None = None, fill_nulls=False) -> DataFrame:
    defaults = DEFAULT_VALUES if defaults is None else defaults
    new = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    if fill_nulls:
        new |= {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in df.columns}
    return df.withColumns(new) if new else df


def evolve_schema(df: DataFrame, columns: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Add columns an older table lacks; rows that predate a column read its default."""
    return df.withColumns(
        {
            c: (F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)).cast(kind)
            for c, (kind, default) in columns.items()
        }
    )


def validate_table(
    df: DataFrame, ts="timestamp", required=("timestamp", "usage_kwh"), min_rows=24, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per (key and) rule with ``ok`` and ``detail``; one pass over the table."""
    names = {c.strip().lower(): c for c in df.columns}
    missing = [c for c in required if c not in names]
    bad = F.lit(0).cast("bigint")
    if ts in names:
        text = F.col(f"`{names[ts]}`").cast("string")
        bad = F.count_if(F.col(f"`{names[ts]}`").isNotNull() & parse_ts(text).isNull())
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), bad.alias("bad_ts"))
    def rule(name, ok, measure):
        return F.struct(F.lit(name).alias("rule"), ok.alias("ok"), measure.cast("double").alias("measure"))

    rules = F.array(
        rule("required_columns", F.lit(not missing), F.lit(len(missing))),
        rule("enough_rows", F.col("n") >= min_rows, F.col("n")),
        rule("timestamps_parse", F.col("bad_ts") == 0, F.col("bad_ts")),
    )
    return stats.select(*keys, F.explode(rules).alias("r")).select(*keys, "r.rule", "r.ok", "r.measure")


RANGE_RULES = {
    "usage_kwh": (0.0, None),
    "reactive_lagging_kvarh": (0.0, None),
    "reactive_leading_kvarh": (0.0, None),
    "co2_tco2": (0.0, None),
    "power_factor_lagging": (0.0, 100.0),
    "power_factor_leading": (0.0, 100.0),
    "nsm": (0.0, None),
}


def validate_ranges(df: DataFrame, rules: Mapping | None = None) -> DataFrame:
    """Adds ``broken`` (names of the violated columns) and ``accepted``."""
    rules = RANGE_RULES if rules is None else rules
    marks = []
    for c, (lo, hi) in rules.items():
        if c not in df.columns:
            continue
        ok = F.lit(True)
        if lo is not None:
            ok = ok & (F.col(c) >= lo)
        if hi is not None:
            ok = ok & (F.col(c) <= hi)
        marks.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)))
    broken = F.array_compact(F.array(*marks))
    return df.withColumn("broken", broken).withColumn("accepted", F.size("broken") == 0)


def calendar_features(df: DataFrame, ts="ts") -> DataFrame:
    t = F.col(ts)
    return df.withColumns(
        {
            "nsm": F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t),
            "hour": F.hour(t),
            "weekday": F.weekday(t),
            "month": F.month(t),
            "is_weekend": (F.weekday(t) >= 5).cast("int"),
            "week_status": F.when(F.weekday(t) >= 5, "Weekend").otherwise("Weekday"),
            "day_of_week": F.date_format(t, "EEEE"),
        }
    )


def cyclic_hour(df: DataFrame, ts="ts", whole_hours=False) -> DataFrame:
    h = F.hour(ts).cast("double")
    if not whole_hours:
        h = h + F.minute(ts) / 60.0
    angle = F.lit(2 * math.pi) * h / 24.0
    return df.withColumn("hour_sin", F.sin(angle)).withColumn("hour_cos", F.cos(angle))


def clip(col: Column | str, lo=None, hi=None) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    out = col
    if hi is not None:
        out = F.least(out, F.lit(hi) if not isinstance(hi, Column) else hi)
    if lo is not None:
        out = F.greatest(out, F.lit(lo) if not isinstance(lo, Column) else lo)
    return F.when(col.isNotNull(), out)


def classify_load(df: DataFrame, keys: Sequence[str], col="usage_kwh") -> DataFrame:
    """Light / Medium / Maximum against half and one and a half times the key's mean.

    The mean is an aggregate, stored and joined back by its measured size, so no key is
    gathered in one task.
    """
    means = stored(df.groupBy(*keys).agg(F.avg(col).alias("_mean")), "means")
    kind = (
        F.when(F.col(col) < 0.5 * F.col("_mean"), "Light_Load")
        .when(F.col(col) > 1.5 * F.col("_mean"), "Maximum_Load")
        .otherwise("Medium_Load")
    )
    return df.join(means, list(keys)).withColumn("load_type", kind).drop("_mean")


def mean_impute(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    means = stored(df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols]), "means")
    filled = df.join(means, list(keys)).withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols})
    return filled.drop(*[f"_m_{c}" for c in cols])


def mad_clip(df: DataFrame, keys: Sequence[str], col: str, k=3.5) -> DataFrame:
    """Clip to median ± k times the raw median absolute deviation, where that is positive."""
    stats = median_and_mad(df, keys, [col]).select(
        *keys, F.col("median").alias("_med"), F.col("mad").alias("_mad")
    )
    reach = k * F.col("_mad")
    clipped = F.when(
        F.col("_mad") > 0, clip(F.col(col), F.col("_med") - reach, F.col("_med") + reach)
    ).otherwise(F.col(col))
    return df.join(stats, list(keys), "left").withColumn(col, clipped).drop("_med", "_mad")


def filter_events(df: DataFrame, severities=None, types=None, statuses=None, contains=None) -> DataFrame:
    """``contains``: (column, text), compared without case."""
    if severities:
        df = df.filter(F.col("severity").isin(*severities))
    if types:
        df = df.filter(F.col("anomaly_type").isin(*types))
    if statuses:
        df = df.filter(F.col("status").isin(*statuses))
    if contains:
        column, text = contains
        df = df.filter(F.contains(F.lower(F.col(column)), F.lit(text.lower())))
    return df


def apply_profile(df: DataFrame, profiles: DataFrame, tenant="tenant", ts="ts", default="steel") -> DataFrame:
    """Scale readings to their tenant's profile; unknown tenants take the default one."""
    names = profiles.select(F.col("tenant").alias("_known"))
    cfg = profiles.withColumnRenamed("tenant", "_profile")
    out = (
        df.join(names, F.col(tenant) == F.col("_known"), "left")
        .withColumn("_pick", F.coalesce("_known", F.lit(default)))
        .join(cfg, F.col("_pick") == F.col("_profile"))
    )
    angle = F.lit(2 * math.pi) * (F.hour(ts) + F.col("peak_hour") - 14) / 24.0
    new = {
        "usage_kwh": F.greatest(
            F.col("usage_kwh") * F.col("mult") * (1.0 + 0.12 * F.sin(angle)) + F.col("kwh_offset"), F.lit(1.0)
        )
    }
    for c in ("reactive_lagging_kvarh", "co2_tco2", "scope1_co2_kg", "scope2_co2_kg", "scope3_co2_kg"):
        if c in df.columns:
            new[c] = F.col(c) * F.col("mult")
    if "power_factor_lagging" in df.columns:
        new["power_factor_lagging"] = clip(
            F.col("power_factor_lagging") * (F.col("pf_base") / 0.865), 40.0, 99.9
        )
    return out.withColumns(new).drop(
        "_known", "_pick", "_profile", "mult", "pf_base", "peak_hour", "kwh_offset"
    )


def clean_series(df: DataFrame, keys: Sequence[str], ts="ts", col="usage_kwh", order=None) -> DataFrame:
    """Interpolate, clip outliers, add calendar and cyclic columns, default the power factor.

    The filled rows feed the medians and the clipping, so they are materialised once.
    """
    from gridloom.operators.windows import interpolate_linear

    order = list(order or [ts])
    out = cut_lineage(interpolate_linear(df, keys, order, col))
    out = mad_clip(out, keys, col)
    out = cyclic_hour(calendar_features(out, ts), ts, whole_hours=True)
    if "power_factor" in out.columns:
        return out.withColumn("power_factor", F.coalesce("power_factor", F.lit(0.88)))
    return out.withColumn("power_factor", F.lit(0.88))
