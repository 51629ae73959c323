"""Scans, sinks, cleaning and joins on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import dims
from gridloom.operators import cleaning as C
from gridloom.operators import joins as J
from gridloom.operators import ranking as G
from gridloom.operators.aggregates import table_profile
from gridloom.plans.registry import BANDS, CHECK_SQL, CURVE, FACTORS, PLANTS, PROFILES, READINGS, TARIFFS, USER_READINGS, query, rounded, scratch
from gridloom.sources import files
from gridloom.sources.tables import plants, readings, readings_by_user, table

KEYS, ORDER = ["meter_id"], ["ts", "reading_id"]

# --- scans and sinks --------------------------------------------------------------------


@query("scan_csv", f"""WITH {READINGS}
SELECT meter_id, count(*) AS n, round(sum(usage_kwh), 4) AS kwh, sum(reading_id) AS ids,
       CAST(0 AS BIGINT) AS corrupt FROM readings GROUP BY meter_id""")
def scan_csv(spark, sf_dir):
    path = scratch(spark, "readings") + ".csv"
    files.write_csv(readings(spark, sf_dir).select("meter_id", "reading_id", "usage_kwh"), path)
    df = files.scan_csv(spark, path, "meter_id string, reading_id bigint, usage_kwh double")
    return df.groupBy("meter_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("usage_kwh"), 4).alias("kwh"), F.sum("reading_id").alias("ids"),
        F.count("_corrupt_record").alias("corrupt"),
    )


@query("scan_readings", f"WITH {READINGS} SELECT meter_id, reading_id, ts, usage_kwh, reactive_lagging_kvarh FROM readings ORDER BY ts, reading_id")
def scan_readings(spark, sf_dir):
    return readings(spark, sf_dir).select(
        "meter_id", "reading_id", "ts", "usage_kwh", "reactive_lagging_kvarh"
    ).orderBy(*ORDER)


@query("recent_rows", f"""WITH {READINGS} SELECT meter_id, reading_id, ts, usage_kwh FROM readings
QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY ts DESC, reading_id DESC) <= 96""")
def recent_rows(spark, sf_dir):
    return G.recent_rows(readings(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh"), KEYS, ORDER, 96)


@query("recent_rows_fortnight", f"""WITH {READINGS} SELECT meter_id, reading_id, ts, usage_kwh FROM readings
QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY ts DESC, reading_id DESC) <= 1344""")
def recent_rows_fortnight(spark, sf_dir):
    return G.recent_rows(readings(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh"), KEYS, ORDER, 1344)


@query("recent_rows_overall", f"""WITH {READINGS} SELECT meter_id, reading_id, ts, usage_kwh FROM readings
ORDER BY ts DESC, reading_id DESC LIMIT 672""")
def recent_rows_overall(spark, sf_dir):
    df = readings(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh")
    return G.recent_rows_overall(df, ORDER, 672).orderBy(*ORDER)


@query("first_rows", f"""WITH {READINGS} SELECT meter_id, reading_id, ts, usage_kwh FROM readings
ORDER BY ts, reading_id LIMIT 15000""")
def first_rows(spark, sf_dir):
    return G.first_rows(readings(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh"), ORDER, 15000)


@query("table_profile", """SELECT * FROM (
SELECT 'event_id' AS column_name, 'bigint' AS column_type, count(event_id) AS non_null, count(*) AS row_count FROM events
UNION ALL SELECT 'ts', 'timestamp_ntz', count(ts), count(*) FROM events
UNION ALL SELECT 'user_id', 'bigint', count(user_id), count(*) FROM events
UNION ALL SELECT 'event_type', 'string', count(event_type), count(*) FROM events
UNION ALL SELECT 'value', 'double', count(value), count(*) FROM events
UNION ALL SELECT 'props', 'string', count(props), count(*) FROM events)""")
def profile(spark, sf_dir):
    return table_profile(table(spark, sf_dir, "events"))


@query("side_input_json", f"""WITH {READINGS}
SELECT date_trunc('second', ts) AS ts,
       CASE WHEN meter_id = 'signup' THEN 20.0 WHEN meter_id = 'click' THEN usage_kwh ELSE reactive_lagging_kvarh END AS temp,
       CASE WHEN meter_id IN ('click', 'error') THEN 0.3 ELSE round(usage_kwh / 500.0, 4) END AS cloud FROM readings""")
def side_input_json(spark, sf_dir):
    """Numbers for one meter, structs with missing fields for others."""
    return files.side_input_rows(_side_documents(spark, sf_dir), "doc")


@query("side_input_path", CHECK_SQL["side_input_json"])
def side_input_path(spark, sf_dir):
    """The same objects, written to files and read by path, line by line."""
    path = scratch(spark, "side-input")
    _side_documents(spark, sf_dir).write.text(path)
    return files.scan_side_input_json(spark, path)


def _side_documents(spark, sf_dir):
    r = readings(spark, sf_dir)
    key = F.concat(F.lit('{"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('": '))
    temp, cloud = F.col("reactive_lagging_kvarh").cast("string"), F.round(F.col("usage_kwh") / 500.0, 4)
    cloud = F.format_string("%.4f", cloud)
    value = (
        F.when(F.col("meter_id") == "click", F.col("usage_kwh").cast("string"))
        .when(F.col("meter_id") == "error", F.concat(F.lit('{"temp": '), temp, F.lit("}")))
        .when(F.col("meter_id") == "signup", F.concat(F.lit('{"cloud": '), cloud, F.lit("}")))
        .otherwise(F.concat(F.lit('{"temp": '), temp, F.lit(', "cloud": '), cloud, F.lit("}")))
    )
    return r.select(F.concat(key, value, F.lit("}")).alias("doc"))


@query("append_new", f"""WITH {READINGS}
SELECT meter_id, date_trunc('hour', ts) AS ts, reading_id, usage_kwh FROM readings
QUALIFY row_number() OVER (PARTITION BY meter_id, date_trunc('hour', ts) ORDER BY reading_id) = 1""")
def append_new(spark, sf_dir):
    """Two loads into one table; keys of the first load are ignored in the second."""
    path = scratch(spark, "telemetry")
    slots = readings(spark, sf_dir).select("meter_id", F.date_trunc("hour", "ts").alias("ts"), "reading_id", "usage_kwh")
    early = slots.filter("ts < timestamp '2024-01-10'")
    again = slots.withColumn("usage_kwh", F.when(F.col("ts") < "2024-01-10", -1.0).otherwise(F.col("usage_kwh")))
    files.append_new(early, path, ["meter_id", "ts"], "reading_id")
    files.append_new(again, path, ["meter_id", "ts"], "reading_id")
    return spark.read.parquet(path)


@query("replace_table", f"WITH {READINGS} SELECT meter_id, count(*) AS n, round(max(usage_kwh), 4) AS peak FROM readings GROUP BY meter_id")
def replace_table(spark, sf_dir):
    path, df = scratch(spark, "replaced"), readings(spark, sf_dir).select("meter_id", "usage_kwh")
    files.replace_table(df.filter("usage_kwh > 100"), path)
    files.truncate_table(spark, path)
    files.replace_table(df, path)
    return spark.read.parquet(path).groupBy("meter_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("usage_kwh"), 4).alias("peak")
    )


@query("write_json", f"WITH {READINGS} SELECT meter_id, count(*) AS n, round(sum(usage_kwh), 4) AS kwh FROM readings GROUP BY meter_id")
def write_json(spark, sf_dir):
    path = scratch(spark, "summary")
    df = readings(spark, sf_dir).groupBy("meter_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("usage_kwh"), 4).alias("kwh")
    )
    files.write_json(df, path)
    return spark.read.schema("meter_id string, n bigint, kwh double").json(path)


@query("write_day_partitioned", f"""WITH {READINGS}
SELECT CAST(ts AS DATE) AS day, meter_id, count(*) AS n, CAST(sum(CAST(usage_kwh AS DECIMAL(10,3))) AS DOUBLE) AS kwh
FROM readings GROUP BY ALL""")
def write_day_partitioned(spark, sf_dir):
    path = scratch(spark, "by-day")
    files.write_day_partitioned(readings(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("day", "meter_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("usage_kwh").cast("double").alias("kwh")
    )


@query("evolve_schema", f"""WITH {READINGS}
SELECT meter_id, reading_id, usage_kwh, CASE WHEN meter_id = 'click' THEN 0.0 ELSE reactive_lagging_kvarh END AS scope1_co2_kg,
       CAST(0.0 AS DOUBLE) AS scope2_co2_kg FROM readings""")
def evolve_schema(spark, sf_dir):
    """Two schema versions in one folder: the older files lack a column."""
    path, r = scratch(spark, "versions"), readings(spark, sf_dir)
    r.filter("meter_id = 'click'").select("meter_id", "reading_id", "usage_kwh").write.parquet(path)
    r.filter("meter_id <> 'click'").select(
        "meter_id", "reading_id", "usage_kwh", F.col("reactive_lagging_kvarh").alias("scope1_co2_kg")
    ).write.mode("append").parquet(path)
    return files.read_evolved(spark, path, {"scope1_co2_kg": ("double", 0.0), "scope2_co2_kg": ("double", 0.0)})


# --- projection, validation, cleaning ---------------------------------------------------


@query("align_headers", f"WITH {READINGS} SELECT meter_id, ts AS date, usage_kwh, reactive_lagging_kvarh, round(power_factor_lagging, 6) AS power_factor_lagging FROM readings")
def align_headers(spark, sf_dir):
    raw = readings(spark, sf_dir).select(
        "meter_id", F.col("ts").alias("Time"), F.col("usage_kwh").alias("kWh"),
        F.col("reactive_lagging_kvarh").alias("Lagging_Current_Reactive.Power_kVarh"),
        F.col("power_factor_lagging").alias("PF"),
    )
    return rounded(C.align_headers(raw), 6, "power_factor_lagging")


@query("validate_table", f"""WITH {READINGS}, s AS (SELECT meter_id, count(*) AS n,
  count(*) FILTER (WHERE usage_kwh < 1) AS bad FROM readings GROUP BY meter_id)
SELECT meter_id, 'required_columns' AS rule, true AS ok, 0.0::DOUBLE AS measure FROM s
UNION ALL SELECT meter_id, 'enough_rows', n >= 24, n::DOUBLE FROM s
UNION ALL SELECT meter_id, 'timestamps_parse', bad = 0, bad::DOUBLE FROM s""")
def validate_table(spark, sf_dir):
    text = F.when(F.col("usage_kwh") < 1, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = readings(spark, sf_dir).select("meter_id", text.alias(" Timestamp"), "usage_kwh")
    return C.validate_table(df, keys=KEYS)


@query("validate_ranges", f"""WITH {READINGS}, s AS (
  SELECT reading_id, usage_kwh - 5 AS u, power_factor_lagging + 3 AS pf FROM readings)
SELECT reading_id, (u >= 0 AND coalesce(pf >= 0 AND pf <= 100, false)) AS accepted,
       (CASE WHEN u >= 0 THEN 0 ELSE 1 END + CASE WHEN coalesce(pf >= 0 AND pf <= 100, false) THEN 0 ELSE 1 END) AS n_broken FROM s""")
def validate_ranges(spark, sf_dir):
    df = readings(spark, sf_dir).select(
        "reading_id", (F.col("usage_kwh") - 5).alias("usage_kwh"),
        (F.col("power_factor_lagging") + 3).alias("power_factor_lagging"),
    )
    return C.validate_ranges(df).select("reading_id", "accepted", F.size("broken").alias("n_broken"))


@query("coerce_numeric", """SELECT event_id AS reading_id, coalesce(TRY_CAST(props AS DOUBLE), 100.0) AS pf,
  coalesce(TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0.0) AS usage_kwh FROM events""")
def coerce_numeric(spark, sf_dir):
    usage = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("reading_id"), F.col("props").alias("pf"), usage.alias("usage_kwh"))
    return C.coerce_numeric(df, {"usage_kwh": 0.0, "pf": 100.0})


@query("parse_ts", """SELECT event_id AS reading_id,
 CASE event_type WHEN 'click' THEN date_trunc('minute', ts) WHEN 'error' THEN NULL WHEN 'signup' THEN date_trunc('day', ts)
      ELSE date_trunc('second', ts) END AS ts FROM events""")
def parse_ts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.col("ts").cast("timestamp")
    text = (
        F.when(F.col("event_type") == "click", F.date_format(t, "dd/MM/yyyy HH:mm"))
        .when(F.col("event_type") == "error", F.lit("not a time"))
        .when(F.col("event_type") == "signup", F.date_format(t, "yyyy-MM-dd"))
        .otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
    )
    return e.select(F.col("event_id").alias("reading_id"), C.parse_ts(text).alias("ts"))


@query("default_missing_columns", f"""WITH {READINGS} SELECT reading_id, usage_kwh,
  CASE WHEN meter_id = 'error' THEN 20.0 ELSE reactive_lagging_kvarh END AS reactive_lagging_kvarh,
  95.0::DOUBLE AS power_factor_leading, 'Medium_Load' AS load_type FROM readings""")
def default_missing_columns(spark, sf_dir):
    df = readings(spark, sf_dir).select(
        "reading_id", "usage_kwh",
        F.when(F.col("meter_id") != "error", F.col("reactive_lagging_kvarh")).alias("reactive_lagging_kvarh"),
    )
    wanted = {k: C.DEFAULT_VALUES[k] for k in ("reactive_lagging_kvarh", "power_factor_leading", "load_type")}
    return C.default_missing_columns(df, wanted, fill_nulls=True)


@query("calendar_features", """SELECT event_id AS reading_id,
  CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS nsm, CAST(hour(ts) AS INTEGER) AS hour,
  CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(month(ts) AS INTEGER) AS month,
  CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
  CASE WHEN isodow(ts) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS week_status, strftime(ts, '%A') AS day_of_week FROM events""")
def calendar_features(spark, sf_dir):
    return C.calendar_features(readings(spark, sf_dir).select("reading_id", "ts")).drop("ts")


@query("cyclic_hour", """SELECT event_id AS reading_id, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24), 6) AS hour_sin,
  round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24), 6) AS hour_cos FROM events""")
def cyclic_hour(spark, sf_dir):
    return rounded(C.cyclic_hour(readings(spark, sf_dir).select("reading_id", "ts")), 6, "hour_sin", "hour_cos").drop("ts")


@query("classify_load", f"""WITH {READINGS}, m AS (SELECT meter_id, avg(usage_kwh) AS mu FROM readings GROUP BY meter_id)
SELECT reading_id, CASE WHEN usage_kwh < 0.5 * mu THEN 'Light_Load' WHEN usage_kwh > 1.5 * mu THEN 'Maximum_Load' ELSE 'Medium_Load' END AS load_type
FROM readings JOIN m USING (meter_id)""")
def classify_load(spark, sf_dir):
    df = readings(spark, sf_dir).select("meter_id", "reading_id", "usage_kwh")
    return C.classify_load(df, KEYS).select("reading_id", "load_type")


@query("clip_usage", "SELECT event_id AS reading_id, greatest(10.0, least(100.0, value)) AS usage_kwh FROM events")
def clip_usage(spark, sf_dir):
    return readings(spark, sf_dir).select("reading_id", C.clip("usage_kwh", 10.0, 100.0).alias("usage_kwh"))


@query("mean_impute", f"""WITH {USER_READINGS},
g AS (SELECT meter_id, reading_id, CASE WHEN usage_kwh >= 5 THEN usage_kwh END AS u FROM readings),
m AS (SELECT meter_id, avg(u) AS mu FROM g GROUP BY meter_id)
SELECT meter_id, reading_id, round(coalesce(u, mu), 6) AS usage_kwh FROM g JOIN m USING (meter_id)""")
def mean_impute(spark, sf_dir):
    df = readings_by_user(spark, sf_dir).select(
        "meter_id", "reading_id", F.when(F.col("usage_kwh") >= 5, F.col("usage_kwh")).alias("usage_kwh")
    )
    return rounded(C.mean_impute(df, KEYS, ["usage_kwh"]), 6, "usage_kwh")


MAD_CLIP = """med AS (SELECT meter_id, median(usage_kwh) AS med FROM {src} GROUP BY meter_id),
dev AS (SELECT meter_id, median(abs(usage_kwh - med)) AS mad, any_value(med) AS med FROM {src} JOIN med USING (meter_id) GROUP BY meter_id)"""


@query("mad_clip", f"""WITH {READINGS}, {MAD_CLIP.format(src='readings')}
SELECT reading_id, round(CASE WHEN mad > 0 THEN greatest(med - 3.5 * mad, least(med + 3.5 * mad, usage_kwh)) ELSE usage_kwh END, 6) AS usage_kwh
FROM readings JOIN dev USING (meter_id)""")
def mad_clip(spark, sf_dir):
    df = readings(spark, sf_dir).select("meter_id", "reading_id", "usage_kwh")
    return rounded(C.mad_clip(df, KEYS, "usage_kwh"), 6, "usage_kwh").drop("meter_id")


@query("filter_events", """SELECT event_id, severity, status FROM (
 SELECT event_id, CASE WHEN value > 100 THEN 'Critical' WHEN value > 50 THEN 'High' ELSE 'Low' END AS severity,
        CASE WHEN event_type = 'error' THEN 'CLOSED' ELSE 'TRIGGERED' END AS status, event_type FROM events)
WHERE severity IN ('Critical', 'High') AND status = 'TRIGGERED' AND event_type LIKE '%ur%'""")
def filter_events(spark, sf_dir):
    severity = F.when(F.col("value") > 100, "Critical").when(F.col("value") > 50, "High").otherwise("Low")
    status = F.when(F.col("event_type") == "error", "CLOSED").otherwise("TRIGGERED")
    df = table(spark, sf_dir, "events").select("event_id", severity.alias("severity"), status.alias("status"), F.upper("event_type").alias("kind"))
    out = C.filter_events(df, severities=["Critical", "High"], statuses=["TRIGGERED"], contains=("kind", "Ur"))
    return out.select("event_id", "severity", "status")


TENANT_CASE = "CASE meter_id WHEN 'click' THEN 'textile' WHEN 'error' THEN 'rice' WHEN 'purchase' THEN 'auto' WHEN 'signup' THEN 'chemical' ELSE 'unlisted' END"


def tenant_of(meter):
    return (
        F.when(meter == "click", "textile").when(meter == "error", "rice").when(meter == "purchase", "auto")
        .when(meter == "signup", "chemical").otherwise("unlisted")
    )


@query("apply_profile", f"""WITH {READINGS}, {PROFILES},
t AS (SELECT *, {TENANT_CASE} AS tenant FROM readings),
p AS (SELECT t.*, coalesce(a.mult, d.mult) AS mult, coalesce(a.pf_base, d.pf_base) AS pf_base,
             coalesce(a.peak_hour, d.peak_hour) AS peak_hour, coalesce(a.kwh_offset, d.kwh_offset) AS kwh_offset
      FROM t LEFT JOIN profiles a ON t.tenant = a.tenant CROSS JOIN (SELECT * FROM profiles WHERE tenant = 'steel') d)
SELECT reading_id, tenant,
 round(greatest(usage_kwh * mult * (1 + 0.12 * sin(2 * pi() * (hour(ts) + peak_hour - 14) / 24)) + kwh_offset, 1), 4) AS usage_kwh,
 round(reactive_lagging_kvarh * mult, 4) AS reactive_lagging_kvarh,
 round(greatest(40, least(99.9, power_factor_lagging * (pf_base / 0.865))), 4) AS power_factor_lagging FROM p""")
def apply_profile(spark, sf_dir):
    df = readings(spark, sf_dir).withColumn("tenant", tenant_of(F.col("meter_id")))
    out = C.apply_profile(df, dims.tenant_profiles(spark))
    cols = ("usage_kwh", "reactive_lagging_kvarh", "power_factor_lagging")
    return rounded(out, 4, *cols).select("reading_id", "tenant", *cols)


INTERPOLATED = """gaps AS (
  SELECT meter_id, reading_id, ts, CASE WHEN usage_kwh >= 10 THEN usage_kwh END AS u,
         row_number() OVER (PARTITION BY meter_id ORDER BY ts, reading_id) AS pos FROM readings),
near AS (
  SELECT *, last_value(CASE WHEN u IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp, last_value(u IGNORE NULLS) OVER b AS pu,
         first_value(CASE WHEN u IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS np, first_value(u IGNORE NULLS) OVER a AS nu
  FROM gaps WINDOW b AS (PARTITION BY meter_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   a AS (PARTITION BY meter_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
interpolated AS (
  SELECT meter_id, reading_id, ts, CASE WHEN u IS NOT NULL THEN u WHEN pp IS NULL THEN nu WHEN np IS NULL THEN pu
         ELSE pu + (nu - pu) / (np - pp) * (pos - pp) END AS usage_kwh FROM near)"""


@query("clean_series", f"""WITH {READINGS}, {INTERPOLATED}, {MAD_CLIP.format(src='interpolated')}
SELECT reading_id, round(CASE WHEN mad > 0 THEN greatest(med - 3.5 * mad, least(med + 3.5 * mad, usage_kwh)) ELSE usage_kwh END, 6) AS usage_kwh,
  CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
  round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, 0.88::DOUBLE AS power_factor
FROM interpolated JOIN dev USING (meter_id)""")
def clean_series(spark, sf_dir):
    df = readings(spark, sf_dir).select(
        "meter_id", "reading_id", "ts", F.when(F.col("usage_kwh") >= 10, F.col("usage_kwh")).alias("usage_kwh")
    )
    out = C.clean_series(df, KEYS, order=ORDER)
    return rounded(out, 6, "usage_kwh", "hour_sin", "hour_cos").select(
        "reading_id", "usage_kwh", "hour", "weekday", "hour_sin", "hour_cos", "power_factor"
    )


# --- joins --------------------------------------------------------------------------------


@query("join_hour_curve", f"""WITH {READINGS}, {CURVE} SELECT reading_id, tariff, carbon_g, solar_factor,
  round(usage_kwh * tariff, 6) AS cost FROM readings JOIN curve ON hour(ts) = curve.hour""")
def join_hour_curve(spark, sf_dir):
    out = J.join_hour_curve(readings(spark, sf_dir), dims.hour_curve(spark))
    return out.select("reading_id", "tariff", "carbon_g", "solar_factor", F.round(F.col("usage_kwh") * F.col("tariff"), 6).alias("cost"))


UTILITY_CASE = "CASE meter_id WHEN 'click' THEN 'MSEDCL' WHEN 'error' THEN 'UGVCL' WHEN 'purchase' THEN 'BESCOM' ELSE 'TANGEDCO' END"


def utility_of(meter):
    return F.when(meter == "click", "MSEDCL").when(meter == "error", "UGVCL").when(meter == "purchase", "BESCOM").otherwise("TANGEDCO")


@query("join_tod_bands", f"""WITH {READINGS}, {BANDS}, {TARIFFS}, r AS (SELECT *, {UTILITY_CASE} AS utility FROM readings)
SELECT reading_id, r.utility, coalesce(band, 'normal') AS band,
  round(base_rate + CASE band WHEN 'peak' THEN peak_surcharge WHEN 'offpeak' THEN -offpeak_rebate ELSE 0 END, 6) AS rate
FROM r JOIN tariffs ON r.utility = tariffs.utility
LEFT JOIN bands ON r.utility = bands.utility AND CASE WHEN end_hour > start_hour THEN hour(ts) >= start_hour AND hour(ts) < end_hour
  ELSE hour(ts) >= start_hour OR hour(ts) < end_hour END""")
def join_tod_bands(spark, sf_dir):
    df = readings(spark, sf_dir).select("reading_id", "ts", utility_of(F.col("meter_id")).alias("utility"))
    out = J.join_tod_bands(df, dims.tariff_bands(spark), dims.utility_tariffs(spark))
    return rounded(out, 6, "rate").select("reading_id", "utility", "band", "rate")


@query("join_dim_default", f"""WITH {PLANTS}, {FACTORS} SELECT plant_id, year, region, coalesce(grid_factor, 0.73) AS grid_factor
FROM plants LEFT JOIN factors USING (region)""")
def join_dim_default(spark, sf_dir):
    df = plants(spark, sf_dir).select("plant_id", "year", "region")
    return J.join_dim(df, dims.grid_factors(spark), "region", {"grid_factor": dims.NATIONAL_GRID_FACTOR})


@query("join_weather", """SELECT a.event_id AS reading_id, coalesce(b.temp, 20.0) AS temp, coalesce(b.cloud, 0.3) AS cloud
FROM events a LEFT JOIN (SELECT event_type, ts, round(value / 10, 4) AS temp,
  CASE WHEN value < 50 THEN round(value / 50, 4) END AS cloud FROM events WHERE event_type IN ('click', 'purchase', 'view')) b
USING (event_type, ts)""")
def join_weather(spark, sf_dir):
    r = readings(spark, sf_dir)
    weather = r.filter(F.col("meter_id").isin("click", "purchase", "view")).select(
        "meter_id", "ts", F.round(F.col("usage_kwh") / 10, 4).alias("temp"),
        F.when(F.col("usage_kwh") < 50, F.round(F.col("usage_kwh") / 50, 4)).alias("cloud"),
    )
    return J.join_weather(r.select("meter_id", "reading_id", "ts"), weather, on=["meter_id"]).select("reading_id", "temp", "cloud")


@query("flag_members", """SELECT event_id, date_trunc('hour', ts) IN (SELECT date_trunc('hour', ts) FROM events WHERE value > 200) AS flagged FROM events""")
def flag_members(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour_ts"))
    return J.flag_members(df, df.filter("value > 200"), ["hour_ts"]).select("event_id", "flagged")


@query("fan_out", f"""WITH {PLANTS} SELECT sector, solar_kw, shift_pct, count(*) AS n, round(sum(annual_kwh * shift_pct / 100), 2) AS shifted
FROM plants CROSS JOIN (VALUES (0.0), (150.0), (300.0)) s(solar_kw) CROSS JOIN (VALUES (10.0), (20.0)) p(shift_pct) GROUP BY ALL""")
def fan_out(spark, sf_dir):
    df = J.fan_out(plants(spark, sf_dir).select("sector", "annual_kwh"), {"solar_kw": [0.0, 150.0, 300.0], "shift_pct": [10.0, 20.0]})
    return df.groupBy("sector", "solar_kw", "shift_pct").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("annual_kwh") * F.col("shift_pct") / 100), 2).alias("shifted")
    )


@query("site_factor_join", f"""WITH {PLANTS}, {FACTORS} SELECT region, count(*) AS n, round(sum(annual_kwh * coalesce(grid_factor, 0.73)) / 1000, 2) AS scope2_t
FROM plants LEFT JOIN factors USING (region) GROUP BY region""")
def site_factor_join(spark, sf_dir):
    out = J.site_factor_join(plants(spark, sf_dir), dims.grid_factors(spark))
    return out.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("annual_kwh") * F.col("grid_factor")) / 1000, 2).alias("scope2_t")
    )


@query("state_factor_join", f"""WITH {PLANTS}, states(i, state, grid_factor) AS (VALUES (0, 'Maharashtra', 0.82), (1, 'Gujarat', 0.81),
  (2, 'Karnataka', 0.64), (3, 'Tamil Nadu', 0.67), (4, 'Telangana', 0.76), (5, 'Odisha', 0.91), (6, 'West Bengal', 0.88), (7, 'Rajasthan', 0.78)),
p AS (SELECT *, CASE WHEN plant_id % 9 = 8 THEN 'Elsewhere' ELSE state END AS place FROM plants LEFT JOIN states ON i = plant_id % 9)
SELECT place AS state, count(*) AS n, round(sum(annual_kwh * coalesce(grid_factor, 0.73)::DOUBLE) / 1000, 2) AS scope2_t FROM p GROUP BY place""")
def state_factor_join(spark, sf_dir):
    """Grid factors by state, the default one elsewhere."""
    names = ["Maharashtra", "Gujarat", "Karnataka", "Tamil Nadu", "Telangana", "Odisha", "West Bengal", "Rajasthan", "Elsewhere"]
    state = F.element_at(F.array(*map(F.lit, names)), (F.col("plant_id") % 9 + 1).cast("int"))
    out = J.site_factor_join(plants(spark, sf_dir).withColumn("state", state), dims.state_grid_factors(spark), "state")
    return out.groupBy("state").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("annual_kwh") * F.col("grid_factor")) / 1000, 2).alias("scope2_t")
    )
