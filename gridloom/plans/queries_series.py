"""Aggregates, windows, recurrences, ranking and set operations on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import dims
from gridloom.operators import aggregates as A
from gridloom.operators import emissions as E
from gridloom.operators import ranking as G
from gridloom.operators import recurrences as R
from gridloom.operators import windows as W
from gridloom.plans.pipelines import hourly_load_cost_emissions
from gridloom.plans.queries_base import KEYS, ORDER
from gridloom.plans.registry import CURVE, HOURLY, READINGS, SPINE, USER_READINGS, query, rounded
from gridloom.sources.tables import detections, readings, readings_by_user, table

# --- aggregates ---------------------------------------------------------------------------


@query("hourly_load_cost_emissions", f"""WITH {READINGS}, {CURVE},
h AS (SELECT meter_id, date_trunc('hour', ts) AS ts, avg(usage_kwh) AS usage_kwh, avg(usage_kwh * tariff) AS cost,
        avg(usage_kwh * (carbon_g / 1000)) AS s2, avg(usage_kwh * 0.22 + 5.0 * (hour(ts) * 3600 / 86400)) AS s3
      FROM readings JOIN curve ON hour(ts) = curve.hour GROUP BY ALL),
spine AS (SELECT meter_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY meter_id)
SELECT meter_id, ts, round(last_value(usage_kwh IGNORE NULLS) OVER w, 6) AS usage_kwh, round(last_value(cost IGNORE NULLS) OVER w, 6) AS cost,
  round(last_value(s2 IGNORE NULLS) OVER w, 6) AS scope2_co2_kg, round(last_value(s3 IGNORE NULLS) OVER w, 6) AS scope3_co2_kg
FROM spine LEFT JOIN h USING (meter_id, ts)
WINDOW w AS (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def hourly(spark, sf_dir):
    out = hourly_load_cost_emissions(readings(spark, sf_dir))
    return rounded(out, 6, "usage_kwh", "cost", "scope2_co2_kg", "scope3_co2_kg")


@query("resample_hourly", f"""WITH {READINGS} SELECT meter_id, date_trunc('hour', ts) AS ts, round(avg(usage_kwh), 6) AS usage_kwh,
  round(avg(reactive_lagging_kvarh), 6) AS reactive_lagging_kvarh FROM readings GROUP BY ALL""")
def resample_hourly(spark, sf_dir):
    cols = ("usage_kwh", "reactive_lagging_kvarh")
    return rounded(A.resample(readings(spark, sf_dir), KEYS, cols=cols), 6, *cols)


@query("resample_filled", f"WITH {READINGS}, {HOURLY}, {SPINE} SELECT meter_id, ts, round(usage_kwh, 6) AS usage_kwh FROM filled")
def resample_filled(spark, sf_dir):
    return rounded(A.resample_filled(readings(spark, sf_dir), KEYS), 6, "usage_kwh")


@query("hour_profile", f"""WITH {READINGS} SELECT meter_id, CAST(hour(ts) AS INTEGER) AS hour, round(avg(usage_kwh), 6) AS usage_kwh,
  round(avg(reactive_lagging_kvarh), 6) AS reactive_lagging_kvarh FROM readings GROUP BY ALL""")
def hour_profile(spark, sf_dir):
    cols = ("usage_kwh", "reactive_lagging_kvarh")
    return rounded(A.hour_profile(readings(spark, sf_dir), KEYS, cols=cols), 6, *cols)


@query("monthly_peak_reduction", """WITH d AS (SELECT l_suppkey, date_trunc('month', l_shipdate) AS m,
  max(l_quantity) * 4.0 AS a, max(l_quantity * (1 - l_discount)) * 4.0 AS b FROM lineitem GROUP BY ALL)
SELECT l_suppkey AS meter_id, round(avg(greatest(0, a - b)), 6) AS peak_reduction_kw, count(*) AS months FROM d GROUP BY l_suppkey""")
def monthly_peak_reduction(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("meter_id"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("original_load"),
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("grid_draw"),
    )
    return rounded(A.monthly_peak_reduction(df, KEYS), 6, "peak_reduction_kw")


@query("recent_summary", f"""WITH {READINGS}, l AS (SELECT * FROM readings
  QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY ts DESC, reading_id DESC) <= 96),
t AS (SELECT meter_id, count(*) AS total_rows FROM readings GROUP BY meter_id)
SELECT meter_id, round(avg(usage_kwh), 6) AS avg_load, max(usage_kwh) AS peak_load,
  min(ts) FILTER (WHERE usage_kwh = mx) AS peak_time, any_value(total_rows) AS total_rows
FROM (SELECT *, max(usage_kwh) OVER (PARTITION BY meter_id) AS mx FROM l) JOIN t USING (meter_id) GROUP BY meter_id""")
def recent_summary(spark, sf_dir):
    return rounded(A.recent_summary(readings(spark, sf_dir), KEYS, order=ORDER, n=96), 6, "avg_load")


SEVERITY_SQL = "CASE WHEN value > 250 THEN 'Critical' WHEN value > 150 THEN 'High' WHEN value > 100 THEN 'Medium' ELSE 'Low' END"


def severity_of(col):
    return F.when(col > 250, "Critical").when(col > 150, "High").when(col > 100, "Medium").otherwise("Low")


@query("severity_breakdown", f"""SELECT event_type AS meter_id, count(*) AS total, count(*) FILTER (WHERE s = 'Critical') AS critical,
  count(*) FILTER (WHERE s = 'High') AS high, count(*) FILTER (WHERE s = 'Medium') AS medium, count(*) FILTER (WHERE s = 'Low') AS low
FROM (SELECT event_type, {SEVERITY_SQL} AS s FROM events) GROUP BY event_type""")
def severity_breakdown(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("event_type").alias("meter_id"), severity_of(F.col("value")).alias("severity"))
    return A.severity_breakdown(df, KEYS)


@query("health_score", f"""SELECT CAST(user_id AS VARCHAR) AS meter_id, greatest(0, 100 - 10 * count(*) FILTER (WHERE s = 'Critical') - 5 * count(*) FILTER (WHERE s = 'High')) AS health_score
FROM (SELECT user_id, {SEVERITY_SQL} AS s FROM events) GROUP BY user_id""")
def health_score(spark, sf_dir):
    df = readings_by_user(spark, sf_dir).select("meter_id", severity_of(F.col("usage_kwh")).alias("severity"))
    return A.health_score(A.severity_breakdown(df, KEYS)).select("meter_id", "health_score")


ROBUST_SQL = """l AS (SELECT meter_id, 'usage_kwh' AS feature, usage_kwh AS v FROM readings
  UNION ALL SELECT meter_id, 'reactive_lagging_kvarh', reactive_lagging_kvarh FROM readings
  UNION ALL SELECT meter_id, 'power_factor_lagging', power_factor_lagging FROM readings WHERE power_factor_lagging IS NOT NULL),
m AS (SELECT meter_id, feature, count(*) AS n, median(v) AS med FROM l GROUP BY ALL),
rs AS (SELECT meter_id, feature, any_value(n) AS n, any_value(med) AS med, median(abs(v - med)) AS mad FROM l JOIN m USING (meter_id, feature) GROUP BY ALL)"""
ROBUST_COLS = ["usage_kwh", "reactive_lagging_kvarh", "power_factor_lagging"]


@query("robust_stats", f"WITH {READINGS}, {ROBUST_SQL} SELECT meter_id, feature, n, round(med, 6) AS median, round(mad, 6) AS mad FROM rs")
def robust_stats(spark, sf_dir):
    return rounded(A.robust_stats(readings(spark, sf_dir), KEYS, ROBUST_COLS), 6, "median", "mad")


@query("robust_stats_many_keys", f"WITH {USER_READINGS}, {ROBUST_SQL} SELECT meter_id, feature, n, round(med, 6) AS median, round(mad, 6) AS mad FROM rs")
def robust_stats_many(spark, sf_dir):
    return rounded(A.robust_stats(readings_by_user(spark, sf_dir), KEYS, ROBUST_COLS), 6, "median", "mad")


@query("outlier_rate", f"""WITH {READINGS}, {ROBUST_SQL},
f AS (SELECT reading_id, meter_id, max(CASE WHEN mad > 1e-5 AND abs(0.6745 * (v - med) / mad) > 3 THEN 1 ELSE 0 END) AS o FROM (
  SELECT reading_id, meter_id, 'usage_kwh' AS feature, usage_kwh AS v FROM readings
  UNION ALL SELECT reading_id, meter_id, 'reactive_lagging_kvarh', reactive_lagging_kvarh FROM readings
  UNION ALL SELECT reading_id, meter_id, 'power_factor_lagging', power_factor_lagging FROM readings) JOIN rs USING (meter_id, feature) GROUP BY ALL)
SELECT meter_id, round(avg(o), 6) AS raw_rate, round(greatest(0.005, least(0.04, avg(o))), 6) AS rate FROM f GROUP BY meter_id""")
def outlier_rate(spark, sf_dir):
    return rounded(A.outlier_rate(readings(spark, sf_dir), KEYS, ROBUST_COLS), 6, "raw_rate", "rate")


LOAD_TYPED = """mu AS (SELECT meter_id, avg(usage_kwh) AS mu FROM readings GROUP BY meter_id),
typed AS (SELECT readings.*, CASE WHEN usage_kwh < 0.5 * mu THEN 'Light_Load' WHEN usage_kwh > 1.5 * mu THEN 'Maximum_Load' ELSE 'Medium_Load' END AS load_type
          FROM readings JOIN mu USING (meter_id)),
thr AS (SELECT meter_id, avg(usage_kwh) AS mean_all, stddev_samp(usage_kwh) AS std_all,
  CASE WHEN count(*) FILTER (WHERE load_type = 'Light_Load') = 0 THEN 9.0
       ELSE avg(usage_kwh) FILTER (WHERE load_type = 'Light_Load') + 2 * stddev_samp(usage_kwh) FILTER (WHERE load_type = 'Light_Load') END AS leak_threshold,
  avg(usage_kwh) + 3 * stddev_samp(usage_kwh) AS spike_threshold FROM typed GROUP BY meter_id)"""


def typed(spark, sf_dir):
    from gridloom.operators.cleaning import classify_load

    return classify_load(readings(spark, sf_dir), KEYS)


@query("baseline_thresholds", f"""WITH {READINGS}, {LOAD_TYPED} SELECT meter_id, round(mean_all, 6) AS mean_all, round(std_all, 6) AS std_all,
  round(leak_threshold, 6) AS leak_threshold, round(spike_threshold, 6) AS spike_threshold FROM thr""")
def baseline_thresholds(spark, sf_dir):
    return rounded(A.baseline_thresholds(typed(spark, sf_dir), KEYS), 6, "mean_all", "std_all", "leak_threshold", "spike_threshold")


@query("moments", f"""WITH {USER_READINGS} SELECT meter_id, count(*) AS n, round(avg(usage_kwh), 6) AS mean,
  round(coalesce(var_samp(usage_kwh), 0), 6) AS variance, round(coalesce(stddev_samp(usage_kwh), 0), 6) AS std FROM readings GROUP BY meter_id""")
def moments(spark, sf_dir):
    return rounded(A.moments(readings_by_user(spark, sf_dir), KEYS), 6, "mean", "variance", "std")


@query("forecast_errors", f"""WITH {READINGS}, e AS (SELECT meter_id, usage_kwh AS a, reactive_lagging_kvarh AS p FROM readings)
SELECT meter_id, round(sqrt(avg((a - p) * (a - p))), 6) AS rmse, round(avg(abs(a - p)), 6) AS mae,
  round(avg(abs((a - p) / greatest(a, 1))) * 100, 6) AS mape, count(*) AS n,
  round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 6) AS r2 FROM e GROUP BY meter_id""")
def forecast_errors(spark, sf_dir):
    df = readings(spark, sf_dir).select("meter_id", F.col("usage_kwh").alias("actual"), F.col("reactive_lagging_kvarh").alias("predicted"))
    return rounded(A.forecast_errors(df, KEYS), 6, "rmse", "mae", "mape", "r2")


METRICS = """count(*) FILTER (WHERE p = 1) AS flagged, count(*) FILTER (WHERE p = 1 AND y = 1) AS tp,
  count(*) FILTER (WHERE p = 1 AND y <> 1) AS fp, count(*) FILTER (WHERE y = 1) AS n_real"""


@query("detection_metrics", f"""WITH c AS (SELECT detector, {METRICS} FROM (
  SELECT 'a' AS detector, quality AS y, toxic AS p FROM labels UNION ALL SELECT 'b', quality, doc_id % 2 FROM labels) GROUP BY detector),
r AS (SELECT *, CASE WHEN flagged > 0 THEN tp / flagged ELSE 0 END AS precision, CASE WHEN n_real > 0 THEN tp / n_real ELSE 0 END AS recall,
  CASE WHEN flagged > 0 THEN fp / flagged ELSE 0 END AS far FROM c)
SELECT detector, flagged, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(far, 6) AS far,
  round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM r""")
def detection_metrics(spark, sf_dir):
    d = detections(spark, sf_dir)
    long = d.select(F.lit("a").alias("detector"), "y_true", F.col("pred_a").alias("y_pred")).unionByName(
        d.select(F.lit("b").alias("detector"), "y_true", F.col("pred_b").alias("y_pred"))
    )
    return rounded(A.detection_metrics(long, ["detector"]), 6, "precision", "recall", "far", "f1")


@query("self_consumption", f"""WITH {READINGS} SELECT meter_id, round(greatest(0, least(1, sum(least(usage_kwh, reactive_lagging_kvarh)) / sum(reactive_lagging_kvarh))), 6) AS self_consumption,
  round(sum(reactive_lagging_kvarh), 4) AS solar_generated FROM readings GROUP BY meter_id""")
def self_consumption(spark, sf_dir):
    df = readings(spark, sf_dir).select(
        "meter_id", F.least("usage_kwh", "reactive_lagging_kvarh").alias("solar_used"),
        F.col("reactive_lagging_kvarh").alias("solar_generated"),
    )
    return rounded(rounded(A.self_consumption(df, KEYS), 6, "self_consumption"), 4, "solar_generated")


@query("emission_totals", f"""WITH {READINGS}, {CURVE}, s AS (SELECT meter_id, CAST(ts AS DATE) AS day, usage_kwh * (carbon_g / 1000) AS s2,
  usage_kwh * 0.22 + 5.0 * (hour(ts) * 3600 / 86400) AS s3 FROM readings JOIN curve ON hour(ts) = curve.hour)
SELECT meter_id, day, round(CAST(sum(CAST(round(s2, 6) AS DECIMAL(28,6))) AS DOUBLE), 6) AS scope2_kg,
  round(CAST(sum(CAST(round(s3, 6) AS DECIMAL(28,6))) AS DOUBLE), 6) AS scope3_kg,
  round((CAST(sum(CAST(round(s2, 6) AS DECIMAL(28,6))) AS DOUBLE) + CAST(sum(CAST(round(s3, 6) AS DECIMAL(28,6))) AS DOUBLE)) / 1000, 10) AS total_tco2 FROM s GROUP BY ALL""")
def emission_totals(spark, sf_dir):
    rows = E.scope23(readings(spark, sf_dir), dims.hour_curve(spark)).withColumn("day", F.to_date("ts"))
    out = A.emission_totals(rows, ["meter_id", "day"], {"scope2_co2_kg": "scope2_kg", "scope3_co2_kg": "scope3_kg"})
    return rounded(rounded(out, 6, "scope2_kg", "scope3_kg"), 10, "total_tco2")


# --- windows ------------------------------------------------------------------------------


@query("rolling", f"""WITH {READINGS} SELECT reading_id, round(avg(usage_kwh) OVER (w ROWS 3 PRECEDING), 6) AS mean_4,
  round(coalesce(stddev_samp(usage_kwh) OVER (w ROWS 3 PRECEDING), 0), 5) AS std_4, round(avg(usage_kwh) OVER (w ROWS 15 PRECEDING), 6) AS mean_16,
  round(coalesce(stddev_samp(usage_kwh) OVER (w ROWS 15 PRECEDING), 0), 5) AS std_16, round(avg(usage_kwh) OVER (w ROWS 191 PRECEDING), 9) AS mean_192
FROM readings WINDOW w AS (PARTITION BY meter_id ORDER BY ts, reading_id)""")
def rolling(spark, sf_dir):
    df = readings(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh")
    out = W.rolling(df, KEYS, ORDER, "usage_kwh", {
        "mean_4": (4, "mean"), "std_4": (4, "std"), "mean_16": (16, "mean"), "std_16": (16, "std"), "mean_192": (192, "mean"),
    })
    out = rounded(rounded(out, 6, "mean_4", "mean_16"), 9, "mean_192")
    return rounded(out, 5, "std_4", "std_16").drop("meter_id", "ts", "usage_kwh")


@query("rolling_zscore", f"""WITH {READINGS}, z AS (SELECT reading_id, abs(usage_kwh - avg(usage_kwh) OVER w) / (stddev_samp(usage_kwh) OVER w + 1e-5) AS z
FROM readings WINDOW w AS (PARTITION BY meter_id ORDER BY ts, reading_id ROWS 23 PRECEDING))
SELECT reading_id, round(z, 4) AS zscore, coalesce(z > 2.8, false) AS is_spike FROM z""")
def rolling_zscore(spark, sf_dir):
    out = W.rolling_zscore(readings(spark, sf_dir), KEYS, ORDER, "usage_kwh")
    return rounded(out, 4, "zscore").select("reading_id", "zscore", "is_spike")


@query("lag_features", f"""WITH {READINGS}, {HOURLY}, {SPINE}, m AS (SELECT meter_id, avg(usage_kwh) AS mu FROM filled GROUP BY meter_id)
SELECT meter_id, ts, round(coalesce(lag(usage_kwh, 24) OVER w, mu), 5) AS lag_1d, round(coalesce(lag(usage_kwh, 168) OVER w, mu), 5) AS lag_7d
FROM filled JOIN m USING (meter_id) WINDOW w AS (PARTITION BY meter_id ORDER BY ts)""")
def lag_features(spark, sf_dir):
    hours = A.resample_filled(readings(spark, sf_dir), KEYS)
    return rounded(W.lag_features(hours, KEYS, ["ts"]), 5, "lag_1d", "lag_7d").select("meter_id", "ts", "lag_1d", "lag_7d")


@query("lookback_join", f"""WITH {READINGS}, m AS (SELECT meter_id, avg(usage_kwh) AS mu FROM readings GROUP BY meter_id)
SELECT reading_id, round(coalesce(lag(usage_kwh, 24) OVER (PARTITION BY meter_id ORDER BY ts, reading_id), mu), 6) AS lookback FROM readings JOIN m USING (meter_id)""")
def lookback_join(spark, sf_dir):
    df = readings(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh")
    return rounded(W.lookback_join(df, KEYS, ORDER), 6, "lookback").select("reading_id", "lookback")


@query("sequence_windows", f"""WITH {READINGS}, s AS (SELECT meter_id, reading_id, usage_kwh, array_agg(usage_kwh) OVER w AS f,
  array_agg(reactive_lagging_kvarh) OVER w AS g FROM readings WINDOW w AS (PARTITION BY meter_id ORDER BY ts, reading_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT reading_id, usage_kwh AS target, f[1] AS oldest_kwh, f[24] AS newest_kwh, g[1] AS oldest_kvarh, len(f) AS steps FROM s WHERE len(f) = 24""")
def sequence_windows(spark, sf_dir):
    out = W.sequence_windows(readings(spark, sf_dir), KEYS, ORDER, ["usage_kwh", "reactive_lagging_kvarh"], "usage_kwh", 24)
    f = F.col("features")
    return out.select(
        "reading_id", "target", f[0]["usage_kwh"].alias("oldest_kwh"), f[23]["usage_kwh"].alias("newest_kwh"),
        f[0]["reactive_lagging_kvarh"].alias("oldest_kvarh"), F.size(f).cast("bigint").alias("steps"),
    )


from gridloom.plans.queries_base import INTERPOLATED  # noqa: E402


@query("interpolate_linear", f"WITH {READINGS}, {INTERPOLATED} SELECT reading_id, round(usage_kwh, 6) AS usage_kwh FROM interpolated")
def interpolate_linear(spark, sf_dir):
    df = readings(spark, sf_dir).select(
        "meter_id", "reading_id", "ts", F.when(F.col("usage_kwh") >= 10, F.col("usage_kwh")).alias("usage_kwh")
    )
    return rounded(W.interpolate_linear(df, KEYS, ORDER, "usage_kwh"), 6, "usage_kwh").select("reading_id", "usage_kwh")


@query("split_by_position", f"""WITH {USER_READINGS}, p AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts, reading_id) - 1 AS pos,
  count(*) OVER (PARTITION BY meter_id) AS n FROM readings)
SELECT reading_id, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM p WHERE pos < floor(n * 0.8) + 24""")
def split_by_position(spark, sf_dir):
    return W.split_by_position(readings_by_user(spark, sf_dir), KEYS, ORDER, 0.8, 24).select("reading_id", "part")


@query("rolling_origin_folds", f"""WITH {READINGS}, p AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts, reading_id) - 1 AS pos,
  count(*) OVER (PARTITION BY meter_id) AS n FROM readings),
f AS (SELECT *, CAST(n - floor(n * 0.15) + fold * floor(floor(n * 0.15) / 3) AS BIGINT) AS origin FROM p CROSS JOIN (VALUES (0), (1), (2)) t(fold))
SELECT meter_id, fold, CASE WHEN pos < origin THEN 'train' ELSE 'validate' END AS part, count(*) AS n, min(pos - origin) AS first_step,
  max(pos - origin) AS last_step, round(sum(usage_kwh), 4) AS kwh FROM f WHERE pos < origin + 48 GROUP BY ALL""")
def rolling_origin_folds(spark, sf_dir):
    out = W.rolling_origin_folds(readings(spark, sf_dir), KEYS, ORDER, 3, 48)
    return out.groupBy("meter_id", "fold", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.round(F.sum("usage_kwh"), 4).alias("kwh"),
    )


@query("cumulative_payback", """WITH y AS (SELECT c_nationkey AS project, year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders) + 1 AS year, sum(o_totalprice) AS cash
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
c AS (SELECT project, sum(cash) * 0.4 AS capex FROM y GROUP BY project),
r AS (SELECT *, sum(cash) OVER (PARTITION BY project ORDER BY year) - capex AS run FROM y JOIN c USING (project))
SELECT project, round(coalesce(min(year - 1 + (cash - run) / cash) FILTER (WHERE run >= 0 AND run - cash < 0), 20), 6) AS payback_years FROM r GROUP BY project""")
def cumulative_payback(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    first = orders.agg(F.min(F.year("o_orderdate"))).scalar()
    y = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("project"), F.year("o_orderdate").alias("_y")
    ).agg(F.sum("o_totalprice").alias("cash_flow"))
    y = y.withColumn("year", F.col("_y") - first + 1)
    total = y.groupBy("project").agg((F.sum("cash_flow") * 0.4).alias("capex"))
    return rounded(W.cumulative_payback(y.join(total, "project"), "project"), 6, "payback_years")


# --- recurrences ----------------------------------------------------------------------------

NUMBERED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts, reading_id) AS pos FROM readings)"""


@query("ewma", f"""WITH RECURSIVE {READINGS}, {NUMBERED},
s AS (SELECT meter_id, pos, reading_id, usage_kwh AS v FROM numbered WHERE pos = 1
  UNION ALL SELECT n.meter_id, n.pos, n.reading_id, 0.8::DOUBLE * s.v + 0.2::DOUBLE * n.usage_kwh FROM s JOIN numbered n ON n.meter_id = s.meter_id AND n.pos = s.pos + 1)
SELECT reading_id, round(v, 6) AS ewma FROM s""")
def ewma(spark, sf_dir):
    df = readings(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh")
    return rounded(R.ewma(df, KEYS, ORDER, "usage_kwh"), 6, "ewma").select("reading_id", "ewma")


@query("thermal_state", f"""WITH RECURSIVE {READINGS}, {NUMBERED},
s AS (SELECT meter_id, pos, reading_id, usage_kwh AS p, 10 + reactive_lagging_kvarh / 5 AS amb, 150.0::DOUBLE AS h FROM numbered WHERE pos = 1
  UNION ALL SELECT n.meter_id, n.pos, n.reading_id, n.usage_kwh, 10 + n.reactive_lagging_kvarh / 5,
    greatest(s.amb, s.h + 0.05::DOUBLE * s.p - 0.002::DOUBLE * (s.h - s.amb)) FROM s JOIN numbered n ON n.meter_id = s.meter_id AND n.pos = s.pos + 1)
SELECT reading_id, round(h, 5) AS thermal_state_c FROM s""")
def thermal_state(spark, sf_dir):
    df = readings(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh", (10 + F.col("reactive_lagging_kvarh") / 5).alias("temp"))
    return rounded(R.thermal_state(df, KEYS, ORDER), 5, "thermal_state_c").select("reading_id", "thermal_state_c")


CUSUM_SQL = f"""WITH RECURSIVE {READINGS}, {NUMBERED}, m AS (SELECT meter_id, avg(usage_kwh) AS mu, stddev_pop(usage_kwh) AS sd FROM readings GROUP BY meter_id),
x AS (SELECT meter_id, pos, reading_id, usage_kwh - mu AS d, 0.5 * sd AS k, 4.0 * sd AS h FROM numbered JOIN m USING (meter_id)),
s AS (SELECT meter_id, pos, reading_id, h, greatest(0, d - k) AS p, greatest(0, -d - k) AS q FROM x WHERE pos = 1
  UNION ALL SELECT x.meter_id, x.pos, x.reading_id, x.h,
    greatest(0, CASE WHEN s.p > s.h OR s.q > s.h THEN 0 ELSE s.p END + x.d - x.k),
    greatest(0, CASE WHEN s.p > s.h OR s.q > s.h THEN 0 ELSE s.q END - x.d - x.k) FROM s JOIN x ON x.meter_id = s.meter_id AND x.pos = s.pos + 1)"""


@query("cusum_drift", CUSUM_SQL + """SELECT reading_id, round(p, 4) AS cusum_pos, round(q, 4) AS cusum_neg,
  CASE WHEN p > h THEN 'Upper' WHEN q > h THEN 'Lower' END AS drift,
  CASE WHEN p > h OR q > h THEN CASE WHEN greatest(p, q) > 1.5 * h THEN 'Critical' ELSE 'Warning' END END AS drift_severity FROM s""")
def cusum_drift(spark, sf_dir):
    df = readings(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh")
    out = R.cusum(df, KEYS, ORDER, threshold=4.0)
    return rounded(out, 4, "cusum_pos", "cusum_neg").select("reading_id", "cusum_pos", "cusum_neg", "drift", "drift_severity")


@query("drift_summary", CUSUM_SQL + """SELECT meter_id, count(*) FILTER (WHERE p > h OR q > h) AS change_points,
  count(*) FILTER (WHERE greatest(p, q) > 1.5 * h) AS critical_points, count(*) FILTER (WHERE p > h OR q > h) > 0 AS drift_detected FROM s GROUP BY meter_id""")
def drift_summary(spark, sf_dir):
    df = readings(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh")
    return R.drift_summary(R.cusum(df, KEYS, ORDER, threshold=4.0), KEYS)


def _solar_steps(spark, sf_dir):
    """Quarter-hour load with clear-sky yield of 100 kW, for two storage scenarios."""
    r = readings(spark, sf_dir).join(dims.hour_curve(spark), F.hour("ts") == F.col("hour"))
    r = r.select("meter_id", "ts", "usage_kwh", (F.col("solar_factor") * 12.0).alias("solar_kwh"))
    steps = R.fifteen_minutes(r, KEYS)
    both = F.array(F.struct(F.lit(150.0).alias("solar_kw"), F.lit(50.0).alias("battery_kwh")),
                   F.struct(F.lit(300.0).alias("solar_kw"), F.lit(200.0).alias("battery_kwh")))
    return steps.withColumn("_s", F.explode(both)).select("*", "_s.*").drop("_s")


DISPATCH_SQL = f"""WITH RECURSIVE {READINGS}, {CURVE},
q AS (SELECT meter_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, sum(usage_kwh) AS load, sum(solar_factor * 12.0) AS base FROM readings JOIN curve ON hour(ts) = curve.hour GROUP BY ALL),
x AS (SELECT *, base * (kw / 100) AS sun, 0.5 * cap * 0.25 AS lim, row_number() OVER (PARTITION BY meter_id, kw ORDER BY ts) AS pos FROM q CROSS JOIN (VALUES (150.0::DOUBLE, 50.0::DOUBLE), (300.0, 200.0)) v(kw, cap)),
s AS (SELECT meter_id, kw, 0::BIGINT AS pos, NULL::TIMESTAMP AS ts, 0.5 * cap AS soc, 0.0::DOUBLE AS grid, 0.0::DOUBLE AS used FROM (SELECT DISTINCT meter_id, kw, cap FROM x)
  UNION ALL SELECT meter_id, kw, pos, ts, CASE WHEN need <= 0 THEN soc + room * eta ELSE soc - given / eta END,
    CASE WHEN need <= 0 THEN 0 ELSE need - given END, CASE WHEN need <= 0 THEN sun + need + room ELSE sun END
  FROM (SELECT *, least(room, soc * eta) AS given FROM (
    SELECT *, CASE WHEN room > 0 THEN greatest(0.70::DOUBLE, least(0.98::DOUBLE, 0.98::DOUBLE - 0.05::DOUBLE * power(room / 0.25 / cap, 2))) ELSE 1 END AS eta FROM (
      SELECT x.*, s.soc, x.load - x.sun AS need, least(abs(x.load - x.sun), lim, CASE WHEN x.load - x.sun <= 0 THEN cap - s.soc ELSE lim END) AS room
      FROM s JOIN x ON x.meter_id = s.meter_id AND x.kw = s.kw AND x.pos = s.pos + 1))))
SELECT meter_id, ts, kw AS solar_kw, round(grid, 6) AS grid_draw, round(used, 6) AS solar_used, round(soc, 6) AS soc_kwh FROM s WHERE pos > 0"""


@query("battery_dispatch", DISPATCH_SQL)
def battery_dispatch(spark, sf_dir):
    out = R.battery_dispatch(_solar_steps(spark, sf_dir), KEYS)
    out = rounded(out, 6, "grid_draw", "solar_used", "soc_kwh")
    return out.select("meter_id", "ts", "solar_kw", "grid_draw", "solar_used", "soc_kwh")


@query("soc_soh_scan", f"""WITH RECURSIVE {READINGS},
x0 AS (SELECT meter_id, date_trunc('hour', ts) AS ts, least(avg(reactive_lagging_kvarh) / 4, 25.0::DOUBLE) AS c, least(avg(usage_kwh) / 4, 25.0::DOUBLE) AS d FROM readings GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts) AS pos FROM x0),
s AS (SELECT DISTINCT meter_id, 0::BIGINT AS pos, NULL::TIMESTAMP AS ts, 25.0::DOUBLE AS soc, 0.0::DOUBLE AS dod, 100.0::DOUBLE AS soh FROM x
  UNION ALL SELECT meter_id, pos, ts, soc1, 1 - soc1 / 50, greatest(0, soh - d / 100 * 0.00005 * (1 + 1.5 * (1 - soc1 / 50)) * 100) FROM (
    SELECT x.meter_id, x.pos, x.ts, x.d, s.soh, least(50.0::DOUBLE, greatest(0, s.soc + x.c * greatest(0.7::DOUBLE, least(0.98::DOUBLE, 0.98::DOUBLE - 0.05::DOUBLE * power(x.c / 50, 2)))
      - x.d / greatest(0.7::DOUBLE, least(0.98::DOUBLE, 0.98::DOUBLE - 0.05::DOUBLE * power(x.d / 50, 2))))) AS soc1
    FROM s JOIN x ON x.meter_id = s.meter_id AND x.pos = s.pos + 1))
SELECT meter_id, ts, round(soc, 6) AS soc_kwh, round(dod, 6) AS dod, round(soh, 6) AS soh_pct FROM s WHERE pos > 0""")
def soc_soh_scan(spark, sf_dir):
    steps = A.resample(readings(spark, sf_dir), KEYS, cols=("usage_kwh", "reactive_lagging_kvarh")).select(
        "meter_id", "ts", F.least(F.col("reactive_lagging_kvarh") / 4, F.lit(25.0)).alias("charge_kwh"),
        F.least(F.col("usage_kwh") / 4, F.lit(25.0)).alias("discharge_kwh"), F.lit(50.0).alias("battery_kwh"),
    )
    out = rounded(R.soc_soh_scan(steps, KEYS, ["ts"]), 6, "soc_kwh", "dod", "soh_pct")
    return out.select("meter_id", "ts", "soc_kwh", "dod", "soh_pct")


# --- ranking and sets -------------------------------------------------------------------------


@query("order_by_ts", f"WITH {READINGS} SELECT reading_id, ts, usage_kwh FROM readings ORDER BY ts, reading_id")
def order_by_ts(spark, sf_dir):
    return readings(spark, sf_dir).select("reading_id", "ts", "usage_kwh").orderBy(*ORDER)


@query("first_n_events", f"""WITH {READINGS} SELECT meter_id, reading_id, ts, usage_kwh, row_number() OVER (PARTITION BY meter_id ORDER BY ts, reading_id) AS rank
FROM readings WHERE usage_kwh > 100 QUALIFY rank <= 5""")
def first_n_events(spark, sf_dir):
    df = readings(spark, sf_dir).filter("usage_kwh > 100").select("meter_id", "reading_id", "ts", "usage_kwh")
    return G.top_k(df, KEYS, [F.col("ts"), F.col("reading_id")], 5)


@query("argmin_candidate", """SELECT l_suppkey, price, l_partkey AS partkey FROM (
  SELECT l_suppkey, l_partkey, min(round(l_extendedprice * (1 - l_discount), 2)) AS price FROM lineitem GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY price, l_partkey) = 1""")
def argmin_candidate(spark, sf_dir):
    price = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2)
    each = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_partkey").alias("partkey")).agg(F.min(price).alias("price"))
    return G.argmin_candidate(each, ["l_suppkey"], "price", "partkey")


@query("best_model", """WITH e AS (SELECT l_suppkey AS site, l_returnflag AS model, round(sqrt(avg(l_quantity * l_quantity)), 9) AS rmse FROM lineitem GROUP BY ALL)
SELECT site, model AS best_model, round(rmse, 6) AS rmse FROM e QUALIFY row_number() OVER (PARTITION BY site ORDER BY rmse, model) = 1""")
def best_model(spark, sf_dir):
    q = F.col("l_quantity")
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.col("l_returnflag").alias("model")).agg(
        F.round(F.sqrt(F.avg(q * q)), 9).alias("rmse")
    )
    return rounded(G.best_model(e, ["site"]), 6, "rmse")


@query("triage_alerts", """WITH a AS (SELECT user_id AS site, event_id AS alert_id,
  CASE WHEN value > 250 THEN 'CRITICAL' WHEN value > 100 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, event_type AS alert_type FROM events WHERE value > 60 AND event_type <> 'error'),
t AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 ELSE 1 END AS tier, count(*) OVER (PARTITION BY site) AS n FROM a
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY tier DESC, alert_id) = 1)
SELECT s.site, coalesce(CASE tier WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' END, 'LOW') AS risk, coalesce(n, 0) AS active_alerts,
  coalesce(alert_type, 'Normal Operations') AS alert_type, alert_id FROM (SELECT DISTINCT user_id AS site FROM events) s LEFT JOIN t ON s.site = t.site""")
def triage_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    alerts = e.filter("value > 60").select(
        F.col("user_id").alias("site"), F.col("event_id").alias("alert_id"),
        F.when(F.col("value") > 250, "CRITICAL").when(F.col("value") > 100, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.col("event_type").alias("alert_type"),
        F.when(F.col("event_type") == "error", "CLOSED").otherwise("TRIGGERED").alias("status"),
    )
    return G.triage_alerts(alerts, e.select(F.col("user_id").alias("site")))


@query("union_labels", f"""WITH {READINGS}, {LOAD_TYPED}, w AS (SELECT meter_id, reading_id, 'weekend' AS rule FROM typed
  WHERE isodow(ts) >= 6 AND usage_kwh > 30 QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY ts, reading_id) <= 34),
l AS (SELECT meter_id, reading_id, 'light' AS rule FROM typed WHERE load_type = 'Light_Load' AND usage_kwh > 15
  QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY ts, reading_id) <= 28)
SELECT DISTINCT meter_id, reading_id FROM (SELECT * FROM w UNION ALL SELECT * FROM l)""")
def union_labels(spark, sf_dir):
    df, by_time = typed(spark, sf_dir), [F.col("ts"), F.col("reading_id")]
    weekend = G.top_k(df.filter((F.weekday("ts") >= 5) & (F.col("usage_kwh") > 30)), KEYS, by_time, 34)
    light = G.top_k(df.filter("load_type = 'Light_Load' and usage_kwh > 15"), KEYS, by_time, 28)
    return weekend.unionByName(light).select("meter_id", "reading_id").distinct()
