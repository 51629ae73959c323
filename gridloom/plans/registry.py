"""Registered queries and, where SQL can say the same, the SQL to check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import scratch_path as scratch  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}

READINGS = """readings AS (
  SELECT event_type AS meter_id, event_id AS reading_id, ts, value AS usage_kwh,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS reactive_lagging_kvarh,
         CASE WHEN sqrt(value * value + power(CAST(json_extract_string(props, '$.k') AS DOUBLE), 2)) > 0
              THEN 100.0::DOUBLE * value / sqrt(value * value + power(CAST(json_extract_string(props, '$.k') AS DOUBLE), 2))
         END AS power_factor_lagging
  FROM events)"""
USER_READINGS = READINGS.replace("event_type AS meter_id", "CAST(user_id AS VARCHAR) AS meter_id")

# Fixed values, typed here a second time so that the check does not share the implementation's tables.
CURVE = """curve(hour, tariff, carbon_g, solar_factor) AS (VALUES
  (0, 0.06::DOUBLE, 400.0::DOUBLE, 0.0::DOUBLE), (1, 0.06::DOUBLE, 400.0::DOUBLE, 0.0::DOUBLE),
  (2, 0.06::DOUBLE, 400.0::DOUBLE, 0.0::DOUBLE), (3, 0.06::DOUBLE, 400.0::DOUBLE, 0.0::DOUBLE),
  (4, 0.06::DOUBLE, 400.0::DOUBLE, 0.0::DOUBLE), (5, 0.06::DOUBLE, 400.0::DOUBLE, 0.0::DOUBLE),
  (6, 0.06::DOUBLE, 400.0::DOUBLE, 0.05::DOUBLE), (7, 0.06::DOUBLE, 400.0::DOUBLE, 0.2::DOUBLE),
  (8, 0.06::DOUBLE, 400.0::DOUBLE, 0.5::DOUBLE), (9, 0.12::DOUBLE, 320.0::DOUBLE, 0.8::DOUBLE),
  (10, 0.18::DOUBLE, 250.0::DOUBLE, 1.0::DOUBLE), (11, 0.18::DOUBLE, 250.0::DOUBLE, 1.2::DOUBLE),
  (12, 0.18::DOUBLE, 250.0::DOUBLE, 1.2::DOUBLE), (13, 0.18::DOUBLE, 250.0::DOUBLE, 1.0::DOUBLE),
  (14, 0.18::DOUBLE, 250.0::DOUBLE, 0.8::DOUBLE), (15, 0.18::DOUBLE, 250.0::DOUBLE, 0.5::DOUBLE),
  (16, 0.12::DOUBLE, 320.0::DOUBLE, 0.2::DOUBLE), (17, 0.12::DOUBLE, 320.0::DOUBLE, 0.05::DOUBLE),
  (18, 0.12::DOUBLE, 450.0::DOUBLE, 0.0::DOUBLE), (19, 0.12::DOUBLE, 450.0::DOUBLE, 0.0::DOUBLE),
  (20, 0.12::DOUBLE, 450.0::DOUBLE, 0.0::DOUBLE), (21, 0.12::DOUBLE, 450.0::DOUBLE, 0.0::DOUBLE),
  (22, 0.06::DOUBLE, 400.0::DOUBLE, 0.0::DOUBLE), (23, 0.06::DOUBLE, 400.0::DOUBLE, 0.0::DOUBLE))"""
PROFILES = """profiles(tenant, mult, pf_base, peak_hour, kwh_offset) AS (VALUES
  ('steel', 1.0::DOUBLE, 0.865::DOUBLE, 14, 0.0::DOUBLE),
  ('textile', 0.68::DOUBLE, 0.92::DOUBLE, 11, 5.0::DOUBLE),
  ('rice', 0.5::DOUBLE, 0.895::DOUBLE, 16, -2.0::DOUBLE),
  ('auto', 1.68::DOUBLE, 0.84::DOUBLE, 10, 12.0::DOUBLE),
  ('chemical', 1.12::DOUBLE, 0.91::DOUBLE, 13, 3.0::DOUBLE))"""
TARIFFS = """tariffs(utility, base_rate, peak_surcharge, offpeak_rebate, demand_rate, pf_penalty_pct, max_incentive_pct) AS (VALUES
  ('MSEDCL', 8.5::DOUBLE, 1.5::DOUBLE, 1.0::DOUBLE, 475.0::DOUBLE, 1.5::DOUBLE, 7.0::DOUBLE),
  ('UGVCL', 7.8::DOUBLE, 1.25::DOUBLE, 0.85::DOUBLE, 425.0::DOUBLE, 2.0::DOUBLE, 5.0::DOUBLE),
  ('BESCOM', 8.2::DOUBLE, 1.2::DOUBLE, 0.8::DOUBLE, 450.0::DOUBLE, 1.75::DOUBLE, 6.0::DOUBLE),
  ('TANGEDCO', 7.9::DOUBLE, 1.35::DOUBLE, 0.75::DOUBLE, 440.0::DOUBLE, 2.0::DOUBLE, 5.5::DOUBLE))"""
BANDS = """bands(utility, band, start_hour, end_hour) AS (VALUES
  ('MSEDCL', 'peak', 9, 12), ('MSEDCL', 'peak', 18, 22), ('MSEDCL', 'offpeak', 22, 6), ('UGVCL', 'peak', 7, 11),
  ('UGVCL', 'peak', 18, 22), ('UGVCL', 'offpeak', 22, 6), ('BESCOM', 'peak', 6, 10), ('BESCOM', 'peak', 18, 22),
  ('BESCOM', 'offpeak', 22, 6), ('TANGEDCO', 'peak', 6, 9), ('TANGEDCO', 'peak', 18, 21),
  ('TANGEDCO', 'offpeak', 22, 5))"""
NORMS = """norms(sector, baseline_sec, target_sec, sec_unit) AS (VALUES
  ('Steel', 0.635::DOUBLE, 0.585::DOUBLE, 'TOE/ton'), ('Cement', 76.2::DOUBLE, 68.5::DOUBLE, 'kWh/ton'),
  ('Textile', 16.8::DOUBLE, 14.2::DOUBLE, 'MJ/kg'))"""
FACTORS = """factors(region, grid_factor) AS (VALUES
  ('Northern', 0.71::DOUBLE), ('Western', 0.79::DOUBLE), ('Southern', 0.68::DOUBLE), ('Eastern', 0.85::DOUBLE),
  ('North-Eastern', 0.62::DOUBLE))"""
PLANTS = """plants AS (
  SELECT o_custkey AS plant_id, y AS year,
         CASE c_mktsegment WHEN 'MACHINERY' THEN 'Steel' WHEN 'BUILDING' THEN 'Cement'
              WHEN 'HOUSEHOLD' THEN 'Textile' WHEN 'FURNITURE' THEN 'Textile' ELSE 'Other' END AS sector,
         CASE r_name WHEN 'AFRICA' THEN 'Southern' WHEN 'AMERICA' THEN 'Western' WHEN 'ASIA' THEN 'Eastern'
              WHEN 'EUROPE' THEN 'Northern' ELSE 'Unlisted' END AS region,
         annual_kwh, n_orders * 1000.0::DOUBLE AS production_t, c_acctbal
  FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS annual_kwh, count(*) AS n_orders
        FROM orders GROUP BY ALL) t
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""
HOURLY = """hourly AS (
  SELECT meter_id, date_trunc('hour', ts) AS ts, avg(usage_kwh) AS usage_kwh FROM readings GROUP BY ALL)"""
SPINE = """spine AS (
  SELECT meter_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hourly GROUP BY meter_id),
filled AS (
  SELECT meter_id, ts, coalesce(
      last_value(usage_kwh IGNORE NULLS) OVER (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(usage_kwh IGNORE NULLS) OVER (PARTITION BY meter_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      0.0) AS usage_kwh
  FROM spine LEFT JOIN hourly USING (meter_id, ts))"""


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})
