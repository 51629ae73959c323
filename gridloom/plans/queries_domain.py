"""Emissions, power quality, compliance, economics and start-hour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import dims
from gridloom.functions import physics as P
from gridloom.operators import aggregates as A
from gridloom.operators import economics as X
from gridloom.operators import emissions as E
from gridloom.operators import starts as S
from gridloom.plans.queries_base import KEYS, ORDER, utility_of
from gridloom.plans.queries_series import LOAD_TYPED, typed
from gridloom.plans.registry import CURVE, FACTORS, NORMS, PLANTS, READINGS, TARIFFS, query, rounded
from gridloom.sources.tables import plants, readings, table, tasks

EWMA_SQL = """numbered AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts, reading_id) AS pos FROM readings),
sm AS (SELECT meter_id, pos, reading_id, ts, usage_kwh, reactive_lagging_kvarh, usage_kwh AS v FROM numbered WHERE pos = 1
  UNION ALL SELECT n.meter_id, n.pos, n.reading_id, n.ts, n.usage_kwh, n.reactive_lagging_kvarh, 0.8::DOUBLE * sm.v + 0.2::DOUBLE * n.usage_kwh
  FROM sm JOIN numbered n ON n.meter_id = sm.meter_id AND n.pos = sm.pos + 1)"""


@query("emissions_ingest", f"""WITH RECURSIVE {READINGS}, {CURVE}, {EWMA_SQL},
e AS (SELECT reading_id, v * 0.062176::DOUBLE * 1.93::DOUBLE AS s1,
  CASE WHEN meter_id = 'error' THEN reactive_lagging_kvarh ELSE usage_kwh * (carbon_g / 1000) END AS s2,
  usage_kwh * 0.22::DOUBLE + 5 * (hour(ts) * 3600 / 86400) AS s3 FROM sm JOIN curve ON hour(ts) = curve.hour)
SELECT reading_id, round(s1, 6) AS scope1_co2_kg, round(s2, 10) AS scope2_co2_kg, round(s3, 7) AS scope3_co2_kg, round((s1 + s2 + s3) / 1000, 13) AS co2_tco2 FROM e""")
def emissions_ingest(spark, sf_dir):
    """Readings of one meter supply their own scope 2."""
    r = readings(spark, sf_dir).withColumn(
        "scope2_co2_kg", F.when(F.col("meter_id") == "error", F.col("reactive_lagging_kvarh"))
    )
    out = E.emissions_ingest(r, dims.hour_curve(spark), KEYS, order=ORDER)
    out = rounded(rounded(out, 6, "scope1_co2_kg"), 10, "scope2_co2_kg")
    out = rounded(rounded(out, 7, "scope3_co2_kg"), 13, "co2_tco2")
    return out.select("reading_id", "scope1_co2_kg", "scope2_co2_kg", "scope3_co2_kg", "co2_tco2")


def with_weather(df):
    return df.withColumn("temp", 10 + F.col("reactive_lagging_kvarh") / 5).withColumn(
        "cloud", F.least(F.col("usage_kwh") / 200, F.lit(1.0))
    )


THERMAL_SQL = """numbered AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts, reading_id) AS pos,
   10 + reactive_lagging_kvarh / 5 AS amb, least(usage_kwh / 200, 1.0::DOUBLE) AS cloud FROM readings),
th AS (SELECT meter_id, pos, reading_id, ts, usage_kwh, amb, cloud, 150.0::DOUBLE AS h FROM numbered WHERE pos = 1
  UNION ALL SELECT n.meter_id, n.pos, n.reading_id, n.ts, n.usage_kwh, n.amb, n.cloud,
    greatest(th.amb, th.h + 0.05::DOUBLE * th.usage_kwh - 0.002::DOUBLE * (th.h - th.amb))
  FROM th JOIN numbered n ON n.meter_id = th.meter_id AND n.pos = th.pos + 1)"""


@query("emissions_batch", f"""WITH RECURSIVE {READINGS}, {CURVE}, {THERMAL_SQL},
e AS (SELECT reading_id, greatest(0, (200 - h) * 0.12::DOUBLE + 0.05::DOUBLE * usage_kwh) * 1.93::DOUBLE AS s1,
  usage_kwh * (greatest(150, least(600, carbon_g - 120 * (1 - cloud) * (solar_factor / 1.2::DOUBLE))) / 1000) AS s2,
  usage_kwh * 0.22::DOUBLE + 5 * ((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400) AS s3
  FROM th JOIN curve ON hour(ts) = curve.hour)
SELECT reading_id, round(s1, 6) AS scope1_co2_kg, round(s2, 10) AS scope2_co2_kg, round(s3, 7) AS scope3_co2_kg, round((s1 + s2 + s3) / 1000, 13) AS co2_tco2 FROM e""")
def emissions_batch(spark, sf_dir):
    out = E.emissions_batch(with_weather(readings(spark, sf_dir)), dims.hour_curve(spark), KEYS, order=ORDER)
    out = rounded(rounded(out, 6, "scope1_co2_kg"), 10, "scope2_co2_kg")
    out = rounded(rounded(out, 7, "scope3_co2_kg"), 13, "co2_tco2")
    return out.select("reading_id", "scope1_co2_kg", "scope2_co2_kg", "scope3_co2_kg", "co2_tco2")


@query("solar_yield", f"""WITH {READINGS}, a AS (SELECT reading_id, 10 + reactive_lagging_kvarh / 5 AS temp, least(usage_kwh / 200, 1.0::DOUBLE) AS cloud,
  radians(CASE WHEN meter_id = 'click' THEN 52.2 ELSE 19.0 END) AS lat, radians(23.45 * sin(2 * pi() * (284 + dayofyear(ts)) / 365.0)) AS decl,
  radians(15 * (hour(ts) + minute(ts) / 60.0::DOUBLE - 12)) AS ha FROM readings),
b AS (SELECT *, sin(lat) * sin(decl) + cos(lat) * cos(decl) * cos(ha) AS el FROM a),
c AS (SELECT *, CASE WHEN el > 0.05 THEN 1361 * power(0.7, power(1 / el, 0.678)) ELSE 0 END AS dni FROM b),
d AS (SELECT *, CASE WHEN el > 0 THEN (dni * el + 0.15 * dni) * (1 - 0.75 * power(cloud, 3)) ELSE 0 END AS ghi FROM c)
SELECT reading_id, round(ghi, 4) AS ghi_w_m2, round(CASE WHEN el > 0 THEN greatest(0, 100 * ghi / 1000 * (1 - 0.004 * (temp + 0.03 * ghi - 25)) * 0.12) ELSE 0 END, 5) AS solar_pv_yield_kwh FROM d""")
def solar_yield(spark, sf_dir):
    df = with_weather(readings(spark, sf_dir)).withColumn("lat_deg", F.when(F.col("meter_id") == "click", 52.2).otherwise(19.0))
    out = E.solar_yield(df).select("reading_id", "ghi_w_m2", "solar_pv_yield_kwh")
    return rounded(rounded(out, 4, "ghi_w_m2"), 5, "solar_pv_yield_kwh")


@query("net_power_factor", """WITH t AS (SELECT event_id AS reading_id, value AS p, 0.5 + (event_id % 50) / 100.0::DOUBLE AS pf FROM events),
q AS (SELECT *, greatest(0, p * sqrt(1 - pf * pf) / pf - 10) AS q FROM t),
n AS (SELECT reading_id, CASE WHEN p > 0 AND q > 0 THEN p / sqrt(p * p + q * q) ELSE 1 END AS pf_net FROM q)
SELECT reading_id, round(pf_net, 6) AS pf_net, round(CASE WHEN pf_net < 0.9 THEN 1 + 2 * (0.9 - pf_net) ELSE 1 END, 6) AS multiplier FROM n""")
def net_power_factor(spark, sf_dir):
    pf = 0.5 + F.col("reading_id") % 50 / 100.0
    df = readings(spark, sf_dir).select("reading_id", "usage_kwh", pf.alias("pf"))
    q = F.greatest(F.lit(0.0), P.reactive_power(F.col("usage_kwh"), F.col("pf")) - 10.0)
    out = df.withColumn("pf_net", P.net_power_factor(F.col("usage_kwh"), q))
    out = out.withColumn("multiplier", P.pf_cost_multiplier(F.col("pf_net"), F.lit(2.0)))
    return rounded(out, 6, "pf_net", "multiplier").select("reading_id", "pf_net", "multiplier")


@query("harmonics_check", f"""WITH {READINGS}, t AS (SELECT reading_id, reactive_lagging_kvarh / 10 AS v, usage_kwh / 10 AS i, CASE WHEN meter_id = 'click' THEN 0.4 ELSE 11.0 END AS kv FROM readings)
SELECT reading_id, CASE WHEN kv <= 1 THEN 8.0 ELSE 5.0 END::DOUBLE AS v_thd_limit, v <= CASE WHEN kv <= 1 THEN 8 ELSE 5 END AS v_ok, i <= 8 AS i_ok,
  v <= CASE WHEN kv <= 1 THEN 8 ELSE 5 END AND i <= 8 AS overall_ok FROM t""")
def harmonics_check(spark, sf_dir):
    kv = F.when(F.col("meter_id") == "click", 0.4).otherwise(11.0)
    cols = P.harmonics_columns(F.col("reactive_lagging_kvarh") / 10, F.col("usage_kwh") / 10, kv)
    return readings(spark, sf_dir).withColumns(cols).select("reading_id", "v_thd_limit", "v_ok", "i_ok", "overall_ok")


@query("capacitor_sizing", """WITH t AS (SELECT p_partkey AS site, p_retailprice AS kw, least(0.999, greatest(0.5, 0.45 + p_size / 80.0::DOUBLE)) AS pf FROM part),
g AS (SELECT *, greatest(pf, 0.99) AS goal FROM t),
k AS (SELECT *, kw * (tan(acos(pf)) - tan(acos(goal))) AS kvar, kw * 720 * 8.5 * 0.65 AS bill FROM g),
c AS (SELECT *, greatest(25, ceil(kvar / 25) * 25) AS rated, CASE WHEN pf < 0.9 THEN bill * ((0.9 - pf) * 100 * 1.5 / 100) ELSE 0 END AS pen,
  CASE WHEN goal >= 0.95 THEN bill * least(7, (goal - 0.95) * 100) / 100 ELSE 0 END AS inc FROM k)
SELECT site, round(kvar, 6) AS kvar_exact, rated AS kvar_rated, rated * 1450.0 AS capex, round(pen, 6) AS monthly_penalty, round(inc, 6) AS monthly_incentive,
  round(CASE WHEN pen + inc > 0 THEN rated * 1450 / greatest(1, pen + inc) ELSE 0 END, 6) AS payback_months FROM c""")
def capacitor_sizing(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("site"), F.col("p_retailprice").alias("kw"), (0.45 + F.col("p_size") / 80.0).alias("pf")
    )
    out = df.withColumns(P.capacitor_columns(F.col("kw"), F.col("pf"), F.lit(0.99), F.lit(8.5))).withColumn("kvar_rated", F.col("kvar_rated").cast("double"))
    out = rounded(out, 6, "kvar_exact", "monthly_penalty", "monthly_incentive", "payback_months")
    return out.select("site", "kvar_exact", "kvar_rated", "capex", "monthly_penalty", "monthly_incentive", "payback_months")


BILL_SQL = f"""WITH {READINGS}, {TARIFFS}, u AS (SELECT *, CASE meter_id WHEN 'click' THEN 'MSEDCL' WHEN 'error' THEN 'UGVCL' WHEN 'purchase' THEN 'BESCOM' ELSE 'TANGEDCO' END AS utility FROM readings),"""


@query("bill_charges", """WITH t(utility, base_rate, peak_surcharge, demand_rate, pf_penalty_pct) AS (VALUES
 ('MSEDCL', 8.5::DOUBLE, 1.5::DOUBLE, 475.0::DOUBLE, 1.5::DOUBLE), ('UGVCL', 7.8, 1.25, 425, 2.0), ('BESCOM', 8.2, 1.2, 450, 1.75)),
b AS (SELECT p_partkey AS bill, CASE p_size % 4 WHEN 0 THEN 'MSEDCL' WHEN 1 THEN 'UGVCL' WHEN 2 THEN 'BESCOM' ELSE 'OTHER' END AS utility,
  p_retailprice * 100 AS kwh, p_retailprice / 2 AS demand_kva, 0.8 + (p_size % 20) / 100.0::DOUBLE AS pf FROM part),
j AS (SELECT b.*, coalesce(base_rate, 8.5) AS base_rate, coalesce(peak_surcharge, 1.5) AS ps, coalesce(demand_rate, 475) AS dr, coalesce(pf_penalty_pct, 1.5) AS pp FROM b LEFT JOIN t USING (utility)),
c AS (SELECT *, kwh * base_rate AS energy, demand_kva * dr AS demand, kwh * 0.25 * ps AS peak,
  CASE WHEN pf < 0.9 THEN kwh * base_rate * ((0.9 - pf) * 100 * pp / 100) ELSE 0 END AS pfc FROM j)
SELECT bill, utility, round(energy, 4) AS energy_charge, round(demand, 4) AS demand_charge, round(pfc, 4) AS pf_charge, round(peak, 4) AS peak_charge,
  round(energy + demand + pfc + peak, 4) AS total_charge FROM c""")
def bill_charges(spark, sf_dir):
    size = F.col("p_size") % 4
    bills = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("bill"),
        F.when(size == 0, "MSEDCL").when(size == 1, "UGVCL").when(size == 2, "BESCOM").otherwise("OTHER").alias("utility"),
        (F.col("p_retailprice") * 100).alias("kwh"), (F.col("p_retailprice") / 2).alias("demand_kva"),
        (0.8 + F.col("p_size") % 20 / 100.0).alias("pf"),
    )
    cols = ("energy_charge", "demand_charge", "pf_charge", "peak_charge", "total_charge")
    return rounded(X.bill_charges(bills, dims.utility_tariffs(spark)), 4, *cols).select("bill", "utility", *cols)


@query("bill_charges_from_readings", BILL_SQL + """
s AS (SELECT meter_id, utility, sum(usage_kwh) AS kwh, max(usage_kwh) AS demand_kva, 0.85 AS pf,
  sum(usage_kwh) FILTER (WHERE (utility = 'MSEDCL' AND (hour(ts) BETWEEN 9 AND 11 OR hour(ts) BETWEEN 18 AND 21))
   OR (utility = 'UGVCL' AND (hour(ts) BETWEEN 7 AND 10 OR hour(ts) BETWEEN 18 AND 21)) OR (utility = 'BESCOM' AND (hour(ts) BETWEEN 6 AND 9 OR hour(ts) BETWEEN 18 AND 21))
   OR (utility = 'TANGEDCO' AND (hour(ts) BETWEEN 6 AND 8 OR hour(ts) BETWEEN 18 AND 20))) AS peak_kwh FROM u GROUP BY ALL)
SELECT meter_id, round(kwh * base_rate, 3) AS energy_charge, round(peak_kwh * peak_surcharge, 3) AS peak_charge,
  round(kwh * base_rate + demand_kva * demand_rate + kwh * base_rate * ((0.9 - pf) * 100 * pf_penalty_pct / 100) + peak_kwh * peak_surcharge, 3) AS total_charge
FROM s JOIN tariffs USING (utility)""")
def bill_charges_from_readings(spark, sf_dir):
    """Peak energy comes from the readings' own bands instead of a flat share."""
    from gridloom.operators.joins import join_tod_bands

    r = readings(spark, sf_dir).withColumn("utility", utility_of(F.col("meter_id")))
    banded = join_tod_bands(r, dims.tariff_bands(spark), dims.utility_tariffs(spark))
    bills = banded.groupBy("meter_id", "utility").agg(
        F.sum("usage_kwh").alias("kwh"), F.max("usage_kwh").alias("demand_kva"),
        F.sum(F.when(F.col("band") == "peak", F.col("usage_kwh"))).alias("peak_kwh"), F.lit(0.85).alias("pf"),
    )
    cols = ("energy_charge", "peak_charge", "total_charge")
    return rounded(X.bill_charges(bills, dims.utility_tariffs(spark)), 3, *cols).select("meter_id", *cols)


@query("sec_compliance", f"""WITH {PLANTS}, {NORMS}, j AS (SELECT plants.*, coalesce(baseline_sec, 16.8) AS b, coalesce(target_sec, 14.2) AS t,
  CASE plants.sector WHEN 'Steel' THEN annual_kwh / 11630 / production_t WHEN 'Cement' THEN annual_kwh / production_t ELSE annual_kwh * 3.6 / (production_t * 1000) END AS a
  FROM plants LEFT JOIN norms USING (sector)),
g AS (SELECT *, CASE sector WHEN 'Steel' THEN t - a WHEN 'Cement' THEN (t - a) / 11630 ELSE (t - a) * 0.277778 / 11630 END * production_t AS gap FROM j)
SELECT plant_id, year, sector, round(a, 10) AS actual_sec, round(greatest(0, (b - a) / b * 100), 10) AS reduction_pct, round(CASE WHEN gap > 0 THEN gap ELSE 0 END, 4) AS certificates,
  round(CASE WHEN gap > 0 THEN gap * 1840 ELSE 0 END, 2) AS certificate_value, round(CASE WHEN gap > 0 THEN 0 ELSE abs(gap) * 10000 END, 2) AS penalty,
  CASE WHEN gap > 0 THEN 'Surplus' WHEN a > t THEN 'Shortfall' ELSE 'Compliant' END AS status FROM g""")
def sec_compliance(spark, sf_dir):
    out = X.sec_compliance(plants(spark, sf_dir), dims.sector_norms(spark))
    out = rounded(rounded(out, 10, "actual_sec", "reduction_pct"), 4, "certificates")
    return rounded(out, 2, "certificate_value", "penalty").select(
        "plant_id", "year", "sector", "actual_sec", "reduction_pct", "certificates", "certificate_value", "penalty", "status"
    )


@query("enpi", f"""WITH {PLANTS}, y AS (SELECT plant_id, year, annual_kwh AS actual, lag(annual_kwh) OVER (PARTITION BY plant_id ORDER BY year) AS base,
  50.0 + plant_id % 10 AS hdd, 120.0 + plant_id % 7 AS cdd FROM plants),
e AS (SELECT *, base * (1 + 0.0005 * hdd + 0.0008 * cdd) AS expected FROM y WHERE base IS NOT NULL)
SELECT plant_id, year, round(expected, 6) AS expected_kwh, round(greatest(0, expected - actual), 6) AS savings_kwh, round((expected - actual) / greatest(1, expected) * 100, 5) AS improvement_pct,
  CASE WHEN expected >= actual THEN 'Conforming' ELSE 'Action Required' END AS conformance FROM e""")
def enpi(spark, sf_dir):
    p = plants(spark, sf_dir).select("plant_id", "year", "annual_kwh")
    # the year before, for the baseline; a plant has one row per year
    from pyspark.sql import Window

    w = Window.partitionBy("plant_id").orderBy("year")
    sites = p.withColumn("baseline_kwh", F.lag("annual_kwh").over(w)).filter("baseline_kwh is not null").select(
        "plant_id", "year", "baseline_kwh", F.col("annual_kwh").alias("actual_kwh"),
        (50.0 + F.col("plant_id") % 10).alias("hdd"), (120.0 + F.col("plant_id") % 7).alias("cdd"),
    )
    out = rounded(rounded(X.enpi(sites), 6, "expected_kwh", "savings_kwh"), 5, "improvement_pct")
    return out.select("plant_id", "year", "expected_kwh", "savings_kwh", "improvement_pct", "conformance")


@query("esg_disclosure", f"""WITH {PLANTS}, c AS (SELECT plant_id, year, annual_kwh AS kwh, greatest(c_acctbal, 0) * 10 AS ren, production_t / 10 AS fuel, c_acctbal / 100 AS turnover FROM plants),
s AS (SELECT *, fuel * 2.68 / 1000 AS s1, greatest(0, kwh - ren) * 0.73 / 1000 AS s2l, greatest(0, kwh - ren) * 0.71 / 1000 AS s2m, kwh * 0.085 * 0.73 / 1000 AS s3, kwh * 0.0036 + fuel * 0.038 AS gj FROM c)
SELECT plant_id, year, round(s1, 10) AS scope1_t, round(s2l, 10) AS scope2_location_t, round(s2m, 10) AS scope2_market_t, round(s3, 10) AS scope3_t, round(s1 + s2l + s3, 10) AS total_t,
  round(gj / greatest(1, turnover), 7) AS gj_per_turnover, round(100 * ren / greatest(1, kwh), 7) AS renewable_share_pct FROM s""")
def esg_disclosure(spark, sf_dir):
    c = plants(spark, sf_dir).select(
        "plant_id", "year", F.col("annual_kwh").alias("kwh"), (F.greatest("c_acctbal", F.lit(0.0)) * 10).alias("renewable_kwh"),
        (F.col("production_t") / 10).alias("diesel_l"), (F.col("c_acctbal") / 100).alias("turnover"),
    )
    cols = ("scope1_t", "scope2_location_t", "scope2_market_t", "scope3_t", "total_t", "gj_per_turnover", "renewable_share_pct")
    out = rounded(rounded(X.esg_disclosure(c), 10, *cols[:5]), 7, *cols[5:])
    return out.select("plant_id", "year", *cols)


@query("composite_score", """SELECT p_partkey AS site, CAST(trunc(round((0.25 * (p_size % 101) + 0.20 * (p_partkey % 97) + 0.20 * (p_partkey % 89) + 0.15 * (p_size % 61)
  + 0.10 * (p_partkey % 71) + 0.10 * (p_partkey % 53)) * 10, 6)) AS INTEGER) AS score FROM part""")
def composite_score(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    sites = part.select(
        k.alias("site"), (s % 101).alias("efficiency"), (k % 97).alias("carbon"), (k % 89).alias("financial"),
        (s % 61).alias("renewable"), (k % 71).alias("compliance"), (k % 53).alias("operational"),
    )
    return X.composite_score(sites).select("site", "score")


def _assets(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("asset"), F.when(F.col("p_size") % 3 == 0, "nmc").otherwise("lfp").alias("chemistry"),
        F.col("p_retailprice").alias("capacity_kwh"), (0.5 + F.col("p_size") % 3 * 0.5).alias("daily_cycles"),
        (0.5 + F.col("p_size") % 5 / 10.0).alias("dod"), (20.0 + F.col("p_size") % 25).alias("temp_c"),
    )


FADE_SQL = """a AS (SELECT p_partkey AS asset, p_size % 3 = 0 AS nmc, p_retailprice AS cap, 0.5 + p_size % 3 * 0.5 AS cyc, 0.5 + (p_size % 5) / 10.0::DOUBLE AS dod, 20.0 + p_size % 25 AS t FROM part),
y AS (SELECT *, unnest(range(1, 11)) AS year FROM a),
f AS (SELECT asset, CAST(year AS INTEGER) AS year, cap,
  CASE WHEN nmc THEN 0.022 ELSE 0.012 END * exp(-CASE WHEN nmc THEN 35000 ELSE 28000 END / (8.314 * (t + 273.15))) * 1e4 * sqrt(year) AS cal,
  CASE WHEN nmc THEN 0.00035 ELSE 0.00018 END * power(dod, CASE WHEN nmc THEN 1.30 ELSE 1.15 END) * power(cyc * 365 * year, CASE WHEN nmc THEN 0.90 ELSE 0.85 END) AS cy FROM y),
fade AS (SELECT *, greatest(0.40, round(1 - (cal + cy), 4)) AS soh FROM f)"""


@query("capacity_fade", f"WITH {FADE_SQL} SELECT asset, year, soh, round(cap * soh, 6) AS retained_kwh, round(cal, 6) AS calendar_loss, round(cy, 6) AS cycle_loss FROM fade")
def capacity_fade(spark, sf_dir):
    out = X.capacity_fade(_assets(spark, sf_dir), dims.battery_chemistries(spark))
    out = rounded(out, 6, "calendar_loss", "cycle_loss", "retained_kwh")
    return out.select("asset", "year", "soh", "retained_kwh", "calendar_loss", "cycle_loss")


@query("end_of_life", f"WITH {FADE_SQL} SELECT asset, coalesce(min(year) FILTER (WHERE soh <= 0.80), 10) AS eol_year, min(soh) AS final_soh FROM fade GROUP BY asset")
def end_of_life(spark, sf_dir):
    return X.end_of_life(X.capacity_fade(_assets(spark, sf_dir), dims.battery_chemistries(spark)), ["asset"])


@query("scenario_economics", f"""WITH {PLANTS}, {FACTORS}, s AS (SELECT plant_id, year, solar_kw, coalesce(grid_factor, 0.73) AS g, annual_kwh / 12 AS m, 30.0 AS temp, 100.0 AS store, 15.0 AS shift
  FROM plants LEFT JOIN factors USING (region) CROSS JOIN (VALUES (0.0), (150.0), (300.0)) v(solar_kw)),
e AS (SELECT *, solar_kw * 4.5 * (1 - greatest(0, (temp - 25) * 0.0038)) * 30 AS sol, store * 0.85 * 30 AS sto, m * shift / 100 * 0.4 AS shifted, solar_kw * 45000 + store * 18000 AS capex FROM s),
f AS (SELECT *, (sol * 11.5 + sto * (11.5 - 6.2) + shifted * (11.5 - 6.2)) * 12 AS annual FROM e)
SELECT plant_id, year, solar_kw::DOUBLE AS solar_kw, round(annual, 6) AS annual_savings, round(capex / greatest(1, annual), 7) AS payback_years, round((sol + sto) * g * 12 / 1000, 8) AS co2_saved_t,
  round(greatest(0, m - sol), 6) AS net_kwh, round(greatest(0, m * 12 * g / 1000 - (sol + sto) * g * 12 / 1000), 8) AS scope2_market_t FROM f""")
def scenario_economics(spark, sf_dir):
    from gridloom.operators.joins import fan_out

    sites = plants(spark, sf_dir).select(
        "plant_id", "year", "region", (F.col("annual_kwh") / 12).alias("monthly_kwh"), F.lit(30.0).alias("temp_c"),
        F.lit(100.0).alias("storage_kwh"), F.lit(15.0).alias("shift_pct"),
    )
    out = X.scenario_economics(fan_out(sites, {"solar_kw": [0.0, 150.0, 300.0]}), dims.grid_factors(spark))
    out = rounded(rounded(out, 6, "annual_savings", "net_kwh"), 7, "payback_years")
    out = rounded(out, 8, "co2_saved_t", "scope2_market_t")
    return out.select("plant_id", "year", "solar_kw", "annual_savings", "payback_years", "co2_saved_t", "net_kwh", "scope2_market_t")


def _projects(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("project"), (s * 10.0).alias("solar_kw"), (s * 4.0).alias("battery_kwh"),
        (s * 13000.0).alias("generated_kwh"), (s * 11000.0 + F.col("p_retailprice")).alias("consumed_kwh"),
        (s * 1.0 + F.col("p_partkey") % 7).alias("peak_reduction_kw"),
    )


@query("cashflow", """WITH p AS (SELECT p_partkey AS project, p_size * 10.0 AS kw, p_size * 4.0 AS bat, p_size * 13000.0 AS gen, p_size * 11000.0 + p_retailprice AS con, p_size * 1.0 + p_partkey % 7 AS pk FROM part),
d(year, w) AS (VALUES (1, 0.2), (2, 0.32), (3, 0.192), (4, 0.1152), (5, 0.1152), (6, 0.0576)),
y AS (SELECT p.*, kw * 850 + bat * 450 AS capex, t.year, coalesce(w, 0)::DOUBLE AS w FROM p CROSS JOIN (SELECT unnest(range(1, 21)) AS year) t LEFT JOIN d ON d.year = t.year),
c AS (SELECT *, (kw * 15 + bat * 10) * power(1.015, year - 1) + CASE WHEN year = 10 THEN 10000 * power(1.025, 9) ELSE 0 END AS cost,
  con * power(0.995, year - 1) * 0.13 * power(1.025, year - 1) + pk * 15 * 12 * power(1.025, year - 1) AS income, gen * power(0.995, year - 1) AS g FROM y),
f AS (SELECT *, income - cost + capex * w * 0.21 AS cash FROM c),
r AS (SELECT *, sum(cash) OVER (PARTITION BY project ORDER BY year) - capex AS run FROM f)
SELECT project, any_value(capex)::DOUBLE AS capex, round(sum(cash / power(1.08, year)) - any_value(capex), 3) AS npv,
  round((any_value(capex) + sum(cost / power(1.08, year))) / sum(g / power(1.08, year)), 6) AS lcoe,
  round(coalesce(min_by(year - 1 + (cash - run) / cash, year) FILTER (WHERE run >= 0), 20), 5) AS payback_years FROM r GROUP BY project""")
def cashflow(spark, sf_dir):
    out = X.cashflow(_projects(spark, sf_dir), dims.tax_depreciation(spark))
    return rounded(rounded(rounded(out, 3, "npv"), 6, "lcoe"), 5, "payback_years")


@query("quick_roi", """WITH p AS (SELECT p_partkey AS project, p_size * 10.0::DOUBLE AS kw, p_size * 4.0::DOUBLE * (p_partkey % 5) AS bat FROM part),
s AS (SELECT *, kw * 1320 AS gen, 0.60 + least(0.28, CASE WHEN kw > 0 THEN bat / (kw * 4) ELSE 0 END * 0.5) AS use, kw * 850 + bat * 450 AS capex FROM p)
SELECT project, round(gen * use * 0.13, 4) AS annual_savings, round(CASE WHEN gen * use > 0 THEN capex / (gen * use * 0.13) ELSE 0 END, 6) AS payback_years, round(gen * 0.35, 4) AS co2_kg FROM s""")
def quick_roi(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("project"), (F.col("p_size") * 10.0).alias("solar_kw"),
        (F.col("p_size") * 4.0 * (F.col("p_partkey") % 5)).alias("battery_kwh"),
    )
    out = rounded(rounded(X.quick_roi(p), 4, "annual_savings", "co2_kg"), 6, "payback_years")
    return out.select("project", "annual_savings", "payback_years", "co2_kg")


# --- anomaly rules, power quality, alerts, messages -----------------------------------------

QUALITY_SQL = """q AS (SELECT typed.*, round(greatest(0.5, least(15.0, 1.5 + 5 * (reactive_lagging_kvarh / (usage_kwh + 1)))), 2) AS thd,
  round(415 - 15 * (usage_kwh / (max(usage_kwh) OVER (PARTITION BY meter_id) + 1)), 1) AS v FROM typed)"""


@query("power_quality_proxy", f"WITH {READINGS}, {LOAD_TYPED}, {QUALITY_SQL} SELECT reading_id, thd AS thd_pct, v AS voltage_v FROM q")
def power_quality_proxy(spark, sf_dir):
    return E.power_quality_proxy(readings(spark, sf_dir), KEYS).select("reading_id", "thd_pct", "voltage_v")


RULES_SQL = """cls AS (SELECT reading_id, q.meter_id, usage_kwh, CASE WHEN usage_kwh > spike_threshold THEN 'Critical Power Spike' WHEN vm < 390 THEN 'Voltage Sag' WHEN vm > 430 THEN 'Voltage Swell'
  WHEN thd > 8 THEN 'Harmonic Distortion Spike' WHEN load_type LIKE '%Light%' AND usage_kwh > leak_threshold THEN 'Idle Energy Leak'
  WHEN isodow(ts) >= 6 AND load_type LIKE '%Light%' AND usage_kwh > mean_all + 0.5 * std_all THEN 'Weekend Energy Leak'
  WHEN power_factor_lagging < 45 AND usage_kwh > 10 THEN 'Machinery Idling' ELSE 'Unspecified Outlier' END AS anomaly_type
  FROM (SELECT *, 380 + reactive_lagging_kvarh * 0.6 AS vm FROM q) q JOIN thr USING (meter_id))"""


def classified(spark, sf_dir):
    """Voltage is taken as measured, so that all rules can fire."""
    from gridloom.operators.cleaning import calendar_features

    rows = typed(spark, sf_dir).withColumn("voltage_v", 380 + F.col("reactive_lagging_kvarh") * 0.6)
    rows = calendar_features(E.power_quality_proxy(rows, KEYS))
    return E.classify_anomaly(rows, A.baseline_thresholds(typed(spark, sf_dir), KEYS), KEYS)


@query("classify_anomaly", f"""WITH {READINGS}, {LOAD_TYPED}, {QUALITY_SQL}, {RULES_SQL}
SELECT reading_id, anomaly_type, CASE WHEN anomaly_type = 'Critical Power Spike' THEN 'Critical'
  WHEN anomaly_type IN ('Voltage Sag', 'Voltage Swell', 'Harmonic Distortion Spike', 'Weekend Energy Leak') THEN 'High' ELSE 'Medium' END AS severity FROM cls""")
def classify_anomaly(spark, sf_dir):
    return classified(spark, sf_dir).select("reading_id", "anomaly_type", "severity")


@query("leak_totals", f"""WITH {READINGS}, {LOAD_TYPED}, {QUALITY_SQL}, {RULES_SQL}
SELECT meter_id, anomaly_type, count(*) AS events, round(sum(usage_kwh), 4) AS leak_kwh FROM cls
WHERE anomaly_type IN ('Idle Energy Leak', 'Weekend Energy Leak', 'Machinery Idling') GROUP BY ALL""")
def leak_totals(spark, sf_dir):
    return rounded(A.leak_totals(classified(spark, sf_dir), KEYS), 4, "leak_kwh")


@query("threshold_alerts", """WITH m AS (SELECT event_id AS reading_id, 40 + value AS t, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS pf,
  100.0::DOUBLE AS r, 100.0::DOUBLE + value / 10 AS y, 100.0::DOUBLE - value / 20 AS b FROM events),
i AS (SELECT *, 100 * greatest(abs(r - (r + y + b) / 3), abs(y - (r + y + b) / 3), abs(b - (r + y + b) / 3)) / ((r + y + b) / 3) AS im FROM m)
SELECT reading_id, 'Thermal Overload' AS alert_type, round(t, 6) AS value, 85.0::DOUBLE AS limit_value, 'CRITICAL' AS severity FROM i WHERE t > 85
UNION ALL SELECT reading_id, 'Power Factor Drop', round(pf, 6), 0.9, 'HIGH' FROM i WHERE pf < 0.9
UNION ALL SELECT reading_id, 'Phase Imbalance', round(im, 6), 5.0, 'MEDIUM' FROM i WHERE im > 5""")
def threshold_alerts(spark, sf_dir):
    out = E.threshold_alerts(live_readings(readings(spark, sf_dir)), dims.alert_limits(spark), ["reading_id"])
    return rounded(out, 6, "value").select("reading_id", "alert_type", "value", "limit_value", "severity")


def live_readings(r):
    return r.select(
        "reading_id", "meter_id", "ts", (40 + F.col("usage_kwh")).alias("transformer_temp_c"),
        (F.col("reactive_lagging_kvarh") / 100).alias("power_factor"), F.lit(100.0).alias("current_r"),
        (100.0 + F.col("usage_kwh") / 10).alias("current_y"), (100.0 - F.col("usage_kwh") / 20).alias("current_b"),
    )


# --- start hours ----------------------------------------------------------------------------

TASKS_SQL = "tasks AS (SELECT p_partkey AS task_id, p_retailprice / 10 AS load_kw, CAST(1 + p_size % 24 AS INTEGER) AS duration_h, p_size::DOUBLE AS solar_kw FROM part)"
HOURS_SQL = "hrs AS (SELECT task_id, load_kw, solar_kw, CAST(s AS INTEGER) AS start_hour, CAST((s + unnest(range(0, duration_h))) % 24 AS INTEGER) AS hour FROM tasks CROSS JOIN (SELECT unnest(range(0, 24)) AS s) t)"
COST_SQL = """n AS (SELECT hrs.*, tariff, carbon_g, greatest(0, load_kw - solar_factor * 100 * 0.12 * (solar_kw / 100)) AS net, greatest(0, load_kw * sqrt(1 - 0.8 * 0.8) / 0.8 - 50) AS q FROM hrs JOIN curve USING (hour)),
pf AS (SELECT *, CASE WHEN net > 0 AND q > 0 THEN net / sqrt(net * net + q * q) ELSE 1 END AS pfn FROM n),
hc AS (SELECT *, net * tariff * CASE WHEN pfn < 0.9 THEN 1 + 2 * (0.9 - pfn) ELSE 1 END AS cost, net * carbon_g / 1000 AS kg FROM pf),
cand AS (SELECT task_id, start_hour, sum(cost) AS cost, sum(kg) AS kg, round(sum(cost) + sum(kg) * 0.15, 9) AS score FROM hc GROUP BY ALL),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY score, start_hour) = 1)"""


@query("run_hours", f"WITH {TASKS_SQL}, {HOURS_SQL} SELECT start_hour, hour, count(*) AS n, round(sum(load_kw), 3) AS kw FROM hrs GROUP BY ALL")
def run_hours(spark, sf_dir):
    return S.run_hours(tasks(spark, sf_dir)).groupBy("start_hour", "hour").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("load_kw"), 3).alias("kw")
    )


@query("hourly_cost", f"""WITH {TASKS_SQL}, {HOURS_SQL}, {CURVE}, {COST_SQL}
SELECT start_hour, hour, count(*) AS n, round(sum(net), 4) AS net_draw, round(sum(cost), 4) AS cost, round(sum(kg), 4) AS carbon_kg, round(min(pfn), 8) AS worst_pf FROM hc GROUP BY ALL""")
def hourly_cost(spark, sf_dir):
    """The hourly table of all candidates, totalled by start and clock hour."""
    out = S.hourly_cost(tasks(spark, sf_dir), dims.hour_curve(spark)).groupBy("start_hour", "hour").agg(
        F.count(F.lit(1)).alias("n"), F.sum("net_draw").alias("net_draw"), F.sum("cost").alias("cost"),
        F.sum("carbon_kg").alias("carbon_kg"), F.min("pf_net").alias("worst_pf"),
    )
    return rounded(rounded(out, 4, "net_draw", "cost", "carbon_kg"), 8, "worst_pf")


@query("best_start", f"WITH {TASKS_SQL}, {HOURS_SQL}, {CURVE}, {COST_SQL} SELECT task_id, start_hour, round(score, 6) AS score, round(cost, 6) AS cost, round(kg, 6) AS carbon_kg FROM best")
def best_start(spark, sf_dir):
    return rounded(S.best_start(S.hourly_cost(tasks(spark, sf_dir), dims.hour_curve(spark))), 6, "score", "cost", "carbon_kg")


@query("savings_vs_baseline", f"""WITH {TASKS_SQL}, {HOURS_SQL}, {CURVE}, {COST_SQL}
SELECT b.task_id, b.start_hour AS best_start_hour, round(b.cost, 6) AS best_cost, round(n9.cost, 6) AS base_cost, round(greatest(0, n9.cost - b.cost), 6) AS cost_saved,
  round(greatest(0, n9.kg - b.kg), 6) AS carbon_saved_kg, round(CASE WHEN n9.cost > 0 THEN greatest(0, (n9.cost - b.cost) / n9.cost * 100) ELSE 0 END, 6) AS cost_saved_pct
FROM best b JOIN cand n9 ON n9.task_id = b.task_id AND n9.start_hour = 9""")
def savings_vs_baseline(spark, sf_dir):
    out = S.savings_vs_baseline(S.hourly_cost(tasks(spark, sf_dir), dims.hour_curve(spark)))
    cols = ("best_cost", "base_cost", "cost_saved", "carbon_saved_kg", "cost_saved_pct")
    return rounded(out, 6, *cols).select("task_id", "best_start_hour", *cols)


@query("best_start_measured_solar", f"""WITH {READINGS}, {TASKS_SQL}, {HOURS_SQL}, {CURVE},
sol AS (SELECT hour(ts) AS hour, avg(reactive_lagging_kvarh) / 10 AS y FROM readings GROUP BY 1),
{COST_SQL.replace('hrs JOIN curve USING (hour)', 'hrs JOIN curve USING (hour) JOIN sol USING (hour)').replace('solar_factor * 100 * 0.12 * (solar_kw / 100)', 'y * (solar_kw / 100)')}
SELECT task_id, start_hour, round(score, 6) AS score FROM best""")
def best_start_measured_solar(spark, sf_dir):
    """The solar profile is the mean by clock hour of a measured column (24 rows)."""
    r = readings(spark, sf_dir).withColumn("solar_kwh", F.col("reactive_lagging_kvarh") / 10)
    solar = A.hour_profile(r, [], cols=("solar_kwh",))
    out = S.best_start(S.hourly_cost(tasks(spark, sf_dir), dims.hour_curve(spark), solar))
    return rounded(out, 6, "score").select("task_id", "start_hour", "score")
