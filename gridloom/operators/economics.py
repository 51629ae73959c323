"""Sites, assets, bills and projects as tables: compliance, savings, fade, cash flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import dims
from gridloom.operators.joins import join_dim
from gridloom.operators.windows import cumulative_payback


def bill_charges(bills: DataFrame, tariffs: DataFrame, utility="utility") -> DataFrame:
    """Energy, demand, power-factor and peak charges; ``peak_kwh`` defaults to a quarter."""
    cols = ["base_rate", "peak_surcharge", "demand_rate", "pf_penalty_pct"]
    default = dict(zip(
        ["base_rate", "peak_surcharge", "offpeak_rebate", "demand_rate", "pf_penalty_pct"],
        dims.UTILITY_TARIFFS[0][1:6],
    ))
    out = join_dim(bills, tariffs.select("utility", *cols).withColumnRenamed("utility", utility), utility,
                   {c: default[c] for c in cols})
    peak = F.col("peak_kwh") if "peak_kwh" in bills.columns else F.col("kwh") * 0.25
    out = out.withColumns({
        "energy_charge": F.col("kwh") * F.col("base_rate"),
        "demand_charge": F.col("demand_kva") * F.col("demand_rate"),
        "peak_charge": peak * F.col("peak_surcharge"),
    }).withColumn(
        "pf_charge",
        F.when(
            F.col("pf") < 0.90,
            F.col("energy_charge") * ((0.90 - F.col("pf")) * 100.0 * F.col("pf_penalty_pct") / 100.0),
        ).otherwise(0.0),
    )
    total = F.col("energy_charge") + F.col("demand_charge") + F.col("pf_charge") + F.col("peak_charge")
    return out.withColumn("total_charge", total).drop(*cols)


def sec_compliance(sites: DataFrame, norms: DataFrame) -> DataFrame:
    """Specific energy against the sector norm, certificates or penalty.

    A site whose sector has no norm is rated by the per-kg rule and norm; production of
    zero or less counts as one ton.
    """
    first = dims.SECTOR_NORMS[0]
    known = F.col("sector").isin("Steel", "Cement")
    out = join_dim(sites, norms, "sector",
                   {"baseline_sec": dims.SECTOR_NORMS[2][1], "target_sec": dims.SECTOR_NORMS[2][2], "sec_unit": "MJ/kg"})
    tons = F.when(F.col("production_t") > 0, F.col("production_t")).otherwise(1.0)
    thermal = F.col("thermal_toe") if "thermal_toe" in sites.columns else F.lit(0.0)
    actual = (
        F.when(F.col("sector") == first[0], (F.col("annual_kwh") / dims.KWH_PER_TOE + thermal) / tons)
        .when(F.col("sector") == "Cement", F.col("annual_kwh") / tons)
        .otherwise(F.col("annual_kwh") * 3.6 / (tons * 1000.0))
    )
    out = out.withColumn("actual_sec", actual)
    gap = F.col("target_sec") - F.col("actual_sec")
    gap_toe = (
        F.when(F.col("sector") == first[0], gap)
        .when(F.col("sector") == "Cement", gap / dims.KWH_PER_TOE)
        .otherwise(gap * 0.277778 / dims.KWH_PER_TOE)
    ) * tons
    surplus = F.col("gap_toe") > 0
    return out.withColumn("gap_toe", gap_toe).withColumns({
        "reduction_pct": F.greatest(
            F.lit(0.0), (F.col("baseline_sec") - F.col("actual_sec")) / F.col("baseline_sec") * 100.0
        ),
        "certificates": F.when(surplus, F.col("gap_toe")).otherwise(0.0),
        "certificate_value": F.when(surplus, F.col("gap_toe") * dims.CERTIFICATE_PRICE).otherwise(0.0),
        "penalty": F.when(surplus, 0.0).otherwise(F.abs("gap_toe") * dims.PENALTY_PER_TOE),
        "status": F.when(surplus, "Surplus").when(F.col("actual_sec") > F.col("target_sec"), "Shortfall").otherwise("Compliant"),
        "norm_known": known | (F.col("sector") == "Textile"),
    })


def enpi(sites: DataFrame) -> DataFrame:
    expected = F.col("baseline_kwh") * (1.0 + 0.0005 * F.col("hdd") + 0.0008 * F.col("cdd"))
    gain = (F.col("expected_kwh") - F.col("actual_kwh")) / F.greatest(F.lit(1.0), F.col("expected_kwh")) * 100.0
    return sites.withColumn("expected_kwh", expected).withColumns({
        "savings_kwh": F.greatest(F.lit(0.0), F.col("expected_kwh") - F.col("actual_kwh")),
        "improvement_pct": gain,
        "conformance": F.when(gain >= 0, "Conforming").otherwise("Action Required"),
    })


def esg_disclosure(companies: DataFrame) -> DataFrame:
    """Scopes, energy and intensities from kWh, renewable kWh, diesel litres and turnover."""
    kwh, ren, fuel, turnover = (F.col(c) for c in ("kwh", "renewable_kwh", "diesel_l", "turnover"))
    grid = F.greatest(F.lit(0.0), kwh - ren)
    out = companies.withColumns({
        "scope1_t": fuel * 2.68 / 1000.0,
        "scope2_location_t": grid * 0.73 / 1000.0,
        "scope2_market_t": grid * 0.71 / 1000.0,
        "scope3_t": kwh * 0.085 * 0.73 / 1000.0,
        "energy_gj": kwh * 0.0036 + fuel * 0.038,
        "renewable_share_pct": 100.0 * ren / F.greatest(F.lit(1.0), kwh),
    })
    out = out.withColumn("total_t", F.col("scope1_t") + F.col("scope2_location_t") + F.col("scope3_t"))
    per = F.greatest(F.lit(1.0), turnover)
    return out.withColumn("gj_per_turnover", F.col("energy_gj") / per).withColumn("t_per_turnover", F.col("total_t") / per)


# --- Fixed values: weights of the composite score -------------------------------------
SCORE_WEIGHTS = {
    "efficiency": 0.25, "carbon": 0.20, "financial": 0.20, "renewable": 0.15, "compliance": 0.10, "operational": 0.10,
}
# --- End of fixed values ------------------------------------------------------------


def composite_score(sites: DataFrame) -> DataFrame:
    """Weighted factors of 0..100 on a scale of 0..1000, truncated."""
    total = sum((F.col(c) * w for c, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    return sites.withColumn("score", (F.round(total * 10, 6)).cast("int"))


def capacity_fade(assets: DataFrame, chemistries: DataFrame, years=10) -> DataFrame:
    """One row per asset and year; an unknown chemistry ages like the second one."""
    second = dims.BATTERY_CHEMISTRIES[1]
    names = ["b_cal", "b_cyc", "dod_exp", "cycle_exp", "activation"]
    out = join_dim(assets.withColumn("chemistry", F.upper("chemistry")), chemistries, "chemistry",
                   dict(zip(names, second[1:])))
    out = out.withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(years))))
    calendar = (
        F.col("b_cal") * (F.exp(-F.col("activation") / (8.314 * (F.col("temp_c") + 273.15))) * 1e4)
        * F.sqrt(F.col("year").cast("double"))
    )
    cycles = F.col("daily_cycles") * 365.0 * F.col("year")
    cycling = F.col("b_cyc") * F.pow(F.col("dod"), F.col("dod_exp")) * F.pow(cycles, F.col("cycle_exp"))
    return out.withColumns({"calendar_loss": calendar, "cycle_loss": cycling}).withColumn(
        "soh", F.greatest(F.lit(0.40), F.round(1.0 - (F.col("calendar_loss") + F.col("cycle_loss")), 4))
    ).withColumn("retained_kwh", F.col("capacity_kwh") * F.col("soh")).drop(*names)


def end_of_life(fade: DataFrame, keys: Sequence[str], years=10, limit=0.80) -> DataFrame:
    first = F.min(F.when(F.col("soh") <= limit, F.col("year")))
    return fade.groupBy(*keys).agg(F.coalesce(first, F.lit(years)).alias("eol_year"), F.min("soh").alias("final_soh"))


def scenario_economics(sites: DataFrame, factors: DataFrame) -> DataFrame:
    """Savings, outlay, payback and carbon of a solar/storage/shift scenario per row.

    Needs region, monthly_kwh, solar_kw, storage_kwh, shift_pct and temp_c.
    """
    peak, off = 11.50, 6.20
    out = join_dim(sites, factors, "region", {"grid_factor": dims.NATIONAL_GRID_FACTOR})
    out = out.withColumns({
        "solar_kwh": F.col("solar_kw") * (4.5 * (1.0 - F.greatest(F.lit(0.0), (F.col("temp_c") - 25.0) * 0.0038))) * 30.0,
        "storage_shaved_kwh": F.col("storage_kwh") * 0.85 * 30.0,
        "shifted_kwh": F.col("monthly_kwh") * (F.col("shift_pct") / 100.0) * 0.4,
        "capex": F.col("solar_kw") * 45000.0 + F.col("storage_kwh") * 18000.0,
    })
    monthly = (
        F.col("solar_kwh") * peak + F.col("storage_shaved_kwh") * (peak - off) + F.col("shifted_kwh") * (peak - off)
    )
    out = out.withColumn("annual_savings", monthly * 12.0)
    saved = (F.col("solar_kwh") + F.col("storage_shaved_kwh")) * F.col("grid_factor") * 12.0 / 1000.0
    return out.withColumns({
        "payback_years": F.when(
            F.col("capex") > 0, F.col("capex") / F.greatest(F.lit(1.0), F.col("annual_savings"))
        ).otherwise(0.0),
        "co2_saved_t": saved,
        "net_kwh": F.greatest(F.lit(0.0), F.col("monthly_kwh") - F.col("solar_kwh")),
        "scope2_location_t": F.col("monthly_kwh") * 12.0 * F.col("grid_factor") / 1000.0,
    }).withColumn(
        "scope2_market_t", F.greatest(F.lit(0.0), F.col("scope2_location_t") - F.col("co2_saved_t"))
    )


def cash_flows(projects: DataFrame, depreciation: DataFrame, years=20) -> DataFrame:
    """One row per project and year.

    Needs project, solar_kw, battery_kwh, generated_kwh, consumed_kwh, peak_reduction_kw.
    """
    out = projects.withColumn("capex", F.col("solar_kw") * 850.0 + F.col("battery_kwh") * 450.0)
    out = out.withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(years))))
    out = out.join(F.broadcast(depreciation), "year", "left").fillna(0.0, ["write_off"])
    age = F.col("year") - 1
    worn, dearer = F.pow(F.lit(0.995), age), F.pow(F.lit(1.025), age)
    upkeep = (F.col("solar_kw") * 15.0 + F.col("battery_kwh") * 10.0) * F.pow(F.lit(1.015), age)
    inverter = F.when(F.col("year") == 10, 10000.0 * F.pow(F.lit(1.025), F.lit(9))).otherwise(0.0)
    income = F.col("consumed_kwh") * worn * 0.13 * dearer + F.col("peak_reduction_kw") * 15.0 * 12 * dearer
    return out.withColumns({
        "generated_y": F.col("generated_kwh") * worn,
        "costs_y": upkeep + inverter,
        "cash_flow": income - upkeep - inverter + F.col("capex") * F.col("write_off") * 0.21,
        "discount": F.pow(F.lit(1.08), F.col("year")),
    })


def cashflow(projects: DataFrame, depreciation: DataFrame, project="project", years=20) -> DataFrame:
    """Net present value, cost of energy and payback per project."""
    flows = cash_flows(projects, depreciation, years)
    head = flows.groupBy(project).agg(
        F.first("capex").alias("capex"),
        F.sum(F.col("cash_flow") / F.col("discount")).alias("_pv"),
        F.sum(F.col("costs_y") / F.col("discount")).alias("_costs"),
        F.sum(F.col("generated_y") / F.col("discount")).alias("_gen"),
    )
    pay = cumulative_payback(flows, project, default=float(years))
    return head.join(pay, project).select(
        project, "capex", (F.col("_pv") - F.col("capex")).alias("npv"),
        F.when(F.col("_gen") > 0, (F.col("capex") + F.col("_costs")) / F.col("_gen")).otherwise(0.0).alias("lcoe"),
        "payback_years",
    )


def quick_roi(projects: DataFrame) -> DataFrame:
    gen = F.col("solar_kw") * 1320.0
    ratio = F.when(F.col("solar_kw") > 0, F.col("battery_kwh") / (F.col("solar_kw") * 4.0)).otherwise(0.0)
    out = projects.withColumns({
        "generated_kwh": gen,
        "self_use": 0.60 + F.least(F.lit(0.28), ratio * 0.5),
        "capex": F.col("solar_kw") * 850.0 + F.col("battery_kwh") * 450.0,
        "co2_kg": gen * 350.0 / 1000.0,
    }).withColumn("annual_savings", F.col("generated_kwh") * F.col("self_use") * 0.13)
    pay = F.when(F.col("annual_savings") > 0, F.col("capex") / F.col("annual_savings")).otherwise(0.0)
    return out.withColumn("payback_years", pay)
