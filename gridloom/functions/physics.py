"""Column expressions: solar yield, power factor, harmonics, capacitor sizing, rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def solar_columns(ts: Column, lat_deg: Column, temp_c: Column, cloud: Column) -> dict[str, Column]:
    """Clear-sky irradiance with cloud cover and the yield of 100 kW per 15 minutes."""
    lat = F.radians(lat_deg)
    hours = F.hour(ts) + F.minute(ts) / 60.0
    decl = F.radians(23.45 * F.sin(F.lit(2 * math.pi) * (F.dayofyear(ts) + 284) / 365.0))
    hour_angle = F.radians(15.0 * (hours - 12.0))
    elev = F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.cos(hour_angle)
    air_mass = F.when(elev > 0.05, 1.0 / elev)
    beam = F.coalesce(1361.0 * F.pow(F.lit(0.7), F.pow(air_mass, F.lit(0.678))), F.lit(0.0))
    clear = F.when(elev > 0, beam * elev + 0.15 * beam).otherwise(0.0)
    ghi = clear * (1.0 - 0.75 * cloud * cloud * cloud)
    cell = temp_c + 0.03 * ghi
    watt_hours = F.when(elev > 0, 100.0 * (ghi / 1000.0) * (1.0 - 0.004 * (cell - 25.0))).otherwise(0.0)
    return {"ghi_w_m2": ghi, "solar_pv_yield_kwh": F.greatest(watt_hours * 0.12, F.lit(0.0))}


def reactive_power(active: Column, pf: Column) -> Column:
    return F.when(pf < 1.0, active * F.sqrt(1.0 - pf * pf) / pf).otherwise(0.0)


def net_power_factor(net_draw: Column, net_reactive: Column) -> Column:
    both = (net_draw > 0) & (net_reactive > 0)
    return F.when(both, net_draw / F.sqrt(net_draw * net_draw + net_reactive * net_reactive)).otherwise(1.0)


def pf_cost_multiplier(pf_net: Column, penalty: Column) -> Column:
    return F.when(pf_net < 0.90, 1.0 + penalty * (0.90 - pf_net)).otherwise(1.0)


def harmonics_columns(v_thd: Column, i_thd: Column, kv: Column) -> dict[str, Column]:
    limit = F.when(kv <= 1.0, 8.0).otherwise(5.0)
    return {
        "v_thd_limit": limit,
        "i_thd_limit": F.lit(8.0),
        "v_ok": v_thd <= limit,
        "i_ok": i_thd <= 8.0,
        "overall_ok": (v_thd <= limit) & (i_thd <= 8.0),
    }


def capacitor_columns(kw: Column, pf: Column, target: Column, tariff: Column, cost_per_kvar=1450.0) -> dict:
    pf = F.greatest(F.lit(0.50), F.least(F.lit(0.999), pf))
    goal = F.greatest(pf, F.least(F.lit(0.999), target))
    kvar = kw * (F.tan(F.acos(pf)) - F.tan(F.acos(goal)))
    rated = F.greatest(F.ceil(kvar / 25.0) * 25.0, F.lit(25.0))
    bill = kw * 720.0 * tariff * 0.65
    penalty = F.when(pf < 0.90, bill * (((0.90 - pf) * 100.0 * 1.5) / 100.0)).otherwise(0.0)
    incentive = F.when(
        goal >= 0.95, bill * (F.least(F.lit(7.0), (goal - 0.95) * 100.0) / 100.0)
    ).otherwise(0.0)
    benefit = penalty + incentive
    capex = rated * cost_per_kvar
    return {
        "kvar_exact": kvar,
        "kvar_rated": rated,
        "capex": capex,
        "monthly_penalty": penalty,
        "monthly_incentive": incentive,
        "annual_savings": benefit * 12.0,
        "payback_months": F.when(benefit > 0, capex / F.greatest(F.lit(1.0), benefit)).otherwise(0.0),
    }


def coarsen(col: Column, step=0.5) -> Column:
    """Round to the nearest multiple of ``step``, halves to even."""
    return F.bround(col / F.lit(step)) * F.lit(step)
