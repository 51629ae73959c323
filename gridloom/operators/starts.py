"""Start-hour choice for heavy jobs: every candidate priced, the cheapest kept.

Work grows with the number of jobs: each has 24 candidates of at most 24 hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.physics import net_power_factor, pf_cost_multiplier, reactive_power
from gridloom.operators.ranking import argmin_candidate

BASE_HOUR = 9
JOBS_PER_TASK = 5_000  # each makes up to 24 x 24 hours


def dealt_jobs(tasks: DataFrame, task="task_id") -> DataFrame:
    """The jobs dealt by their key to as many tasks as their number asks for.

    The few columns of the jobs are shuffled, not the hundreds of hours that each becomes:
    totals per job and start hour need no other shuffle, and their groups per task are bounded.
    Rows that repeat a key meet in one task and stream into the key's 24 groups.
    """
    return tasks.repartition(max(1, -(-tasks.count() // JOBS_PER_TASK)), task)


def run_hours(tasks: DataFrame, task="task_id") -> DataFrame:
    """(job, start_hour, hour) for each start hour and each hour the job then runs."""
    starts = dealt_jobs(tasks, task).withColumn("start_hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    step = F.explode(F.sequence(F.lit(0), F.col("duration_h") - 1))
    return starts.withColumn("_k", step).withColumn(
        "hour", F.pmod(F.col("start_hour") + F.col("_k"), F.lit(24))
    ).drop("_k")


def hourly_cost(
    tasks: DataFrame, curve: DataFrame, solar: DataFrame | None = None,
    pf=0.80, pf_penalty=2.0, bank_kvar=50.0, yield_coeff=0.12, task="task_id",
) -> DataFrame:
    """Net draw, cost and carbon of each candidate hour.

    ``solar``: 24-row table (hour, solar_kwh) of the yield of 100 kW; the clear-sky curve
    of ``curve`` serves where none is given.  It joins the 24 rows of the curve, which are
    broadcast: candidate hours are never shuffled by their hour.
    """
    day = curve.select("hour", "tariff", "carbon_g", "solar_factor")
    base = F.col("solar_factor") * 100.0 * 0.12
    if solar is not None:
        day = day.join(solar.select("hour", "solar_kwh"), "hour", "left")
        base = F.coalesce("solar_kwh", F.lit(0.0))
    out = run_hours(tasks, task).join(F.broadcast(day), "hour")
    gen = base * (F.col("solar_kw") / 100.0) * (yield_coeff / 0.12)
    q = F.greatest(F.lit(0.0), reactive_power(F.col("load_kw"), F.lit(pf)) - bank_kvar)
    out = out.withColumn("solar_gen", gen).withColumn(
        "net_draw", F.greatest(F.lit(0.0), F.col("load_kw") - F.col("solar_gen"))
    ).withColumn("pf_net", net_power_factor(F.col("net_draw"), q))
    return out.withColumns({
        "cost": F.col("net_draw") * F.col("tariff") * pf_cost_multiplier(F.col("pf_net"), F.lit(pf_penalty)),
        "carbon_kg": F.col("net_draw") * F.col("carbon_g") / 1000.0,
    })


def candidate_scores(hourly: DataFrame, task="task_id", weight=0.15) -> DataFrame:
    """Totals per (job, start hour); scores are compared to 9 decimals so that equal
    candidates tie whatever the order of addition."""
    per = hourly.groupBy(task, "start_hour").agg(F.sum("cost").alias("cost"), F.sum("carbon_kg").alias("carbon_kg"))
    return per.withColumn("score", F.round(F.col("cost") + F.col("carbon_kg") * weight, 9))


def best_start(hourly: DataFrame, task="task_id", weight=0.15) -> DataFrame:
    return argmin_candidate(candidate_scores(hourly, task, weight), [task], "score", "start_hour")


def savings_vs_baseline(hourly: DataFrame, task="task_id", weight=0.15, base_hour=BASE_HOUR) -> DataFrame:
    """Best start against starting at the base hour; one aggregation, no self-join."""
    scored = candidate_scores(hourly, task, weight)
    at_base = F.col("start_hour") == base_hour
    out = scored.groupBy(task).agg(
        F.min(F.struct("score", "start_hour", "cost", "carbon_kg")).alias("_b"),
        F.max(F.when(at_base, F.col("cost"))).alias("base_cost"),
        F.max(F.when(at_base, F.col("carbon_kg"))).alias("base_carbon_kg"),
    )
    floor0 = lambda c: F.greatest(F.lit(0.0), c)
    dc, dk = F.col("base_cost") - F.col("_b.cost"), F.col("base_carbon_kg") - F.col("_b.carbon_kg")
    return out.select(
        task, F.col("_b.start_hour").alias("best_start_hour"), F.col("_b.cost").alias("best_cost"),
        F.col("_b.carbon_kg").alias("best_carbon_kg"), "base_cost", "base_carbon_kg",
        floor0(dc).alias("cost_saved"), floor0(dk).alias("carbon_saved_kg"),
        F.when(F.col("base_cost") > 0, floor0(dc / F.col("base_cost") * 100.0)).otherwise(0.0).alias("cost_saved_pct"),
        F.when(F.col("base_carbon_kg") > 0, floor0(dk / F.col("base_carbon_kg") * 100.0)).otherwise(0.0).alias("carbon_saved_pct"),
    )
