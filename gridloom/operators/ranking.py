"""Recent rows, first rows, top-k, argmin and alert triage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.dims import SEVERITY_RANK
from gridloom.operators.series import time_slot

def recent_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, slot: Column | None = None) -> DataFrame:
    """The last n rows per key.

    Row counts per time slot rule out all slots that end before the last n rows, so only
    about n rows per key are sorted and shuffled.
    """
    slot = time_slot(order[0]) if slot is None else slot
    late = Window.partitionBy(*keys).orderBy(F.col("_slot").desc())
    counts = df.groupBy(*keys, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_c"))
    newer = F.coalesce(F.sum("_c").over(late.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keep = counts.withColumn("_newer", newer).filter(F.col("_newer") < n).select(*keys, "_slot")
    df = df.withColumn("_slot", slot).join(keep, [*keys, "_slot"], "left_semi").drop("_slot")
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def recent_rows_overall(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank="rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def argmin_candidate(df: DataFrame, keys: Sequence[str], score: str, order: str) -> DataFrame:
    """The row with the lowest score; among equals the first candidate.

    A min over structs: partial results combine before the shuffle.
    """
    rest = [c for c in df.columns if c not in {*keys, score, order}]
    best = df.groupBy(*keys).agg(F.min(F.struct(score, order, *rest)).alias("_b"))
    return best.select(*keys, "_b.*")


def best_model(errors: DataFrame, keys: Sequence[str] = (), measure="rmse") -> DataFrame:
    return errors.groupBy(*keys).agg(
        F.min(F.struct(measure, "model")).alias("_b")
    ).select(*keys, F.col("_b.model").alias("best_model"), F.col(f"_b.{measure}").alias(measure))


def severity_rank(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    out = F.lit(0)
    for name, rank in reversed(SEVERITY_RANK):
        out = F.when(F.upper(col) == name, rank).otherwise(out)
    return out


def triage_alerts(alerts: DataFrame, sites: DataFrame, site="site", order="alert_id") -> DataFrame:
    """Per site the most severe open alert (earliest first) and the site's risk level."""
    open_alerts = alerts.filter(F.col("status").isin("TRIGGERED", "ACKNOWLEDGED"))
    tier = F.least(F.greatest(severity_rank("severity"), F.lit(1)), F.lit(3))
    rest = [c for c in alerts.columns if c not in {site, order}]
    best = open_alerts.withColumn("_t", -tier).groupBy(site).agg(
        F.min(F.struct("_t", order, *rest)).alias("_b"), F.count(F.lit(1)).alias("active_alerts")
    )
    risk = (
        F.when(F.col("_b._t") == -3, "CRITICAL").when(F.col("_b._t") == -2, "HIGH")
        .when(F.col("_b").isNotNull(), "MEDIUM").otherwise("LOW")
    )
    return sites.select(site).distinct().join(best, site, "left").select(
        site, risk.alias("risk"), F.coalesce("active_alerts", F.lit(0)).alias("active_alerts"),
        F.coalesce("_b.alert_type", F.lit("Normal Operations")).alias("alert_type"),
        F.col(f"_b.{order}").alias(order),
    )
