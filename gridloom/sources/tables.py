"""Views that read the given star-schema tables as energy telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def power_factor_pct(active: Column, reactive: Column) -> Column:
    apparent = F.sqrt(active * active + reactive * reactive)
    return F.when(apparent > 0, F.lit(100.0) * active / apparent)


def as_readings(events: DataFrame, meter: str) -> DataFrame:
    reactive = F.get_json_object("props", "$.k").try_cast("double")
    return events.select(
        F.col(meter).cast("string").alias("meter_id"),
        F.col("event_id").alias("reading_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("usage_kwh"),
        reactive.alias("reactive_lagging_kvarh"),
        power_factor_pct(F.col("value"), reactive).alias("power_factor_lagging"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few meters with dense series: meter = event type."""
    return as_readings(table(spark, sf_dir, "events"), "event_type")


def readings_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many meters with sparse series: meter = user."""
    return as_readings(table(spark, sf_dir, "events"), "user_id")


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and year with sector, region and yearly production."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    sector = (
        F.when(F.col("c_mktsegment") == "MACHINERY", "Steel")
        .when(F.col("c_mktsegment") == "BUILDING", "Cement")
        .when(F.col("c_mktsegment").isin("HOUSEHOLD", "FURNITURE"), "Textile")
        .otherwise("Other")
    )
    grid = (
        F.when(F.col("r_name") == "AFRICA", "Southern")
        .when(F.col("r_name") == "AMERICA", "Western")
        .when(F.col("r_name") == "ASIA", "Eastern")
        .when(F.col("r_name") == "EUROPE", "Northern")
        .otherwise("Unlisted")
    )
    yearly = orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("annual_kwh"),
        F.count(F.lit(1)).alias("n_orders"),
    )
    sites = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", sector.alias("sector"), grid.alias("region"), "c_acctbal")
    )
    return yearly.join(sites, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("plant_id"), "year", "sector", "region", "annual_kwh",
        (F.col("n_orders") * 1000.0).alias("production_t"), "c_acctbal",
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy jobs to place in the day: one per part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("task_id"),
        (F.col("p_retailprice") / 10.0).alias("load_kw"),
        (F.lit(1) + F.col("p_size") % 24).alias("duration_h"),
        F.col("p_size").cast("double").alias("solar_kw"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with two detectors' answers."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("y_true"), F.col("toxic").alias("pred_a"),
        (F.col("doc_id") % 2).cast("int").alias("pred_b"),
    )
