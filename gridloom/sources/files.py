"""File sources and sinks: CSV, Parquet, JSON side input, append-if-new, replace, exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

READINGS_DDL = (
    "meter_id string, reading_id bigint, ts timestamp, usage_kwh double, reactive_lagging_kvarh double, "
    "reactive_leading_kvarh double, power_factor_lagging double, power_factor_leading double, nsm int, "
    "week_status string, day_of_week string, load_type string, ambient_temperature_c double, cloud_cover double, "
    "voltage_v double, thd_pct double, scope1_co2_kg double, scope2_co2_kg double, scope3_co2_kg double, "
    "co2_tco2 double"
)

# --- Fixed values: column types of the day-chunked table --------------------------------
STORED_DECIMALS = {
    "active_power_kw": "decimal(10,3)", "usage_kwh": "decimal(10,3)",
    "reactive_lagging_kvarh": "decimal(10,3)", "reactive_leading_kvarh": "decimal(10,3)",
    "power_factor": "decimal(5,4)", "grid_voltage_v": "decimal(6,2)",
    "phase_current_r": "decimal(8,2)", "phase_current_y": "decimal(8,2)", "phase_current_b": "decimal(8,2)",
    "transformer_temp_c": "decimal(5,2)",
    "scope1_co2_kg": "decimal(10,4)", "scope2_co2_kg": "decimal(10,4)", "scope3_co2_kg": "decimal(10,4)",
}
# --- End of fixed values ------------------------------------------------------------


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header row.  With a schema, rows that do not fit it keep their text in
    ``_corrupt_record``; without one every column is text, to be coerced explicitly."""
    if not path.rstrip("/").endswith((".csv", ".csv.gz")) and "*" not in path:
        raise ValueError("only .csv paths are accepted")
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        return reader.option("inferSchema", False).csv(path)
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return (
        reader.option("columnNameOfCorruptRecord", "_corrupt_record")
        .schema(StructType(struct.fields + StructType.fromDDL("_corrupt_record string").fields)).csv(path)
    )


def scan_readings(spark: SparkSession, path: str, order: Sequence[str] = ("ts",)) -> DataFrame:
    return spark.read.parquet(path).orderBy(*order)


def scan_side_input_json(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """(ts, temp, cloud) from JSON objects that map a time to {temp, cloud} or to a number.

    Each line is parsed as a variant and exploded to rows, so large files are split.  An
    object that spans lines needs ``whole_files``; each such file is one row.
    """
    text = spark.read.option("wholetext", whole_files).text(path)
    return side_input_rows(text, "value")


def side_input_rows(df: DataFrame, col: str) -> DataFrame:
    parsed = df.select(F.parse_json(F.col(col)).alias("_v"))
    rows = parsed.lateralJoin(
        parsed.sparkSession.tvf.variant_explode(F.col("_v").outer())
    ).select("key", "value")
    number = F.try_variant_get("value", "$", "double")
    return rows.select(
        F.try_to_timestamp("key").alias("ts"),
        F.coalesce(F.try_variant_get("value", "$.temp", "double"), number, F.lit(20.0)).alias("temp"),
        F.coalesce(F.try_variant_get("value", "$.cloud", "double"), F.lit(0.3)).alias("cloud"),
    )


def first_writes(df: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The earliest row per key.  A min over structs combines before the shuffle, so a key
    repeated any number of times costs one row per task."""
    rest = [c for c in df.columns if c not in {*key, seq}]
    return df.groupBy(*key).agg(F.min(F.struct(seq, *rest)).alias("_r")).select(*key, "_r.*").select(*df.columns)


def new_rows(df: DataFrame, existing: DataFrame | None, key: Sequence[str], seq: str) -> DataFrame:
    """Rows whose key is not stored yet; within the batch the first write wins."""
    batch = first_writes(df, key, seq)
    if existing is None:
        return batch
    return batch.join(existing.select(*key), list(key), "left_anti")


def append_new(df: DataFrame, target: str, key: Sequence[str], seq: str, day: str | None = None) -> None:
    """Insert-or-ignore into a Parquet table.

    With ``day``, a time column that is part of the key, the table is partitioned by its
    date, and only the folders of the days that the batch touches are read.
    """
    spark = df.sparkSession
    existing = spark.read.parquet(target) if table_exists(spark, target) else None
    if day is None:
        new_rows(df, existing, key, seq).write.mode("append").parquet(target)
        return
    if day not in key:
        raise ValueError("the day column must be part of the key")
    dated = df.withColumn("day", F.to_date(day))
    if existing is not None:
        days = [r[0] for r in dated.select("day").distinct().collect()]  # a batch's days: bounded by the calendar
        existing = existing.where(F.col("day").isin(days))
    new_rows(dated, existing, key, seq).write.mode("append").partitionBy("day").parquet(target)


def table_exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return len(spark.read.parquet(path).schema) > 0
    except AnalysisException:
        return False


def replace_table(df: DataFrame, path: str) -> None:
    """Replace the whole table.  The result must not be read from the same path."""
    df.write.mode("overwrite").parquet(path)


def truncate_table(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampFormat", MICROSECONDS).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampFormat", MICROSECONDS).json(path)


def stored_decimals(df: DataFrame, types: Mapping[str, str] = STORED_DECIMALS) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


def write_day_partitioned(df: DataFrame, path: str, ts="ts", max_records_per_file=5_000_000) -> None:
    """One folder per day; a day is dealt by a hash into as many tasks as its row count asks
    for, one for each file, and sorted by time within files for min/max pruning."""
    dated = stored_decimals(df).withColumn("day", F.to_date(ts))
    tasks = dated.groupBy("day").agg(F.ceil(F.count(F.lit(1)) / max_records_per_file).alias("_n"))
    spread = F.pmod(F.xxhash64(*df.columns), F.col("_n"))
    (
        dated.join(tasks, dated["day"].eqNullSafe(tasks["day"])).drop(tasks["day"]).withColumn("_s", spread)
        .repartition("day", "_s").sortWithinPartitions("day", ts).drop("_s", "_n")
        .write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).partitionBy("day").parquet(path)
    )


def read_evolved(spark: SparkSession, path: str, columns: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Read files of several schema versions as one table with defaults for old rows."""
    from gridloom.operators.cleaning import evolve_schema

    return evolve_schema(spark.read.option("mergeSchema", True).parquet(path), columns)


__all__ = [
    "append_new", "first_writes", "new_rows", "read_evolved", "replace_table", "scan_csv", "scan_readings",
    "scan_side_input_json", "side_input_rows", "stored_decimals", "truncate_table", "write_csv",
    "write_day_partitioned", "write_json",
]
