"""Structured Streaming counterparts: ingest, dedup, windows, keyed state, alerts, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.operators.emissions import CO2_PER_GAS, GAS_PER_KWH, priced_scopes, threshold_alerts
from gridloom.operators.recurrences import cusum_scan, ewma_scan
from gridloom.sources.files import append_new
from gridloom.streaming.folds import FoldStore


def read_stream(
    spark: SparkSession, path: str, schema: str | StructType, fmt="json", files_per_batch: int | None = None,
    bytes_per_batch: int = 1 << 36,
) -> DataFrame:
    """Records from a folder that files arrive in.

    A micro-batch is bounded by ``files_per_batch`` if given, else by the files' bytes; results do
    not depend on it.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        return reader.option("maxFilesPerTrigger", files_per_batch).load(path)
    return reader.option("maxBytesPerTrigger", bytes_per_batch).load(path)


def kafka_records(raw: DataFrame, schema: str) -> DataFrame:
    """JSON records in the ``value`` bytes of Kafka rows; a value that is no JSON gives nulls."""
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """Records from a Kafka topic (needs the Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return kafka_records(raw, schema)


def micro_batch_sink(df: DataFrame, path: str, checkpoint: str, mode="append", interval: str | None = None, fmt="parquet"):
    """Start a checkpointed file sink; without an interval it drains what is there and ends."""
    writer = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start(path)


def keep_new_rows(df: DataFrame, path: str, checkpoint: str, key: Sequence[str], seq: str, day: str | None = None):
    """Insert-or-ignore each micro-batch: the first row of a key stays, however late it comes.

    A batch that is run again after a failure finds its rows stored and adds none.
    """
    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, path, key, seq, day)

    return _each_batch(df, write, checkpoint)


def _each_batch(df: DataFrame, write, checkpoint: str, mode="append"):
    return (
        df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def keep_versions(df: DataFrame, path: str, checkpoint: str, mode="update"):
    """Append what each micro-batch changed, with the batch number; ``latest`` reads the newest."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return _each_batch(df, write, checkpoint, mode)


def latest(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version of each key; a max over structs combines before the shuffle."""
    rest = [c for c in versions.columns if c not in {*keys, "batch"}]
    return versions.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_r")).select(*keys, *(F.col(f"_r.{c}") for c in rest))


def dedup_stream(df: DataFrame, keys: Sequence[str], ts="ts", delay="1 hour") -> DataFrame:
    """First rows by key and time as they arrive; rows later than the watermark are dropped.

    ``keep_new_rows`` drops none: it looks late rows up in what is stored.
    """
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, ts])


def tumbling_load(df: DataFrame, keys: Sequence[str], ts="ts", width="1 hour", delay="1 hour", cols=("usage_kwh",)):
    """Mean per window.  In update mode every window that a batch touched is written, also the
    last ones; a window takes rows until the watermark is ``delay`` past its end."""
    return (
        df.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width))
        .agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("window.start").alias(ts), *cols, "n")
    )


def stream_moments(df: DataFrame, keys: Sequence[str], col="usage_kwh") -> DataFrame:
    """Running count, mean, variance and deviation per key (update or complete mode)."""
    return df.groupBy(*keys).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"),
        F.coalesce(F.var_samp(col), F.lit(0.0)).alias("variance"),
        F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias("std"),
    )


def smoothing_store(
    schema: StructType, path: str, keys: Sequence[str], ts="ts", col="usage_kwh", alpha=0.2, row_id="reading_id", **kw
) -> FoldStore:
    """Smoothed load and scope 1 per reading, in (time, id) order whatever the order of arrival."""
    def scope1(rows: DataFrame) -> DataFrame:
        return rows.withColumn("scope1_co2_kg", F.col("smooth_kwh") * GAS_PER_KWH * CO2_PER_GAS)

    return FoldStore(path, ewma_scan(col, alpha, "smooth_kwh"), keys, ts, row_id, [col], schema, scope1, **kw)


def stream_ewma_emissions(df: DataFrame, path: str, keys: Sequence[str], **kw):
    """Start a stream that keeps ``smoothing_store`` up to date; its ``results`` are the rows so far."""
    return smoothing_store(df.schema, path, keys, **kw).start(df)


def _with_baseline(df: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their key's mean and deviation; a deviation of zero counts as one."""
    spread = F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    return df.join(baseline.select(*keys, F.col("mean").alias("_mu"), spread.alias("_sd")), list(keys))


def drift_store(
    schema: StructType, path: str, keys: Sequence[str], ts="ts", col="usage_kwh", allowance=0.5, threshold=5.0,
    row_id="reading_id", **kw
) -> FoldStore:
    """Drift sums and alarms per reading, in (time, id) order, of rows that carry ``_mu`` and ``_sd``."""
    return FoldStore(path, cusum_scan(col, allowance, threshold), keys, ts, row_id, [col, "_mu", "_sd"], schema, **kw)


def stream_cusum(df: DataFrame, path: str, baseline: DataFrame, keys: Sequence[str], **kw):
    """Start a stream that keeps ``drift_store`` up to date.

    ``baseline`` is a static table (keys, mean, std), the same for all runs on one ``path``.
    """
    rows = _with_baseline(df, baseline, keys)
    return drift_store(rows.schema, path, keys, **kw).start(rows)


#: Columns whose values, where a reading brings them, win over computed ones.
SUPPLIED = ("nsm", "scope1_co2_kg", "scope2_co2_kg", "scope3_co2_kg", "co2_tco2")


def ingest_store(
    schema: StructType, path: str, curve: DataFrame, keys: Sequence[str] = ("meter_id",), ts="ts", row_id="reading_id",
    alpha=0.2, others: Sequence[str] = (), **kw,
) -> FoldStore:
    """Readings with smoothed load, scopes 1 to 3 and total; ``others`` are columns to keep as they are."""
    given = [f"given_{c}" for c in SUPPLIED if f"given_{c}" in schema.names]

    def price(rows: DataFrame) -> DataFrame:
        return priced_scopes(rows, curve, ts, "smooth_kwh", "given_")

    return FoldStore(path, ewma_scan("usage_kwh", alpha, "smooth_kwh"), keys, ts, row_id, ["usage_kwh", *others, *given], schema, price, **kw)


def ingest(df: DataFrame, path: str, bounds, curve: DataFrame, keys: Sequence[str] = ("meter_id",), **kw):
    """Checked, smoothed and priced readings, stored once each, however late they come.

    Rows outside ``bounds`` (a condition) are dropped.  Scopes and totals that a reading brings
    along win over computed ones.  A micro-batch reads the chunks that its rows fall into and
    those whose smoothed values they change; see ``folds``.  ``ingested`` reads the result.
    """
    named = df.where(bounds).withColumnsRenamed({c: f"given_{c}" for c in SUPPLIED if c in df.columns})
    return ingest_store(named.schema, path, curve, keys, **kw).start(named)


def ingested(spark: SparkSession, path: str, schema: StructType, curve: DataFrame, keys: Sequence[str] = ("meter_id",), **kw) -> DataFrame:
    rows = ingest_store(schema, path, curve, keys, **kw).results(spark)
    return rows.drop(*(c for c in rows.columns if c.startswith("given_")))


def stream_alerts(df: DataFrame, limits: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Threshold alerts on a stream: a literal limits table joins each micro-batch."""
    return threshold_alerts(df, limits, keep)


def alert_state(transitions: DataFrame, key="alert_id", at="at") -> DataFrame:
    """Latest state of each alert from append-only transitions (TRIGGERED, ACKNOWLEDGED)."""
    rest = [c for c in transitions.columns if c not in (key, at)]
    return transitions.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_s")).select(key, "_s.*")


def active_alerts(transitions: DataFrame, key="alert_id", at="at") -> DataFrame:
    return alert_state(transitions, key, at).filter(F.col("status").isin("TRIGGERED", "ACKNOWLEDGED"))


def acknowledge(alerts: DataFrame, alert_ids: Sequence[str], operator: str, at) -> DataFrame:
    """Transition rows that acknowledge the given alerts."""
    return alerts.filter(F.col("alert_id").isin(*alert_ids)).withColumns(
        {"status": F.lit("ACKNOWLEDGED"), "operator": F.lit(operator), "at": F.lit(at)}
    )


def keep_alert_state(transitions: DataFrame, path: str, checkpoint: str):
    """Append transitions as they arrive, acknowledgements with operator and time among them;
    the latest state is read through ``alert_state``."""
    return micro_batch_sink(transitions, path, checkpoint)


def score_stream(df: DataFrame, nodes: DataFrame, features: Sequence[str], cutoff: float, **kw) -> DataFrame:
    """Score arriving rows with a fitted forest; refitting is a batch job."""
    from gridloom.operators.forest import score

    return score(df, nodes, features, **kw).withColumn("is_outlier", F.col("score") > cutoff)
