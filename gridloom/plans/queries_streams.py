"""Streams over the given events: each run drains the table and returns what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import dims
from gridloom.operators import forest as I
from gridloom.plans.queries_base import KEYS
from gridloom.plans.queries_domain import live_readings
from gridloom.plans.queries_models import RAW_FEATURES, forest_sql
from gridloom.plans.queries_series import CUSUM_SQL
from gridloom.plans.registry import CURVE, READINGS, USER_READINGS, query, rounded, scratch
from gridloom.sources.files import write_json
from gridloom.sources.tables import as_readings, readings, table
from gridloom.streaming import streams as S


def events_stream(spark, sf_dir, meter="event_type"):
    """The events table as a stream, be it one file or a folder of files."""
    schema = table(spark, sf_dir, "events").schema
    return as_readings(S.read_stream(spark, f"{sf_dir.rstrip('/')}/event[s].parquet", schema, "parquet"), meter)


def shuffled_stream(spark, sf_dir, files=4):
    """Readings that arrive in several files, one a micro-batch, in no order of time."""
    inbox = scratch(spark, "arrivals")
    rows = readings(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh")
    rows.repartition(files, F.xxhash64("reading_id")).write.parquet(inbox)
    return S.read_stream(spark, inbox, rows.schema, "parquet", 1)


def newest(df, name, keys, mode="append"):
    """Run a stream of versions to its end and read the newest of each key."""
    spark = df.sparkSession
    out = scratch(spark, name)
    S.keep_versions(df, out, scratch(spark, f"{name}-progress"), mode).awaitTermination()
    return S.latest(spark.read.parquet(out), keys)


def drained(df, name):
    """Run a stream to its end into Parquet and read the result."""
    spark = df.sparkSession
    out = scratch(spark, name)
    S.micro_batch_sink(df, out, scratch(spark, f"{name}-progress")).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("stream_ingest_json", f"WITH {READINGS} SELECT meter_id, reading_id, ts, usage_kwh FROM readings")
def stream_ingest_json(spark, sf_dir):
    """JSON records arriving in a folder, written by micro-batches."""
    inbox = scratch(spark, "inbox")
    write_json(readings(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh"), inbox)
    df = S.read_stream(spark, inbox, "meter_id string, reading_id bigint, ts timestamp, usage_kwh double")
    return drained(df, "ingest")


DEDUP_SQL = f"""WITH {READINGS} SELECT DISTINCT meter_id, date_trunc('minute', ts) AS ts FROM readings"""


@query("stream_dedup", DEDUP_SQL)
def stream_dedup(spark, sf_dir):
    df = events_stream(spark, sf_dir).select("meter_id", F.date_trunc("minute", "ts").alias("ts"))
    return drained(S.dedup_stream(df, KEYS, delay="40 days"), "dedup")


@query("stream_dedup_late", DEDUP_SQL)
def stream_dedup_late(spark, sf_dir):
    """Rows arrive in no order; each key is stored once, none is dropped for coming late."""
    df = shuffled_stream(spark, sf_dir).select("meter_id", F.date_trunc("minute", "ts").alias("ts"), "reading_id")
    out = scratch(spark, "dedup-late")
    S.keep_new_rows(df, out, scratch(spark, "dedup-late-progress"), ["meter_id", "ts"], "reading_id", "ts").awaitTermination()
    return spark.read.parquet(out).select("meter_id", "ts")


HOURS_SQL = f"""WITH {READINGS} SELECT meter_id, date_trunc('hour', ts) AS ts, round(avg(usage_kwh), 6) AS usage_kwh, count(*) AS n FROM readings GROUP BY ALL"""


@query("stream_tumbling_load", HOURS_SQL)
def stream_tumbling_load(spark, sf_dir):
    """All windows, the last ones with what has arrived."""
    return rounded(newest(S.tumbling_load(events_stream(spark, sf_dir), KEYS), "tumbling", ["meter_id", "ts"], "update"), 6, "usage_kwh")


@query("stream_tumbling_late", HOURS_SQL)
def stream_tumbling_late(spark, sf_dir):
    load = S.tumbling_load(shuffled_stream(spark, sf_dir), KEYS, delay="40 days")
    return rounded(newest(load, "tumbling-late", ["meter_id", "ts"], "update"), 6, "usage_kwh")


EWMA_SQL = f"""WITH RECURSIVE {READINGS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts, reading_id) AS pos FROM readings),
s AS (SELECT meter_id, pos, reading_id, usage_kwh AS v FROM numbered WHERE pos = 1
  UNION ALL SELECT n.meter_id, n.pos, n.reading_id, 0.8::DOUBLE * s.v + 0.2::DOUBLE * n.usage_kwh FROM s JOIN numbered n ON n.meter_id = s.meter_id AND n.pos = s.pos + 1)
SELECT reading_id, round(v, 6) AS smooth_kwh, round(v * 0.062176 * 1.93, 6) AS scope1_co2_kg FROM s"""


def _smoothed(df):
    spark = df.sparkSession
    path = scratch(spark, "ewma")
    S.stream_ewma_emissions(df, path, KEYS).awaitTermination()
    out = S.smoothing_store(df.schema, path, KEYS).results(spark)
    return rounded(out, 6, "smooth_kwh", "scope1_co2_kg").select("reading_id", "smooth_kwh", "scope1_co2_kg")


@query("stream_ewma_emissions", EWMA_SQL)
def stream_ewma_emissions(spark, sf_dir):
    return _smoothed(events_stream(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh"))


@query("stream_ewma_shuffled", EWMA_SQL)
def stream_ewma_shuffled(spark, sf_dir):
    """Rows of all days in each micro-batch: nearly all of them late."""
    return _smoothed(shuffled_stream(spark, sf_dir))


INGEST_SQL = EWMA_SQL.split("SELECT reading_id, round(v, 6)")[0] + f""", {CURVE}, given AS (
  SELECT s.reading_id, v, usage_kwh, hour, carbon_g, CASE WHEN s.reading_id % 7 = 0 THEN usage_kwh * 0.5::DOUBLE END AS g2,
         CASE WHEN s.reading_id % 11 = 0 THEN 1.25::DOUBLE END AS g1
  FROM s JOIN readings r ON r.reading_id = s.reading_id JOIN curve ON hour = hour(r.ts)),
scopes AS (SELECT reading_id, v, coalesce(g1, v * 0.062176 * 1.93) AS s1, coalesce(g2, usage_kwh * carbon_g / 1000.0) AS s2,
  usage_kwh * 0.22::DOUBLE + 5.0::DOUBLE * (hour * 3600) / 86400.0 AS s3 FROM given)
SELECT reading_id, round(v, 6) AS smooth_kwh, round(s1, 6) AS scope1_co2_kg, round(s2, 6) AS scope2_co2_kg, round(s3, 6) AS scope3_co2_kg,
  round((s1 + s2 + s3) / 1000.0, 8) AS co2_tco2 FROM scopes"""


@query("stream_ingest_pipeline", INGEST_SQL)
def stream_ingest_pipeline(spark, sf_dir):
    """Three loads: early days, then later ones with rows of the first among them, then readings of all
    days that were held back.  Checked, smoothed, priced in all scopes; each reading is stored once."""
    rows = readings(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh")
    rows = rows.withColumns({
        "scope1_co2_kg": F.when(F.col("reading_id") % 11 == 0, F.lit(1.25)),
        "scope2_co2_kg": F.when(F.col("reading_id") % 7 == 0, F.col("usage_kwh") * 0.5),
    })
    inbox, out = (scratch(spark, n) for n in ("loads", "ingested"))
    held, curve = F.col("reading_id") % 10 == 3, dims.hour_curve(spark)
    for part in (
        rows.where("ts < timestamp '2024-01-16'").where(~held), rows.where("ts >= timestamp '2024-01-15 12:00:00'").where(~held), rows.where(held)
    ):
        broken = part.limit(3).withColumns({"usage_kwh": F.lit(-5.0), "reading_id": -F.col("reading_id") - 1})
        part.unionByName(broken).coalesce(1).write.mode("append").parquet(inbox)
        load = S.read_stream(spark, inbox, rows.schema, "parquet", 1)
        S.ingest(load, out, F.col("usage_kwh") >= 0, curve).awaitTermination()
    stored = S.ingested(spark, out, rows.withColumnsRenamed({c: f"given_{c}" for c in S.SUPPLIED}).schema, curve)
    priced = rounded(rounded(stored, 6, "smooth_kwh", "scope1_co2_kg", "scope2_co2_kg", "scope3_co2_kg"), 8, "co2_tco2")
    return priced.select("reading_id", "smooth_kwh", "scope1_co2_kg", "scope2_co2_kg", "scope3_co2_kg", "co2_tco2")


@query("stream_moments", f"""WITH {USER_READINGS} SELECT meter_id, count(*) AS n, round(avg(usage_kwh), 6) AS mean, round(coalesce(stddev_samp(usage_kwh), 0), 6) AS std FROM readings GROUP BY meter_id""")
def stream_moments(spark, sf_dir):
    """Running moments in update mode; the newest batch of each key is read."""
    rows = newest(S.stream_moments(events_stream(spark, sf_dir, "user_id"), KEYS), "moments", ["meter_id"], "update")
    return rounded(rows.select("meter_id", "n", "mean", "std"), 6, "mean", "std")


CUSUM_STREAM_SQL = CUSUM_SQL + """SELECT reading_id, round(p, 4) AS cusum_pos, round(q, 4) AS cusum_neg,
  CASE WHEN p > h THEN 'Upper' WHEN q > h THEN 'Lower' END AS drift FROM s"""


def _drift(spark, sf_dir, df):
    base = readings(spark, sf_dir).groupBy("meter_id").agg(F.avg("usage_kwh").alias("mean"), F.stddev_pop("usage_kwh").alias("std"))
    path = scratch(spark, "cusum")
    S.stream_cusum(df, path, base, KEYS, threshold=4.0).awaitTermination()
    schema = df.withColumns({"_mu": F.lit(0.0), "_sd": F.lit(0.0)}).schema
    out = S.drift_store(schema, path, KEYS, threshold=4.0).results(spark)
    return rounded(out, 4, "cusum_pos", "cusum_neg").select("reading_id", "cusum_pos", "cusum_neg", "drift")


@query("stream_cusum", CUSUM_STREAM_SQL)
def stream_cusum(spark, sf_dir):
    return _drift(spark, sf_dir, events_stream(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh"))


@query("stream_cusum_shuffled", CUSUM_STREAM_SQL)
def stream_cusum_shuffled(spark, sf_dir):
    return _drift(spark, sf_dir, shuffled_stream(spark, sf_dir))


@query("stream_alerts", """SELECT event_id AS reading_id, 'Thermal Overload' AS alert_type, 'CRITICAL' AS severity FROM events WHERE 40 + value > 85
UNION ALL SELECT event_id, 'Power Factor Drop', 'HIGH' FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 < 0.9
UNION ALL SELECT event_id, 'Phase Imbalance', 'MEDIUM' FROM (SELECT event_id, 100 + value / 60 AS m, value FROM events)
  WHERE 100 * greatest(abs(100 - m), abs(100 + value / 10 - m), abs(100 - value / 20 - m)) / m > 5""")
def stream_alerts(spark, sf_dir):
    out = S.stream_alerts(live_readings(events_stream(spark, sf_dir)), dims.alert_limits(spark), ["reading_id"])
    return drained(out.select("reading_id", "alert_type", "severity"), "alerts")


@query("alert_state", """SELECT user_id AS alert_id, max(ts) AS at, arg_max(CASE WHEN event_type IN ('click', 'view') THEN 'TRIGGERED' WHEN event_type = 'error' THEN 'CLOSED' ELSE 'ACKNOWLEDGED' END, ts) AS status FROM events GROUP BY user_id""")
def alert_state(spark, sf_dir):
    status = (
        F.when(F.col("event_type").isin("click", "view"), "TRIGGERED").when(F.col("event_type") == "error", "CLOSED")
        .otherwise("ACKNOWLEDGED")
    )
    moves = table(spark, sf_dir, "events").select(F.col("user_id").alias("alert_id"), F.col("ts").alias("at"), status.alias("status"))
    return S.alert_state(moves)


@query("active_alerts", """SELECT count(*) AS n, min(alert_id) AS first_id FROM (SELECT user_id AS alert_id, arg_max(event_type, ts) AS k FROM events GROUP BY user_id) WHERE k <> 'error'""")
def active_alerts(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "CLOSED").otherwise("TRIGGERED")
    moves = table(spark, sf_dir, "events").select(F.col("user_id").alias("alert_id"), F.col("ts").alias("at"), status.alias("status"))
    return S.active_alerts(moves).agg(F.count(F.lit(1)).alias("n"), F.min("alert_id").alias("first_id"))


@query("score_stream", f"WITH RECURSIVE {READINGS}, {forest_sql(False)} SELECT reading_id, score, score > 0.6 AS is_outlier FROM scored")
def score_stream(spark, sf_dir):
    """A forest fitted on the table scores the same rows as they stream in."""
    r = readings(spark, sf_dir).fillna(0.0, ["reactive_lagging_kvarh", "power_factor_lagging"])
    nodes = I.fit(r.select("reading_id", *RAW_FEATURES), RAW_FEATURES, ["reading_id"])
    live = events_stream(spark, sf_dir).fillna(0.0, ["reactive_lagging_kvarh", "power_factor_lagging"]).select("reading_id", *RAW_FEATURES)
    scored = drained(S.score_stream(live, nodes, RAW_FEATURES, 0.6).select("reading_id", "score"), "scores")
    return rounded(scored, 9, "score").withColumn("is_outlier", F.col("score") > 0.6)


@query("alert_acknowledgements", """WITH moves AS (
  SELECT user_id AS alert_id, ts AS at, CASE WHEN event_type = 'error' THEN 'CLOSED' ELSE 'TRIGGERED' END AS status, NULL AS operator FROM events
  UNION ALL SELECT user_id, max(ts) + INTERVAL 1 MINUTE, 'ACKNOWLEDGED', 'operator-' || (user_id % 3) FROM events WHERE user_id % 4 = 0 GROUP BY user_id)
SELECT alert_id, "at", status, coalesce(operator, '-') AS operator FROM moves
QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY "at" DESC, status DESC) = 1""")
def alert_acknowledgements(spark, sf_dir):
    """Transitions stream into a table; operators acknowledge some alerts; the newest state of each."""
    out, progress = scratch(spark, "alert-moves"), scratch(spark, "alert-progress")
    status = F.when(F.col("event_type") == "error", "CLOSED").otherwise("TRIGGERED")
    schema = table(spark, sf_dir, "events").schema
    live = S.read_stream(spark, f"{sf_dir.rstrip('/')}/event[s].parquet", schema, "parquet").select(
        F.col("user_id").alias("alert_id"), F.col("ts").alias("at"), status.alias("status"), F.lit("-").alias("operator")
    )
    S.keep_alert_state(live, out, progress).awaitTermination()
    moves = spark.read.schema(live.schema).parquet(out)
    answered = S.alert_state(moves).where("alert_id % 4 = 0").select(
        "alert_id", (F.col("at") + F.expr("INTERVAL 1 MINUTE")).alias("at"), F.lit("ACKNOWLEDGED").alias("status"),
        F.concat(F.lit("operator-"), (F.col("alert_id") % 3).cast("string")).alias("operator"),
    )
    inbox = scratch(spark, "answers")
    answered.write.parquet(inbox)
    # a stream has a sink folder of its own: its log of finished batches lies there
    answers = drained(S.read_stream(spark, inbox, live.schema, "parquet"), "answer-moves")
    return S.alert_state(moves.unionByName(answers))
