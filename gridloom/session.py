"""Session helpers: test/bench session and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str, cpus: int | str = 8, memory: str = "12g", shared: str | None = None) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own.

    ``shared`` names the folder for intermediate tables (``spark.checkpoint.dir``).
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named by ``spark.checkpoint.dir``; make one only where it is unset.

    The fallback is for single-machine runs such as tests: on a cluster the setting must
    name a folder that every executor can reach.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if folder:
        if current is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; survives the loss of executors."""
    return stored(df, "step")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


ROWS_PER_FILE = 250_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write to a fresh folder below the shared checkpoint folder and read it again.

    Cuts lineage like a checkpoint, and keeps what a checkpoint loses: measured size for
    the choice of joins, and column pruning.  With ``rows``, a bound of the rows that the last
    stage handles, that stage has one task and file for each 250 000 of them at most.
    """
    path = scratch_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
