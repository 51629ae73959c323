"""Recurrences over streams: a stored list of chunks per key, folded again where rows arrive.

A key's rows lie in chunks of consecutive rows.  For each chunk a small table holds its
summary (how it maps an entry state to an exit state), its entry and its exit.  A micro-batch

1. sends each new row to the chunk it falls into, be it the last one or, for a late row, any
   earlier one, and reads just these chunks;
2. summarises them anew, cutting those that have grown too large;
3. folds the key's summaries from the first touched chunk on: one row per chunk;
4. replays the touched chunks, and later ones only if their entry state has changed.  Smoothing
   forgets and drift sums reset, so this ends soon behind a late row.

Nothing is held between batches but these tables: no rows in state, no whole key in a task, no
limit on how late a row may come.  A chunk's newest version counts; a batch that runs again
after a failure reads what was before it and writes the same versions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from gridloom.operators.recurrences import Scan, _one, in_runs, segment_map
from gridloom.operators.series import TARGET_ROWS, chunk_rows
from gridloom.session import stored
from gridloom.sources.files import first_writes

LO = ["lo_ts", "lo_id"]
LEAST_ID = -(2**63)
BATCH = StructField("batch", LongType())


@dataclass
class FoldStore:
    """The tables of one folded stream below ``path``: ``rows``, ``cells`` and ``heads``.

    ``keys``, ``ts`` and ``row_id`` (a whole number) name a row; rows lacking one of them have no
    place and are passed over.  A row that is stored already is not stored again.  ``cols`` are the columns that ``scan``
    reads and those that ``finish`` needs to derive further results.
    """

    path: str
    scan: Scan
    keys: Sequence[str]
    ts: str
    row_id: str
    cols: Sequence[str]
    schema: StructType
    finish: Callable[[DataFrame], DataFrame] | None = None
    target: int = TARGET_ROWS

    def __post_init__(self):
        self.keys, self.cols = list(self.keys), list(self.cols)
        self.place = [*self.keys, "day", *LO]
        self.order = [self.ts, self.row_id]
        self.names = [*self.place, *self.order, *self.cols]
        lo = [StructField("lo_ts", self.schema[self.ts].dataType), StructField("lo_id", self.schema[self.row_id].dataType)]
        self.head = [self.schema[k] for k in self.keys] + StructType.fromDDL("day date").fields + lo
        self.carry = StructType.fromDDL(self.scan.carry_schema).fields
        self.exits = [StructField(f"after{f.name}", f.dataType) for f in self.carry]
        self.summary = StructType.fromDDL(f"{self.scan.summary_schema}, n bigint").fields

    def position(self) -> Column:
        return F.struct("day", *LO)

    # --- what is stored ---------------------------------------------------------------------
    def _table(self, spark: SparkSession, name: str, fields: list[StructField]) -> DataFrame | None:
        """A table with known columns, so that no file is opened to find them; None before the first write."""
        try:
            return spark.read.schema(StructType(fields)).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None

    def cells(self, spark: SparkSession, before: int | None = None, since=None) -> DataFrame | None:
        """The newest version of each chunk's row, with its ``batch``; with ``since``, of days from then on."""
        rest = [*self.summary, *self.carry, *self.exits]
        raw = None if before == 0 else self._table(spark, "cells", [*self.head, *rest, BATCH])
        if raw is None:
            return None
        raw = raw if before is None else raw.where(F.col("batch") < before)
        raw = raw if since is None else raw.where(F.col("day") >= F.lit(since))
        newest = raw.groupBy(*self.place).agg(F.max_by(F.struct("batch", *(f.name for f in rest)), "batch").alias("_v"))
        return newest.select(*self.place, "_v.*")

    def rows(self, spark: SparkSession, versions: DataFrame) -> DataFrame:
        """The rows of chunk versions (place, batch); only their folders are read."""
        folders = versions.select("day", "batch").distinct().collect()  # days and batches of the chunks asked for
        days, batches = ({r[i] for r in folders} for i in (0, 1))
        wanted = F.col("day").isin(*days) & F.col("batch").isin(*batches) if folders else F.lit(False)
        columns = [self.schema[c] for c in [*self.order, *self.cols]]
        pruned = self._table(spark, "rows", [*self.head, *columns, BATCH]).where(wanted)
        return pruned.join(versions.select(*self.place, "batch"), [*self.place, "batch"], "left_semi")

    def results(self, spark: SparkSession) -> DataFrame:
        """All rows with their final results so far."""
        versions = self.cells(spark).select(*self.place, "batch")
        rows = spark.read.parquet(f"{self.path}/rows")
        return rows.join(versions, [*self.place, "batch"], "left_semi").drop("day", "batch", *LO)

    # --- one micro-batch --------------------------------------------------------------------
    def routed(self, fresh: DataFrame, cells: DataFrame | None) -> DataFrame:
        """New rows with the chunk they fall into; a day's first chunk begins at its midnight."""
        first = F.struct(F.col("day").cast(self.schema[self.ts].dataType).alias("lo_ts"), F.lit(LEAST_ID).cast(self.schema[self.row_id].dataType).alias("lo_id"))
        at = first
        if cells is not None:
            bounds = cells.groupBy(*self.keys, "day").agg(F.sort_array(F.collect_list(F.struct(*LO))).alias("_los"))
            fresh = fresh.join(bounds, [*self.keys, "day"], "left")
            mine = F.struct(F.col(self.ts).alias("lo_ts"), F.col(self.row_id).alias("lo_id"))
            at = F.coalesce(F.try_element_at(F.filter("_los", lambda lo: lo <= mine), F.lit(-1)), first)
        return fresh.withColumn("_at", at).withColumns({c: F.col(f"_at.{c}") for c in LO}).select(*self.names)

    def cut(self, merged: DataFrame) -> DataFrame:
        """Rows with the chunk they belong to from now on: chunks above ``target`` are cut."""
        most = merged.groupBy(*self.place).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if most <= self.target:
            return merged
        pieces = chunk_rows(merged, self.place, self.order, 0, self.target).select(*self.names, "_chunk")
        mine = F.struct(F.col(self.ts).alias("lo_ts"), F.col(self.row_id).alias("lo_id"))
        marks = pieces.groupBy(*self.place, "_chunk").agg(F.min(mine).alias("_first"))
        along = Window.partitionBy(*self.place).orderBy("_chunk")  # the pieces of one chunk
        marks = marks.withColumn("_lo", F.when(F.row_number().over(along) == 1, F.struct(*LO)).otherwise(F.col("_first"))).drop("_first")
        placed = pieces.join(marks, [*self.place, "_chunk"])
        return stored(placed.withColumns({c: F.col(f"_lo.{c}") for c in LO}).select(*self.names), "chunks")

    def folded(self, summaries: DataFrame) -> DataFrame:
        """Summaries in order, with the state before and after each, and whether it has changed.

        Rows carry ``_fresh``, the entry so far, and the key's exit before the first of them (all
        null for none).  They stream by, one for each chunk.
        """
        scan, keys, names = self.scan, self.keys, [f.name for f in self.carry]
        schema = StructType(self.head + self.summary + self.carry + self.exits + StructType.fromDDL("_fresh boolean, _moved boolean").fields)
        out_schema = to_arrow_schema(schema)
        kept = [f.name for f in self.head + self.summary] + ["_fresh"]

        def run(batches):
            key, state = None, None
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    mine = tuple(row[k] for k in keys)
                    if mine != key:
                        prior = {n: row[f"_prior{n}"] for n in names}
                        key, state = mine, scan.start(row) if None in prior.values() else scan.load(prior)
                    entry = scan.emit(state)
                    state = scan.step(state, row)
                    moved = row["_fresh"] or any(entry[n] != row[n] for n in names)
                    out.append({c: row[c] for c in kept} | entry | {f"after{n}": v for n, v in scan.emit(state).items()} | {"_moved": moved})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=out_schema)

        return in_runs(summaries, keys, ["day", *LO]).mapInArrow(run, schema)

    def heads(self, spark: SparkSession, number: int) -> DataFrame | None:
        """Each key's last chunk: its day and the state after it, as of the batch before."""
        if not number:
            return None
        return self._table(spark, f"heads/{(number - 1) % 2}", [*(self.schema[k] for k in self.keys), self.head[-3], *self.exits])

    def prior(self, spark, number, firsts: DataFrame, cells: DataFrame | None, since) -> DataFrame:
        """``firsts`` (keys, ``_from``) with the state after the key's last chunk before it, null for none."""
        names = [f.name for f in self.exits]
        if cells is None:
            return firsts.withColumns({f"_prior{f.name}": F.lit(None).cast(f.dataType) for f in self.carry})

        def last(found: DataFrame) -> DataFrame:
            chosen = found.join(firsts, self.keys).where(self.position() < F.col("_from"))
            return chosen.groupBy(*self.keys).agg(F.max_by(F.struct(*names), self.position()).alias("_s"))

        near = stored(last(cells), "near")
        heads = self.heads(spark, number)
        far = firsts.join(near, self.keys, "left_anti").join(heads, self.keys)
        known = near.unionByName(far.where(F.col("day") < F.lit(since)).select(*self.keys, F.struct(*names).alias("_s")))
        # keys with later chunks only since then, as for a late first row of a day: look further back
        back = stored(far.where(F.col("day") >= F.lit(since)).select(*self.keys), "late")
        if not back.isEmpty():
            known = known.unionByName(last(self.cells(spark, number).where(F.col("day") < F.lit(since)).join(back, self.keys, "left_semi")))
        return firsts.join(known, self.keys, "left").select(
            *self.keys, "_from", *(F.col(f"_s.after{f.name}").alias(f"_prior{f.name}") for f in self.carry)
        )

    def write(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        named = batch.where(" and ".join(f"`{c}` is not null" for c in [*self.keys, *self.order]))
        fresh = first_writes(named.select(*self.keys, *self.order, *self.cols), [*self.keys, *self.order], self.cols[0])
        fresh = stored(fresh.withColumn("day", F.to_date(self.ts)), "arrived")
        since = fresh.agg(F.min("day")).first()[0]
        if since is None:
            if number and (heads := self.heads(spark, number)) is not None:
                heads.write.mode("overwrite").parquet(f"{self.path}/heads/{number % 2}")
            return
        cells = self.cells(spark, number, since)
        cells = None if cells is None else stored(cells, "cells")
        merged = self.routed(fresh, cells).withColumn("_seq", F.lit(1))
        touched = stored(merged.select(*self.place).distinct(), "touched")
        if cells is not None:
            versions = cells.join(touched, self.place, "left_semi")
            held = self.rows(spark, versions).select(*self.names, F.lit(0).alias("_seq"))
            merged = first_writes(merged.unionByName(held), [*self.place, *self.order], "_seq")
        chunks = self.cut(stored(merged.select(*self.names), "merged"))
        place, names, scan = self.place, self.names, self.scan  # what tasks need of this store
        summaries = segment_map(
            chunks, place, self.order, lambda t: _one(t, place, scan.summarise(t) | {"n": t.num_rows}),
            StructType(self.head + self.summary),
        ).withColumns({"_fresh": F.lit(True)} | {f.name: F.lit(None).cast(f.dataType) for f in self.carry})

        firsts = stored(touched.groupBy(*self.keys).agg(F.min(self.position()).alias("_from")), "firsts")
        prior = self.prior(spark, number, firsts, cells, since)
        if cells is not None:
            later = cells.join(touched, self.place, "left_anti").join(firsts, self.keys).where(self.position() > F.col("_from"))
            summaries = summaries.unionByName(later.withColumn("_fresh", F.lit(False)).select(*summaries.columns))
        folded = stored(self.folded(summaries.join(prior.drop("_from"), self.keys)), "folded")

        rows = chunks
        moved = folded.where("_moved and not _fresh")
        if cells is not None and not moved.isEmpty():
            behind = self.rows(spark, cells.join(moved.select(*self.place), self.place, "left_semi"))
            rows = rows.unionByName(behind.select(*self.names))
        entries = folded.where("_moved").select(*self.place, *(f.name for f in self.carry))
        schema = StructType(rows.schema.fields + StructType.fromDDL(scan.output_schema).fields)
        done = segment_map(rows.join(entries, place), place, self.order, lambda t: scan.replayed(t, names), schema)
        self._put(self.finish(done) if self.finish else done, "rows", number)
        self._put(folded.where("_moved").drop("_fresh", "_moved"), "cells", number)
        heads = folded.groupBy(*self.keys).agg(F.max_by(F.struct("day", *(f.name for f in self.exits)), self.position()).alias("_s")).select(*self.keys, "_s.*")
        old = self.heads(spark, number)
        if old is not None:
            heads = heads.unionByName(old.join(firsts, self.keys, "left_anti"))
        heads.write.mode("overwrite").parquet(f"{self.path}/heads/{number % 2}")

    def _put(self, df: DataFrame, name: str, number: int) -> None:
        """A batch's folders are replaced as a whole, so a second run leaves the same."""
        writer = df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.path}/{name}")

    def start(self, df: DataFrame):
        """Start the stream; its progress is kept beside the tables, as both belong together."""
        return (
            df.writeStream.outputMode("append").foreachBatch(self.write).option("checkpointLocation", f"{self.path}/progress")
            .trigger(availableNow=True).start()
        )
