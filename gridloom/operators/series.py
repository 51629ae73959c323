"""Ordered series without whole-key tasks.

A window over ``partitionBy(meter)`` puts all rows of a meter into one task, which fails
when one meter holds a large share of the data.  Here every series is cut into chunks of
consecutive rows of about ``TARGET_ROWS`` each (at most twice as many):

1. one map-side-combined histogram counts rows per key and day; days with more rows than a
   chunk are counted again by hour, then minute, second and instant, and rows of one instant
   by quantiles of the next order column, each time only where the coarser cell is too large;
2. a running sum over those counts gives each cell its start position and its chunk
   (one row per key and day, plus one per cell of a heavy day);
3. rows join the cell table - broadcast only when Spark measures it as small enough - and
   one shuffle on (key, chunk) serves position, lags and rolling frames alike.

Operators that look back ``halo`` rows receive the last ``halo`` rows before the chunk as
extra rows with ``_own = false``: a top-n query over the cells that end there finds the
earliest of them, and only rows from it on are copied.  Unbounded look-back travels through
per-chunk summaries.

Key and order columns must not be null: a row without a key or a time has no place in any
series.  ``validate_table`` and ``validate_ranges`` report such rows beforehand.  Rows that
agree in all order columns are in no order; more than a chunk of them stay together.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import stored

TARGET_ROWS = 50_000
DAY = 86_400
TIME_WIDTHS = tuple(1_000_000 * s for s in (DAY, 3_600, 60, 1)) + (1,)


def time_slot(ts: str | Column, seconds: int = DAY) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(col) / F.lit(seconds))


def _number(df: DataFrame, col: str) -> Column:
    """The order column as a whole number; times in microseconds."""
    kind = df.schema[col].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(col).cast("timestamp"))
    return F.floor(F.col(col)).cast("long")


def _widths(df: DataFrame, col: str, width: int | None) -> tuple[int, ...]:
    if df.schema[col].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        return TIME_WIDTHS
    width = width or 1 << 16
    return tuple(w for w in (width, width >> 5, width >> 10) if w > 1) + (1,)


def _edge(number: Column, width: int) -> Column:
    return number - F.pmod(number, F.lit(width))


class Cells:
    """The cells of all series and the columns that lead a row to its cell."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], target: int, width: int | None):
        self.keys, self.order, self.target = list(keys), list(order), target
        self.number = _number(df, order[0])
        self.widths = _widths(df, order[0], width)
        self.heavy: list[DataFrame] = []  # by level: (keys, _edge) of cells that are cut further
        self.bounds: DataFrame | None = None
        ties = [c for c in order[1:] if df.schema[c].dataType.typeName() in ("long", "integer", "short", "double", "timestamp")]
        levels = []
        for level in range(len(self.widths)):
            part = self.mark(df, level).where(F.col("_level") == level)
            counts = stored(
                part.groupBy(*self.keys, "_edge").agg(F.count(F.lit(1)).alias("_cnt")), "cells"
            ).withColumns({"_level": F.lit(level), "_piece": F.lit(0)})
            most = counts.agg(F.max("_cnt")).first()[0] or 0
            if most <= target:
                levels.append(counts)
                break
            last = level == len(self.widths) - 1
            if last and not ties:
                levels.append(counts)
                break
            levels.append(counts.where(F.col("_cnt") <= target))
            heavy = counts.where(F.col("_cnt") > target).select(*self.keys, "_edge")
            if not last:
                self.heavy.append(heavy)
                continue
            pieces = -(-most // target) * 2
            shares = [i / pieces for i in range(1, pieces)]
            together = part.join(heavy, [*self.keys, "_edge"])
            self.tie = ties[0]
            self.bounds = stored(
                together.groupBy(*self.keys, "_edge").agg(
                    F.array_distinct(F.percentile_approx(self.tie, shares, 100 * pieces)).alias("_bounds")), "bounds",
            )
            levels.append(
                self.mark(df, level).where(F.col("_bounds").isNotNull())
                .groupBy(*self.keys, "_edge", "_piece").agg(F.count(F.lit(1)).alias("_cnt")).withColumn("_level", F.lit(level))
            )
        cells = levels[0]
        for more in levels[1:]:
            cells = cells.unionByName(more)
        self.table = cells if len(levels) == 1 else stored(cells, "cells")

    def mark(self, df: DataFrame, upto: int | None = None) -> DataFrame:
        """Add ``_level``, ``_edge`` and ``_piece``: the place of a row's cell."""
        out = df.withColumns({"_level": F.lit(0), "_edge": _edge(self.number, self.widths[0]), "_piece": F.lit(0)})
        for level, heavy in enumerate(self.heavy[:upto]):
            named = heavy.withColumn("_cut", F.lit(True))
            out = out.join(named, [*self.keys, "_edge"], "left").withColumns({
                "_level": F.when(F.col("_cut"), level + 1).otherwise(F.col("_level")),
                "_edge": F.when(F.col("_cut"), _edge(self.number, self.widths[level + 1])).otherwise(F.col("_edge")),
            }).drop("_cut")
        if self.bounds is not None:
            # an instant's edge may also be the edge of a coarser cell: those have other levels
            bounds = self.bounds.withColumn("_level", F.lit(len(self.widths) - 1))
            out = out.join(bounds, [*self.keys, "_edge", "_level"], "left").withColumn(
                "_piece", F.when(F.col("_bounds").isNotNull(), F.size(F.filter("_bounds", lambda b: b < F.col(self.tie))))
                .otherwise(0),
            )
        return out

    def placed(self) -> DataFrame:
        """Cells with ``_start``, ``_end``, ``_n`` and home chunk."""
        along = Window.partitionBy(*self.keys).orderBy("_edge", "_level", "_piece")
        return (
            self.table.withColumn("_end", F.sum("_cnt").over(along.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_n", F.sum("_cnt").over(Window.partitionBy(*self.keys)))
            .withColumn("_start", F.col("_end") - F.col("_cnt"))
            .withColumn("_home", F.floor(F.col("_start") / self.target))
        )

    def several(self) -> bool:
        """Whether any series has more than one chunk."""
        total = self.table.groupBy(*self.keys).agg(F.sum("_cnt").alias("_n")).agg(F.max("_n")).first()[0]
        return (total or 0) > self.target

    def served(self, df: DataFrame, placed: DataFrame, halo: int) -> DataFrame:
        """(cell, ``_after``): chunks that begin within ``halo`` rows behind the cell, each with
        the order values of the first row to copy."""
        begins = placed.groupBy(*self.keys, F.col("_home").alias("_next")).agg(F.min("_start").alias("_begin"))
        reach = F.array_distinct(F.array(F.floor(F.col("_end") / self.target), F.floor((F.col("_end") + halo - 1) / self.target)))
        place = [*self.keys, "_edge", "_level", "_piece"]
        tails = placed.select(*place, "_end", "_home", F.explode(reach).alias("_next")).join(begins, [*self.keys, "_next"]).where(
            (F.col("_next") > F.col("_home")) & (F.col("_begin") >= F.col("_end")) & (F.col("_begin") < F.col("_end") + halo)
        ).select(*place, "_next")
        tails = stored(tails, "tails")
        last_rows = Window.partitionBy(*self.keys, "_next").orderBy(*(F.desc(c) for c in self.order))
        first = (
            self.mark(df.select(*self.keys, *self.order)).join(tails, place)
            .select(*self.keys, "_next", *self.order, F.row_number().over(last_rows).alias("_rn")).where(F.col("_rn") <= halo)
            .groupBy(*self.keys, "_next").agg(F.min(F.struct(*self.order)).alias("_from"))
        )
        return tails.join(first, [*self.keys, "_next"]).groupBy(*place).agg(
            F.collect_list(F.struct("_next", "_from")).alias("_after")
        )


def chunk_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], halo: int = 0, target: int = TARGET_ROWS,
    width: int | None = None,
) -> DataFrame:
    """Add ``_start, _n, _chunk, _own``; ``width`` is the first cell width of a numeric order column."""
    if halo > target:
        raise ValueError("halo must not exceed the chunk size")
    cells = Cells(df, keys, order, target, width)
    place = [*cells.keys, "_edge", "_level", "_piece"]
    placed = cells.placed().select(*place, "_start", "_end", "_n", "_home")
    rows = cells.mark(df)
    if not halo or not cells.several():
        out = rows.join(placed, place).withColumns({"_chunk": F.col("_home"), "_own": F.lit(True)})
    else:
        after = cells.served(df, placed, halo)
        mine = F.struct(*cells.order)
        copies = F.transform(F.filter("_after", lambda a: a["_from"] <= mine), lambda a: a["_next"])
        known = placed.join(after, place, "left")
        out = rows.join(known, place).withColumn(
            "_chunk", F.explode(F.concat(F.array("_home"), F.coalesce(copies, F.array().cast("array<bigint>"))))
        ).withColumn("_own", F.col("_chunk") == F.col("_home")).drop("_after")
    return out.drop("_edge", "_level", "_piece", "_home", "_end", "_bounds")


def chunk_window(keys: Sequence[str], order: Iterable[str]):
    return Window.partitionBy(*keys, "_chunk").orderBy(*order)


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], target: int = TARGET_ROWS, width: int | None = None
) -> DataFrame:
    """Add ``_pos`` (0-based row number per key) and ``_n`` (rows per key)."""
    w = chunk_window(keys, order)
    first = F.first("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        chunk_rows(df, keys, order, 0, target, width)
        .withColumn("_pos", first + F.row_number().over(w) - 1)
        .drop("_start")
    )


def windowed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict, halo: int, target: int = TARGET_ROWS,
    width: int | None = None,
) -> DataFrame:
    """Evaluate look-back window columns exactly over chunks.

    ``columns`` maps a name to a function of the ordered window; each may look back at
    most ``halo`` rows.
    """
    w = chunk_window(keys, order)
    out = chunk_rows(df, keys, order, halo, target, width)
    out = out.withColumns({name: make(w) for name, make in columns.items()})
    return out.filter("_own").drop("_start", "_n", "_chunk", "_own")


def before(w, n: int):
    """The last n rows up to and including the current one."""
    return w.rowsBetween(-(n - 1), 0)
