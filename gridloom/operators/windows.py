"""Rolling statistics, lags, sequences, interpolation and position splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.series import before, chunk_rows, chunk_window, time_slot, windowed, with_position


def rolling(df, keys, order, col, frames: dict[str, tuple[int, str]], **kw) -> DataFrame:
    """``frames``: output name -> (rows, 'mean' | 'std' | 'min' | 'max' | 'sum').

    A frame of one row has standard deviation 0.
    """
    def make(n, fn):
        def column(w):
            f = before(w, n)
            if fn == "std":
                return F.coalesce(F.stddev_samp(col).over(f), F.lit(0.0))
            return {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[fn](col).over(f)
        return column

    columns = {name: make(n, fn) for name, (n, fn) in frames.items()}
    return windowed(df, keys, order, columns, halo=max(n for n, _ in frames.values()), **kw)


def rolling_zscore(df, keys, order, col, n=24, threshold=2.8, **kw) -> DataFrame:
    """Adds ``zscore`` and ``is_spike``; undefined (null) on the first row of a series."""
    out = windowed(
        df, keys, order,
        {
            "_mean": lambda w: F.avg(col).over(before(w, n)),
            "_std": lambda w: F.stddev_samp(col).over(before(w, n)),
        },
        halo=n, **kw,
    )
    z = F.abs((F.col(col) - F.col("_mean")) / (F.col("_std") + F.lit(1e-5)))
    return out.withColumn("zscore", z).withColumn(
        "is_spike", F.coalesce(F.col("zscore") > threshold, F.lit(False))
    ).drop("_mean", "_std")


def lags(df, keys, order, col, offsets: dict[str, int], **kw) -> DataFrame:
    columns = {name: (lambda w, n=n: F.lag(col, n).over(w)) for name, n in offsets.items()}
    return windowed(df, keys, order, columns, halo=max(offsets.values()), **kw)


def lag_features(df, keys, order, col="usage_kwh", offsets=None, **kw) -> DataFrame:
    """Lags of one day and one week of hourly rows, gaps filled with the key's mean."""
    offsets = offsets or {"lag_1d": 24, "lag_7d": 168}
    means = df.groupBy(*keys).agg(F.avg(col).alias("_mean"))
    out = lags(df, keys, order, col, offsets, **kw).join(means, list(keys))
    return out.withColumns({name: F.coalesce(F.col(name), F.col("_mean")) for name in offsets}).drop("_mean")


def lookback_join(df, keys, order, col="usage_kwh", n=24, name="lookback", **kw) -> DataFrame:
    """Value n rows earlier, else the key's mean."""
    return lag_features(df, keys, order, col, {name: n}, **kw)


def sequence_windows(df, keys, order, cols: Sequence[str], target_col: str, n=24, **kw) -> DataFrame:
    """The previous n rows as an array of structs next to the target; n rows per key fall away."""
    out = windowed(
        df, keys, order,
        {"features": lambda w: F.collect_list(F.struct(*cols)).over(w.rowsBetween(-n, -1))},
        halo=n, **kw,
    )
    return out.filter(F.size("features") == n).withColumn("target", F.col(target_col))


def interpolate_linear(df, keys, order, col, **kw) -> DataFrame:
    """Fill gaps in ``col`` linearly by row position; ends take the nearest value.

    Neighbours outside the chunk come from a table with one row per chunk.
    """
    rows = with_position(df, keys, order, **kw).withColumn(
        "_pt", F.when(F.col(col).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(col).alias("v")))
    )
    ends = rows.groupBy(*keys, "_chunk").agg(
        F.max_by("_pt", F.when(F.col("_pt").isNotNull(), F.col("_pos"))).alias("_last"),
        F.min_by("_pt", F.when(F.col("_pt").isNotNull(), F.col("_pos"))).alias("_first"),
    )
    # looking ahead is looking back in reverse order: a frame that grows row by row, where
    # one that ends at the last row would be evaluated anew for every row
    so_far = (Window.unboundedPreceding, 0)
    before_this = (Window.unboundedPreceding, -1)
    wk = Window.partitionBy(*keys)
    carry = ends.select(
        *keys, "_chunk",
        F.last("_last", True).over(wk.orderBy("_chunk").rowsBetween(*before_this)).alias("_in_prev"),
        F.last("_first", True).over(wk.orderBy(F.desc("_chunk")).rowsBetween(*before_this)).alias("_in_next"),
    )
    w = Window.partitionBy(*keys, "_chunk")
    near = rows.join(carry, [*keys, "_chunk"]).withColumns(
        {
            "_prev": F.coalesce(
                F.last("_pt", True).over(w.orderBy("_pos").rowsBetween(*so_far)), F.col("_in_prev")
            ),
            "_next": F.coalesce(
                F.last("_pt", True).over(w.orderBy(F.desc("_pos")).rowsBetween(*so_far)), F.col("_in_next")
            ),
        }
    )
    slope = (F.col("_next.v") - F.col("_prev.v")) / (F.col("_next.p") - F.col("_prev.p"))
    filled = (
        F.when(F.col(col).isNotNull(), F.col(col))
        .when(F.col("_prev").isNull(), F.col("_next.v"))
        .when(F.col("_next").isNull(), F.col("_prev.v"))
        .otherwise(F.col("_prev.v") + slope * (F.col("_pos") - F.col("_prev.p")))
    )
    return near.withColumn(col, filled).drop(
        "_pt", "_prev", "_next", "_in_prev", "_in_next", "_chunk", "_own", "_pos", "_n"
    )


def split_by_position(df, keys, order, ratio=0.8, horizon=None, **kw) -> DataFrame:
    """Adds ``part``: 'train' for the first int(n*ratio) rows, then 'test'.

    With ``horizon`` only the next ``horizon`` test rows stay.
    """
    rows = with_position(df, keys, order, **kw)
    cut = F.floor(F.col("_n") * F.lit(ratio))
    out = rows.withColumn("part", F.when(F.col("_pos") < cut, "train").otherwise("test"))
    if horizon is not None:
        out = out.filter(F.col("_pos") < cut + horizon)
    return out.drop("_n", "_chunk", "_own", "_pos")


def rolling_origin_folds(df, keys, order, folds=3, horizon=48, share=0.15, keep_train=True, **kw) -> DataFrame:
    """One row per (fold, row): origin of fold i = n - int(n*share) + i*(int(n*share)//folds)."""
    rows = with_position(df, keys, order, **kw)
    held = F.floor(F.col("_n") * F.lit(share))
    origin = F.col("_n") - held + F.col("fold") * F.floor(held / folds)
    out = (
        rows.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(folds)])))
        .withColumn("origin", origin)
        .withColumn("part", F.when(F.col("_pos") < F.col("origin"), "train").otherwise("validate"))
        .filter(F.col("_pos") < F.col("origin") + horizon)
    )
    if not keep_train:
        out = out.filter("part = 'validate'")
    return out.withColumn("step", F.col("_pos") - F.col("origin")).drop("_n", "_chunk", "_own", "_pos")


def cumulative_payback(flows: DataFrame, project: str, year="year", cash="cash_flow", capex="capex", default=20.0):
    """First year whose running cash turns non-negative, interpolated within the year.

    Groups are bounded by the planning horizon in years.
    """
    w = Window.partitionBy(project).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    run = flows.withColumn("_run", F.sum(cash).over(w) - F.col(capex))
    point = F.col(year) - 1 + F.try_divide(F.col(cash) - F.col("_run"), F.col(cash))
    return run.groupBy(project).agg(
        F.coalesce(F.min_by(point, F.when(F.col("_run") >= 0, F.col(year))), F.lit(default)).alias("payback_years")
    )


__all__ = [
    "before", "chunk_rows", "chunk_window", "cumulative_payback", "interpolate_linear", "lag_features",
    "lags", "lookback_join", "rolling", "rolling_origin_folds", "rolling_zscore", "sequence_windows",
    "split_by_position", "time_slot",
]
