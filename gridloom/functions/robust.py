"""Exact medians for groups of any size.

A mergeable quantile sketch brackets the middle of each group; exact counts below the
bracket and the value counts inside it then give the exact middle.  Only values inside
the narrow bracket are shuffled, already counted per distinct value, and the bracket is
divided into cells of which only the one or two that hold the middle are sorted.  So
neither a hot group nor a hot value gathers its rows in one task.  Brackets and medians have
one row per group; they are stored, so that Spark joins them by their measured size and the
values of a few large groups are not shuffled to a task per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import stored

SKETCH_ACCURACY = 1000
REACH = 0.01  # of the bracket, to both sides of the quantile
CELLS = 1024


def long_form(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, feature, value) without null values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    return (
        df.select(*keys, F.explode(pairs).alias("_p"))
        .select(*keys, "_p.feature", "_p.value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
    )


def exact_median(values: DataFrame, group: Sequence[str], col="value", name="median") -> DataFrame:
    """(group, n, name): the middle value, or the mean of the two middle values."""
    return exact_quantile(values, group, 0.5, col, name)


def exact_quantile(values: DataFrame, group: Sequence[str], q: float, col="value", name="quantile") -> DataFrame:
    """(group, n, name): the value at the share ``q``, interpolated between neighbours."""
    group = list(group)
    around = [max(0.0, q - REACH), min(1.0, q + REACH)]
    bracket = values.groupBy(*group).agg(
        F.count(col).alias("n"),
        F.percentile_approx(col, around, SKETCH_ACCURACY).alias("_b"),
    ).withColumn("_lo", F.col("_b")[0]).withColumn("_hi", F.col("_b")[1]).drop("_b")
    bracket = stored(bracket, "bracket")
    # cell -1 holds everything below the bracket, cells 0.. divide the bracket evenly
    place = F.coalesce(
        F.floor(F.try_divide(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * CELLS), F.lit(0)
    )
    tagged = values.join(bracket, group).filter(F.col(col) <= F.col("_hi")).select(
        *group, "n",
        F.when(F.col(col) < F.col("_lo"), F.lit(-1)).otherwise(place).alias("_cell"),
        F.when(F.col(col) >= F.col("_lo"), F.col(col)).alias("_v"),
    )
    counts = stored(tagged.groupBy(*group, "n", "_cell", "_v").agg(F.count(F.lit(1)).alias("_c")), "counts")

    at = (F.col("n") - 1) * q
    low = F.floor(at) + 1
    ranks = [low, F.least(low + 1, F.col("n"))]

    def holds(rank, width):
        return (F.col("_upto") >= rank) & (F.col("_upto") - F.col(width) < rank)

    by_cell = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        counts.groupBy(*group, "n", "_cell").agg(F.sum("_c").alias("_w"))
        .withColumn("_upto", F.sum("_w").over(by_cell))
        .filter(holds(ranks[0], "_w") | holds(ranks[1], "_w"))
        .select(*group, "_cell", (F.col("_upto") - F.col("_w")).alias("_before"))
    )
    in_cell = Window.partitionBy(*group, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(cells, [*group, "_cell"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(in_cell))
    ends = [F.max(F.when(holds(rank, "_c"), F.col("_v"))).alias(f"_{i}") for i, rank in enumerate(ranks)]
    between = F.col("_0") + (F.col("_1") - F.col("_0")) * (at - F.floor(at))
    middle = (F.col("_0") + F.col("_1")) / 2 if q == 0.5 else between
    if q == 0.5:
        middle = F.when(F.col("n") % 2 == 1, F.col("_0")).otherwise(middle)
    return ranked.groupBy(*group, "n").agg(*ends).select(*group, "n", middle.alias(name))


def median_and_mad(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, feature, n, median, mad) with the raw median absolute deviation."""
    values = long_form(df, keys, cols)
    group = [*keys, "feature"]
    medians = stored(exact_median(values, group), "medians")
    spread = values.join(medians.select(*group, "median"), group).withColumn(
        "value", F.abs(F.col("value") - F.col("median"))
    )
    mads = exact_median(spread.drop("median"), group, name="mad").drop("n")
    return medians.join(mads, group)
