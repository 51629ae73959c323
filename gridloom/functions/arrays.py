"""Array columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 256


def with_running_sums(df: DataFrame, col: str, name: str) -> DataFrame:
    """Adds ``name``: to each place of the array ``col`` (long, no nulls) the sum up to and with it.

    Sums are taken within parts of 256 entries, then the parts' totals are added, so that the
    work grows with the length and not with its square.
    """
    n_parts = F.ceil(F.size(col) / PART).cast("int")
    cut = F.filter(
        F.transform(F.sequence(F.lit(0), F.greatest(n_parts - 1, F.lit(0))), lambda p: F.slice(col, p * PART + 1, F.lit(PART))),
        lambda part: F.size(part) > 0,
    )
    zero = F.array(F.lit(0).cast("long"))

    def summed(part):
        return F.aggregate(part, zero, lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    out = df.withColumn("_parts", F.transform(cut, summed))
    bases = F.aggregate("_parts", zero, lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(p, -1))))
    moved = F.zip_with("_parts", F.slice(bases, F.lit(1), F.size("_parts")), lambda p, base: F.transform(
        F.slice(p, F.lit(2), F.size(p) - 1), lambda v: v + base
    ))
    return out.withColumn(name, F.flatten(moved)).drop("_parts")
