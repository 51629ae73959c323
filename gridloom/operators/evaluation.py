"""Scaling, paired tests, bootstrap and prediction intervals from small sufficient counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import stored

Z_80, Z_95 = 1.2816, 1.96  # normal quantiles of two-sided 80 % and 95 % bands


def standard_scale(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix="_z") -> DataFrame:
    """Population z-scores; a constant column scales by 1.

    The statistics are stored: few keys are then broadcast by measured size, and their rows
    stay where they are.
    """
    stats = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}_sd") for c in cols]
    )
    if keys:
        joined = df.join(stored(stats, "scales"), list(keys))
    else:
        one = stats.select(F.struct(*stats.columns)).scalar()
        joined = df.withColumn("_s", one).select("*", "_s.*").drop("_s")
    sd = lambda c: F.when(F.col(f"{c}_sd") > 0, F.col(f"{c}_sd")).otherwise(1.0)
    return joined.withColumns({c + suffix: (F.col(c) - F.col(f"{c}_mean")) / sd(c) for c in cols})


def unscale(df: DataFrame, cols: Sequence[str], suffix="_z", name="_back") -> DataFrame:
    sd = lambda c: F.when(F.col(f"{c}_sd") > 0, F.col(f"{c}_sd")).otherwise(1.0)
    return df.withColumns({c + name: F.col(c + suffix) * sd(c) + F.col(f"{c}_mean") for c in cols})


def mcnemar(df: DataFrame, keys: Sequence[str] = (), truth="y_true", a="pred_a", b="pred_b") -> DataFrame:
    """Paired test of two detectors with continuity correction; p from the normal tail."""
    ra, rb = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    out = df.groupBy(*keys).agg(
        F.count_if(ra & rb).alias("both_right"), F.count_if(ra & ~rb).alias("only_a"),
        F.count_if(~ra & rb).alias("only_b"), F.count_if(~ra & ~rb).alias("both_wrong"),
    )
    off = F.col("only_a") + F.col("only_b")
    gap = F.abs(F.col("only_a") - F.col("only_b")) - 1.0
    return out.withColumn("chi2", F.when(off > 0, gap * gap / off))


def mcnemar_p_value(result: DataFrame) -> DataFrame:
    """p = erfc(sqrt(chi2 / 2)) on the result rows of ``mcnemar``."""
    import math

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2.0)) if v == v and v is not None else None)

    return result.withColumn("p_value", tail("chi2"))


def bootstrap_far_difference(
    df: DataFrame, truth="y_true", a="pred_a", b="pred_b", draws=1000, seed=42
) -> DataFrame:
    """Mean and 95 % interval of the false-alarm-rate difference of b over a.

    Resampling rows with replacement only changes how often each (truth, a, b) cell
    occurs, so the table is reduced to at most 8 counts and the draws are multinomial.
    """
    cells = df.groupBy(truth, a, b).agg(F.count(F.lit(1)).alias("c"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([truth, a, b])
        c = pdf["c"].to_numpy(float)
        n = int(c.sum())
        times = np.random.default_rng(seed).multinomial(n, c / n, size=draws).astype(float)
        wrong = (pdf[truth] == 0).to_numpy()

        def far(pred):
            on = (pdf[pred] == 1).to_numpy()
            flagged, false = times[:, on].sum(axis=1), times[:, on & wrong].sum(axis=1)
            return np.divide(false, flagged, out=np.zeros(draws), where=flagged > 0)

        diff = far(b) - far(a)
        lo, hi = np.percentile(diff, [2.5, 97.5])
        return pd.DataFrame({"draws": [draws], "mean_diff": [diff.mean()], "lower": [lo], "upper": [hi]})

    return cells.groupBy(F.lit(1).alias("_all")).applyInPandas(
        draw, "draws bigint, mean_diff double, lower double, upper double"
    )


def prediction_interval(df: DataFrame, keys: Sequence[str], actual="actual", predicted="predicted", z=Z_95) -> DataFrame:
    """Predictions with ± z population deviations of the key's residuals."""
    spread = df.groupBy(*keys).agg(F.stddev_pop(F.col(actual) - F.col(predicted)).alias("_sd"))
    return df.join(spread, list(keys)).withColumns({
        "lower": F.col(predicted) - z * F.col("_sd"), "upper": F.col(predicted) + z * F.col("_sd"),
    }).drop("_sd")
