"""Isolation forests: sampled, built per tree on executors, scored where the rows are.

Trees see at most 256 rows each, so the model is at most trees x 511 nodes whatever the
data size; that small table is the only thing the driver reads.  All random numbers are
digests of what they are drawn for (row and tree, or tree, node and draw), so samples, splits
and scores do not depend on partitioning and any SQL engine can draw them again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.robust import exact_quantile

EULER = 0.5772156649
NODE_SCHEMA = (
    "tree int, node int, left int, right int, size int, depth int, feature int, cut double, "
    "normal array<double>, point array<double>"
)


def path_correction(n):
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 2.0)
    full = 2.0 * (np.log(m - 1.0 + (m == 1)) + EULER) - 2.0 * (m - 1.0) / m
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, full))


BITS = 52  # of a digest; a double holds them all


def uniform(*parts) -> Column:
    """A number in [0, 1) from the digest of the parts, joined by ``|``."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") if isinstance(p, str) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long") / float(1 << BITS)


def draw(*parts) -> float:
    """``uniform`` of one draw, in Python."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[: BITS // 4], 16) / (1 << BITS)


def _lots(row_id: Sequence[str], round_: Column, seed: int) -> Column:
    """Trees to skip before the next hit: geometric with the hit rate ``_p``."""
    u = uniform(*row_id, round_, seed) + 1.0 / (1 << BITS)
    return F.floor(F.log(u) / F.log(1.0 - F.col("_p"))).cast("long")


def sample_per_tree(df: DataFrame, row_id: Sequence[str], trees: int, sample: int, seed: int) -> DataFrame:
    """``sample`` rows (or all, if fewer) for each tree, without replacement, from the whole table.

    Each row and tree meet with such a probability that a tree meets about twice ``sample``
    rows.  A row skips from hit to hit by geometric draws, so most rows cost one draw for all
    trees.  Of a tree's hits those with the smallest hashes are its sample; about
    2 x trees x sample rows are shuffled at any table size.
    """
    n = df.count()
    rate = 2.0 * sample / max(n, 1)
    if rate >= 0.5:  # a table of a few samples: every row meets every tree
        hits = F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))
        met = df.withColumn("_hits", hits)
    else:
        first = df.withColumn("_p", F.lit(rate)).withColumn("_first", _lots(row_id, F.lit(0), seed)).filter(F.col("_first") < trees)
        none = F.array().cast("array<bigint>")
        start = F.struct(F.col("_first").alias("at"), F.array("_first").alias("hits"))

        def hop(state, i):  # a row beyond the last tree draws no more
            at = F.when(state["at"] < trees, state["at"] + 1 + _lots(row_id, i, seed)).otherwise(state["at"])
            return F.struct(at.alias("at"), F.concat(state["hits"], F.when(at < trees, F.array(at)).otherwise(none)).alias("hits"))

        met = first.withColumn("_hits", F.aggregate(F.sequence(F.lit(1), F.lit(trees)), start, hop)["hits"]).drop("_p", "_first")
    draws = met.withColumn("tree", F.explode(F.col("_hits").cast("array<int>"))).drop("_hits").withColumn(
        "_draw", uniform(*row_id, F.col("tree"), seed + 1)
    )
    w = Window.partitionBy("tree").orderBy("_draw", *row_id)
    return draws.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= sample).drop("_rn", "_draw")


def _grow(x: np.ndarray, tree: int, seed: int, extended: bool) -> list[dict]:
    """Split at random until single rows or the depth limit; nodes in creation order.

    Draws are named by the node's place: 1 for the root, 2k and 2k + 1 below place k.
    """
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[dict] = []
    todo = [(np.arange(len(x)), 1, None, "")]
    while todo:
        rows, place, parent, side = todo.pop()
        me, depth = len(nodes), place.bit_length() - 1
        nodes.append(dict(tree=tree, node=me, left=-1, right=-1, size=len(rows), depth=depth,
                          feature=-1, cut=0.0, normal=None, point=None))
        if parent is not None:
            nodes[parent][side] = me
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        if depth >= limit or len(rows) <= 1 or not (hi > lo).any():
            continue
        if extended:
            # directions of two uniforms each: normal by the polar form, so that none is preferred
            u = [[draw(tree, place, f, i, seed) for i in range(3)] for f in range(x.shape[1])]
            normal = [math.sqrt(-2.0 * math.log(a + 1.0 / (1 << BITS))) * math.cos(2.0 * math.pi * b) for a, b, _ in u]
            point = [low + c * (high - low) for (_, _, c), low, high in zip(u, lo.tolist(), hi.tolist())]
            goes_left = sum((part[:, f] - point[f]) * normal[f] for f in range(x.shape[1])) < 0
            if goes_left.all() or not goes_left.any():
                continue
            nodes[me] |= {"normal": normal, "point": point}
        else:
            open_features = np.flatnonzero(hi > lo)
            f = int(open_features[int(draw(tree, place, "feature", seed) * len(open_features))])
            cut = float(lo[f] + draw(tree, place, "cut", seed) * (hi[f] - lo[f]))
            goes_left = part[:, f] <= cut
            if goes_left.all():  # neighbouring numbers, between which no cut has room
                cut = float(part[part[:, f] < hi[f], f].max())
                goes_left = part[:, f] <= cut
            nodes[me] |= {"feature": f, "cut": cut}
        todo.append((rows[~goes_left], 2 * place + 1, me, "right"))
        todo.append((rows[goes_left], 2 * place, me, "left"))
    return nodes


def fit(
    df: DataFrame, features: Sequence[str], row_id: Sequence[str], trees=100, sample=256, seed=42, extended=False
) -> DataFrame:
    """Node table of the forest, one task per tree."""
    cols = list(features)
    drawn = sample_per_tree(df.select(*row_id, *[F.col(c).cast("double") for c in cols]), row_id, trees, sample, seed)
    order = list(row_id)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame(_grow(pdf[cols].to_numpy(float), int(pdf["tree"].iloc[0]), seed, extended))

    # a fixed number of partitions, so that the few rows are not merged into one task
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    return drawn.repartition(tasks, "tree").groupBy("tree").applyInPandas(build, NODE_SCHEMA)


def _compile(nodes: pd.DataFrame, extended: bool) -> list[dict]:
    """Trees as arrays; leaves lead to themselves, so all rows take the same steps."""
    forest = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree", sort=True):
        leaf, me = t["left"].to_numpy() < 0, np.arange(len(t))
        next_node = np.empty(2 * len(t), np.intp)  # right child, then left child, per node
        next_node[0::2] = np.where(leaf, me, t["right"])
        next_node[1::2] = np.where(leaf, me, t["left"])
        width = len(next((p for p in t["point"] if p is not None), []))
        fill = lambda v: np.stack([np.zeros(width) if p is None else np.asarray(p, float) for p in v])
        forest.append({
            "rows": int(t["size"].iloc[0]), "steps": int(t["depth"].max()), "next": next_node,
            "feature": np.where(leaf, 0, t["feature"]).astype(np.intp), "cut": t["cut"].to_numpy(),
            "length": t["depth"].to_numpy() + path_correction(t["size"].to_numpy()),
            "normal": fill(t["normal"]) if extended and width else None,
            "point": fill(t["point"]) if extended and width else None,
        })
    return forest


def _mean_path(x: np.ndarray, forest: list[dict]) -> np.ndarray:
    total, flat = np.zeros(len(x)), np.ascontiguousarray(x).reshape(-1)
    begins = np.arange(0, flat.size, x.shape[1])
    for t in forest:
        at = np.zeros(len(x), np.intp)
        for _ in range(t["steps"]):
            if t["normal"] is not None:
                left = np.einsum("ij,ij->i", x - t["point"][at], t["normal"][at]) < 0
            else:
                left = flat.take(t["feature"].take(at) + begins) <= t["cut"].take(at)
            at = t["next"].take(2 * at + left)
        total += t["length"].take(at)
    return total / max(len(forest), 1)


def score(df: DataFrame, nodes: DataFrame, features: Sequence[str], sample=256, extended=False, name="score") -> DataFrame:
    """Anomaly score 2^(-mean path / c); works on batch and streaming rows."""
    forest = _compile(nodes.toPandas(), extended)
    fitted = sample if extended else min(sample, max(t["rows"] for t in forest))
    norm = float(path_correction(fitted)) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def rate(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = shared.value
        for cols in batches:
            x = np.column_stack([c.to_numpy(float) for c in cols])
            yield pd.Series(np.power(2.0, -_mean_path(x, trees) / norm))

    return df.withColumn(name, rate(*[F.col(c).cast("double") for c in features]))


def score_cutoffs(scored: DataFrame, rates: Sequence[float], name="score") -> DataFrame:
    """(rate, cutoff): the score at the upper ``rate`` quantile, linearly interpolated and exact."""
    out = None
    for r in rates:
        one = exact_quantile(scored.select(F.lit(float(r)).alias("rate"), name), ["rate"], 1.0 - r, name, "cutoff")
        out = one if out is None else out.unionByName(one)
    return out.select("rate", "cutoff")


def _above(score, cutoff, inclusive: bool):
    return score >= cutoff if inclusive else score > cutoff


def flag(scored: DataFrame, rate: float, name="score", inclusive=False) -> DataFrame:
    """Adds ``is_outlier`` and ``anomaly_score`` (negative for outliers).

    A score equal to the cutoff counts as normal, or as an outlier with ``inclusive``.
    """
    cut = score_cutoffs(scored, [rate], name).select("cutoff").scalar()
    return scored.withColumn("cutoff", cut).withColumn("anomaly_score", F.round(F.col("cutoff") - F.col(name), 6)).withColumn(
        "is_outlier", _above(F.col(name), F.col("cutoff"), inclusive)
    ).drop("cutoff")


def contamination_sweep(scored: DataFrame, rates: Sequence[float], truth="y_true", name="score") -> DataFrame:
    """Score once; measures for several contamination rates side by side."""
    from gridloom.operators.aggregates import detection_metrics

    cuts = score_cutoffs(scored, rates, name)
    each = F.explode(F.array(*[F.lit(float(r)) for r in rates]))
    grid = scored.select(truth, name).withColumn("rate", each).join(cuts, "rate").withColumn(
        "y_pred", _above(F.col(name), F.col("cutoff"), False).cast("int")
    )
    return detection_metrics(grid, ["rate"], truth, "y_pred")


__all__ = ["contamination_sweep", "fit", "flag", "path_correction", "score", "score_cutoffs"]
