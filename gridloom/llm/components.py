"""Connected components of an edge table by distributed union-find."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.session import ROWS_PER_FILE, stored


def forest(batches):
    """Replace the edges of a partition by stars around the smallest node of each local component.

    Rows are handled batch by batch, so memory follows a batch: what one batch links, later
    rounds join with the others.
    """
    for batch in batches:
        parent: dict = {}

        def root(x):
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[i] for p in pairs], batch.schema.field(i).type) for i in (0, 1)], names=["u", "v"]
        )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """``node``, ``root``: the smallest node reachable, for every node that has an edge.

    Local forests shrink each partition first.  Then rounds of large-star and small-star run
    until nothing changes; an edge points from its larger node ``u`` to its smaller node ``v``.
    Large-star moves an edge on to the smallest neighbour of ``v``; the centre of a star has
    no smaller neighbour, so the spokes of a large star stay where they are and are joined
    with few rows.  Small-star links all smaller neighbours of ``u`` to the smallest one.  The
    number of rounds is logarithmic in the longest path.  Each round is written to the shared
    folder; the driver sees a count and a checksum only.  Nulls and loops are left out.
    ``rows`` bounds the number of edges, if known; the number of tasks follows it.
    """
    kind = edges.schema[a].dataType.simpleString()
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    # a forest edge points from any node of a tree to its root, the smallest one
    if rows is not None:
        pairs = pairs.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    current = stored(pairs.mapInArrow(forest, f"u {kind}, v {kind}"), "edges")
    before = _state(current)
    smaller = W.partitionBy("u")
    while before[0]:
        least = current.groupBy(F.col("u").alias("inner")).agg(F.min("v").alias("m"))
        moved = current.join(least.hint("merge"), F.col("v") == F.col("inner"), "left").select("u", F.coalesce("m", "v").alias("v"))
        starred = moved.withColumn("m", F.min("v").over(smaller))
        current = stored(
            starred.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")),
            "edges", before[0],
        )
        after = _state(current)
        if after == before:
            break
        before = after
    spokes = current.distinct()
    return spokes.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
