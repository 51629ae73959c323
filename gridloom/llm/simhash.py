"""Near duplicates by SimHash fingerprints, pigeonhole blocks and Hamming checks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.arrays import slices, utf8
from gridloom.llm.components import components
from gridloom.session import stored

BLOCKS, BLOCK_BITS, DISTANCE = 4, 16, 2
SMALL_BUCKET = 64


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if set in over half of the shingle hashes; no word: 0."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, seed) for g in grams], "<u8")
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 14):
        chunk = hashes[part : part + (1 << 14)]
        ones += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """``id`` and ``fp`` (64 bits in a long) of every document."""

    def run(batches):
        for batch in slices(batches, "text"):
            found = np.array([simhash(t, shingle) for t in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, fp long")


def _keep_bits(fp: Column, blocks: tuple[int, ...]) -> Column:
    mask = sum(((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * b) for b in blocks)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _flips(fp: Column, blocks: tuple[int, ...]) -> Column:
    """The value itself and with each one of the bits outside ``blocks`` flipped."""
    masks = [1 << (BLOCK_BITS * b + i) for b in range(BLOCKS) if b not in blocks for i in range(BLOCK_BITS)]
    return F.array(fp, *(fp.bitwiseXOR(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks))


def close_pairs(distinct: DataFrame) -> tuple[DataFrame, int]:
    """Edges (a, b) that join fingerprints at 2 or fewer differing bits, with the same components
    as all such pairs, and a bound of their number.

    Two differing bits leave at least two of four 16-bit blocks equal, so the pair shares one
    of the six 32-bit block pairs.  Buckets of up to 64 distinct fingerprints are joined with
    themselves and checked by Hamming distance.  In a larger bucket the other 32 bits differ
    in at most two places, so close fingerprints meet in a value one flip away from each; a
    star per such value (33 rows per member) stands for its pairs.  No pair is left out.
    """
    choices = list(combinations(range(BLOCKS), 2))
    keys = F.array(*(
        F.struct(F.lit(i).alias("choice"), _keep_bits(F.col("fp"), c).alias("part")) for i, c in enumerate(choices)
    ))
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.choice", "k.part")
    sizes = rows.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(rows.join(sizes.hint("merge"), ["choice", "part"]), "blocks", len(choices) * distinct.count())
    members = shared.agg(F.count(F.lit(1)), F.count_if(F.col("n") > SMALL_BUCKET)).first()
    small = shared.where(F.col("n") <= SMALL_BUCKET)
    pairs = (
        small.select("choice", "part", F.col("fp").alias("a"))
        .join(small.select("choice", "part", F.col("fp").alias("b")), ["choice", "part"])
        .where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
        .select("a", "b")
    )
    flips = F.lit(None).cast("array<long>")
    for i, c in enumerate(choices):
        flips = F.when(F.col("choice") == i, _flips(F.col("fp"), c)).otherwise(flips)
    meets = shared.where(F.col("n") > SMALL_BUCKET).select("choice", "fp", F.explode(flips).alias("meet"))
    around = W.partitionBy("choice", "meet")  # a value and those one flip away: 33 rows at most
    spokes = meets.withColumn("a", F.min("fp").over(around)).where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(spokes), members[0] * SMALL_BUCKET // 2 + members[1] * 33


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``.

    The component is the smallest id reachable over links of at most two differing bits; ids are of
    any type that has an order.
    Null and empty texts have fingerprint zero and link like any other.  Rows that repeat an
    id count as documents of their own with that id; a row without id is linked, but gives
    its component no id (null if no member has one).
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct", rows.count())
    pairs, most = close_pairs(distinct.select("fp"))
    roots = components(pairs, "a", "b", most)
    linked = stored(distinct.select("fp", "least").join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp"), "linked", distinct.count())
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # fingerprints that stand for one row, and are linked to none, need no entry
    named = stored(
        linked.join(least.hint("merge"), "root").select("fp", "component_id")
        .union(distinct.where("n > 1").select("fp", "least"))
        .groupBy("fp").agg(F.min("component_id").alias("component_id"), F.lit(True).alias("named")), "named", distinct.count(),
    )
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("id"))
    return rows.join(named.hint("merge"), "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id")
    )
