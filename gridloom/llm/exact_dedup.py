"""Exact duplicates through minimal perfect hashes over the digests of an earlier corpus."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrays import mix64
from gridloom.session import stored

DIGESTS_PER_TABLE = 8_192
_LOAD = 1.7  # bits per key and level


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space as one space; null is empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "), 256))


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(digests.tobytes(), "<u8").reshape(-1, 4)
    return words[:, 1].copy(), words[:, 2] | np.uint64(1)


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(a + b * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)


def build_slots(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Minimal perfect hash of distinct 32-byte digests.

    Level by level, keys that are alone at their place get its bit; the others go on to a
    next, smaller level.  A key's slot is the number of set bits before its own.  Returns
    the levels' bits and the slot of each key: a permutation of 0 .. n-1.
    """
    a, b = _halves(digests)
    slots, rest, levels, used = np.full(len(a), -1, np.int64), np.arange(len(a)), [], 0
    while len(rest):
        size = max(64, int(len(rest) * _LOAD))
        places = _places(a[rest], b[rest], len(levels), size)
        bits = np.bincount(places, minlength=size) == 1
        alone = bits[places]
        slots[rest[alone]] = used + (np.cumsum(bits) - 1)[places[alone]]
        used += int(bits.sum())
        levels.append(bits)
        rest = rest[~alone]
    return levels, slots


def find_slots(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot that each digest would have (-1: none); a stranger may get any slot."""
    a, b = _halves(digests)
    slots, rest, used = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    for k, bits in enumerate(levels):
        places = _places(a[rest], b[rest], k, len(bits))
        hit = bits[places]
        slots[rest[hit]] = used + (np.cumsum(bits) - 1)[places[hit]]
        used += int(bits.sum())
        rest = rest[~hit]
    return slots


def _stack(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _build(part: pd.DataFrame) -> pd.DataFrame:
    digests = _stack(part["digest"])
    levels, slots = build_slots(digests)
    order = np.argsort(slots)
    return pd.DataFrame({
        "bucket": part["bucket"].iloc[:1].to_numpy(),
        "levels": [[np.packbits(x).tobytes() for x in levels]],
        "sizes": [[len(x) for x in levels]],
        "slot_digests": [digests[order].tobytes()],
        "slot_locators": [part["locator"].to_numpy(np.int64)[order].tobytes()],
    })


def _look_up(part: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    found = np.zeros(len(part), np.int64)
    member = np.zeros(len(part), bool)
    if len(part) and len(table):
        row = table.iloc[0]
        levels = [
            np.unpackbits(np.frombuffer(x, np.uint8))[:n].astype(bool) for x, n in zip(row["levels"], row["sizes"])
        ]
        keys = _stack(part["digest"])
        held = np.frombuffer(row["slot_digests"], np.uint8).reshape(-1, 32)
        slots = find_slots(levels, keys)
        member = (slots >= 0) & (held[slots] == keys).all(axis=1)
        found[member] = np.frombuffer(row["slot_locators"], "<i8")[slots[member]]
    out = part[["digest", "locator", "copies"]].copy()
    out["known"] = pd.Series(found, index=part.index, dtype="Int64").where(pd.Series(member, index=part.index))
    return out


def _distinct(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.min("locator").alias("locator"), F.count(F.lit(1)).alias("copies"))


def winners(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """``digest``, ``keep``, ``copies`` of every text of two tables of (digest, locator).

    The history's distinct digests are dealt into tables of about 8 000 by their leading
    bits; each becomes a minimal perfect hash whose slots hold the full digest and the
    winner's locator.  Distinct incoming digests are looked up in the table of their bits and
    compared byte by byte: members take the stored winner, which lies before any incoming one,
    and add their copies to its group; nonmembers are groups of their own.
    """
    old = stored(_distinct(history), "history", history.count())
    bits = max(0, math.ceil(math.log2(max(1, old.count()) / DIGESTS_PER_TABLE)))
    bucket = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - bits).alias("bucket")
    tables = old.select(bucket, "digest", "locator").groupBy("bucket").applyInPandas(
        _build,
        "bucket long, levels array<binary>, sizes array<long>, slot_digests binary, slot_locators binary",
    )
    new = _distinct(incoming).select(bucket, "digest", "locator", "copies")
    looked_up = stored(new.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInPandas(
        _look_up, "digest binary, locator long, copies long, known long"
    ), "looked-up")
    members = looked_up.where("known is not null").select("digest", F.col("known").alias("locator"), "copies")
    grown = old.unionByName(members).groupBy("digest").agg(F.min("locator").alias("keep"), F.sum("copies").alias("copies"))
    return grown.unionByName(looked_up.where("known is null").select("digest", F.col("locator").alias("keep"), "copies"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after each run of ASCII white space became one space;
    null is the empty text.  Rows with ids below ``split`` (default: the middle of the id
    range) are the history, the others come in against it; either way the smallest id of
    equal texts stays.  Rows that repeat an id and a text share its verdict and count each.
    A row without id comes last: it stays only if no equal text has an id, and then all
    such rows share the verdict.  Other columns are not looked at.
    """
    rows = stored(
        docs.select(F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("digest")), "digests"
    )
    if split is None:
        ends = rows.agg(F.min("id").alias("a"), F.max("id").alias("z")).first()
        split = 0 if ends["a"] is None else ends["a"] + (ends["z"] - ends["a"] + 1) // 2
    last = (1 << 63) - 1  # locator of rows without id
    located = rows.select("digest", F.coalesce("id", F.lit(last)).alias("locator"))
    groups = winners(located.where(F.col("locator") < split), located.where(F.col("locator") >= split))
    # read again as a table, so that the join can split the rows of a large group
    joined = rows.join(stored(groups.where("copies > 1"), "groups", rows.count()).hint("merge"), "digest", "left")
    keep = F.coalesce(F.col("keep"), F.col("id"), F.lit(last))
    return joined.select(
        F.col("id").alias(id_col),
        F.when(keep != last, keep).alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        (keep == F.coalesce("id", F.lit(last))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
