"""Repetitive and incompressible documents by bands of compression ratios."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrays import slices

LEVEL = 3
CHUNK_BYTES = 4096
#: From so many bytes on, a ratio (compressed / plain bytes) below the first number is repetitive
#: text and one above the second is not language.
WHOLE_BANDS = [(0, 0.0, 9.0), (256, 0.25, 0.98), (1024, 0.20, 0.85), (4096, 0.16, 0.75), (16384, 0.12, 0.70)]
CHUNK_BANDS = [(0, 0.0, 9.0), (1024, 0.12, 0.88), (4096, 0.12, 0.80)]
#: Upper limits of texts and chunks of which at least nine tenths of the bytes are ASCII, above the
#: greatest ratios measured on prose and manuals: 0.70 at 1 KB, 0.52 at 4 KB, 0.43 at 16 KB.
ASCII_LIMITS = [(0, 9.0), (1024, 0.72), (4096, 0.57), (16384, 0.49)]
_HIGH = bytes(range(128, 256))


def limits(n_bytes: int, bands: list[tuple[int, float, float]]) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(bands) if n_bytes >= least)


def outside(n_bytes: int, ratio: float, bands: list[tuple[int, float, float]]) -> bool:
    low, high = limits(n_bytes, bands)
    return not low <= ratio <= high


def too_dense(raw: bytes, ratio: float) -> bool:
    """Whether a mostly ASCII text has a ratio above the limit of its length."""
    limit = next(high for least, high in reversed(ASCII_LIMITS) if len(raw) >= least)
    return ratio > limit and 10 * len(raw.translate(None, _HIGH)) >= 9 * len(raw)


def compression(raw: bytes, squeeze, chunk_bytes: int = CHUNK_BYTES) -> tuple[float, float, float, int, int]:
    """Whole ratio, least and greatest chunk ratio, chunks, and chunks outside their band; 1.0 for no bytes."""
    if not raw:
        return 1.0, 1.0, 1.0, 0, 0
    chunks = [raw[i : i + chunk_bytes] for i in range(0, len(raw), chunk_bytes)]
    ratios = [len(squeeze(c)) / len(c) for c in chunks]
    whole = ratios[0] if len(chunks) == 1 else len(squeeze(raw)) / len(raw)
    bad = sum(outside(len(c), r, CHUNK_BANDS) or too_dense(c, r) for c, r in zip(chunks, ratios))
    return whole, min(ratios), max(ratios), len(chunks), bad


def word_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in them, symbols, repeated lines, and words in repeated three-word windows."""
    words = raw.split()
    letters = len(b"".join(words).decode())
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows: dict[tuple, int] = {}
    repeated = bytearray(len(words))
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        first = windows.setdefault(window, i)
        if first != i:
            repeated[i : i + 3] = b"\1\1\1"
            repeated[first : first + 3] = b"\1\1\1"
    return len(words), letters, symbols, len(lines) - len(set(lines)), sum(repeated)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``ratio``, ``chunk_min``, ``chunk_max``, ``bad_chunks``, ``kept``.

    A document fails the base rules with under 50 words or more than half of them in repeated
    three-word windows.  Others are kept if the whole text's ratio lies in the band of its
    length, below the limit for ASCII if it is mostly that, and at most a quarter of its 4 KB
    chunks lie outside theirs.  Null is the empty
    text: no words, ratio 1, failed.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes",
             "ratio", "chunk_min", "chunk_max", "n_chunks", "bad_chunks", "in_band"]

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in slices(batches, "text"):
            rows = []
            for raw in (x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()):
                whole, low, high, n, bad = compression(raw, squeeze)
                good = not (outside(len(raw), whole, WHOLE_BANDS) or too_dense(raw, whole)) and 4 * bad <= n
                rows.append((*word_counts(raw), len(raw), whole, low, high, n, bad, good))
            columns = [pa.array(c) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *names])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = ["long"] * 6 + ["double"] * 3 + ["long"] * 2 + ["boolean"]
    found = picked.mapInArrow(
        run, ", ".join([f"id {picked.schema['id'].dataType.simpleString()}", *(f"{n} {k}" for n, k in zip(names, kinds))])
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select(
        F.col("id").alias(id_col), *names[:5], failed.alias("base_failed"), "ratio", "chunk_min", "chunk_max", "bad_chunks",
        (~failed & F.col("in_band")).alias("kept"),
    )
