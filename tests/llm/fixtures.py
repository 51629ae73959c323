"""Small tables with the awkward cases every corpus operator has to take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; tables may have columns of these names.
CLASHES = ["id", "key", "fp", "digest", "bucket", "size", "copies", "root", "node", "spans", "line", "row", "n", "begin", "_id"]
WORDS = ("ale bent crow dust elm fern gate hill iron jade kelp lamp mint nest oak pine quay reed salt tarn "
         "urn vale wren yarn zinc moss loam clay silt peat").split()


def prose(draw: random.Random, n: int) -> str:
    words = [draw.choice(WORDS) + draw.choice(["", "s", "ed", "ing", "er"]) for _ in range(n)]
    return " ".join(w + ("\n" if i % 13 == 12 else "") for i, w in enumerate(words)).replace("\n ", "\n")


def documents(seed: int = 1, n: int = 120) -> list[tuple]:
    """Prose with exact copies, near copies, nulls, blanks, a long text and repeated ids."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(draw, draw.choice([3, 40, 90, 200, 400]))
        if i % 9 == 4 and rows:
            text = draw.choice(rows)[1]  # exact copy
        elif i % 9 == 7 and rows:
            words = (draw.choice(rows)[1] or "").split(" ")
            words[len(words) // 2] = "altered"
            text = " ".join(words)  # near copy
        rows.append((i * 3, text, draw.choice(["en", "de", None]), f"s{min(i % 7, 3)}", len(text or "")))
    rows += [
        (1001, None, None, None, None), (1002, "", "en", "s0", 0), (1003, " \t\n ", "en", "s1", 4),
        (1004, "é ñ 漢字 \U0001f600", "fr", None, 8), (1005, prose(draw, 30_000), "en", "s0", 0),
        (1006, "word " * 300, "en", "s0", 1500), (1006, "word " * 300, "en", "s0", 1500), (None, "no id here", "en", "s2", 10),
        (1007, "x" * 50_000, "en", "s1", 50_000), (-5, prose(draw, 60), "en", "s1", 1),
    ]
    return rows


def frame(spark, rows, clash: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
