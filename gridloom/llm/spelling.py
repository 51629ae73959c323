"""Spelling variants: words at one edit, by integer pairs of nodes of a forward and a reversed trie."""

from __future__ import annotations

from collections import Counter
from itertools import repeat
from os.path import commonprefix
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.arrays import slices, utf8
from gridloom.session import stored

LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
TYPO_EVERY = 97
WORDS_PER_TASK = 20_000
HELD_WORDS = 200_000  # words whose counts a task holds before it sends them on
#: Latin-1 bytes: letters as they are but A-Z in lower case, all else (also '?' for what is no Latin-1) a space.
_LETTERS = bytes(ord(chr(c).lower()) if chr(c).isascii() and chr(c).isalpha() else c if c >= 0xC0 else 32 for c in range(256))
_PART = 40  # bits below a node's partition number


def planted_typo(run: bytes, prefix: int, every: int = TYPO_EVERY) -> bytes:
    """The run (Latin-1) without one letter if ``every`` divides the checksum of id, colon and run."""
    h = crc32(run.decode("latin-1").encode(), prefix)
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = TYPO_EVERY) -> DataFrame:
    """``word``, ``n``: runs of A-Z, a-z and U+00C0 to U+00FF of all texts, A-Z in lower case, each with
    its planted typo if its document has one for it.  Null ids count as the text ``null``."""
    picked = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        held: Counter = Counter()

        def flush():
            made = pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )
            held.clear()
            return made

        for batch in slices(batches, "text"):
            for doc, raw in zip(batch.column("id").to_pylist(), utf8(batch.column("text"))):
                found = Counter(raw.decode("utf-8", "replace").encode("latin-1", "replace").translate(_LETTERS).split())
                prefix = crc32(f"{doc}:".encode())
                runs = list(found)
                coded = runs if all(map(bytes.isascii, runs)) else [r.decode("latin-1").encode() for r in runs]
                sums = np.fromiter(map(crc32, coded, repeat(prefix)), np.uint32, len(runs))
                for i in np.flatnonzero(sums % every == 0).tolist():
                    n = found.pop(runs[i])
                    # not back into found, where another run may equal the result
                    held[planted_typo(runs[i], prefix, every)] += n
                held.update(found)
            if len(held) >= HELD_WORDS:
                yield flush()
        if held:
            yield flush()

    counted = picked.mapInArrow(count, "word string, n long").where("word <> ''")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def numbered_paths(words: DataFrame, key: str, keep: list[str], rows: int) -> DataFrame:
    """``keep`` columns, ``rank`` and ``nodes``: numbers of the trie nodes on the way to each distinct ``key``, root (-1) first.

    Words are sorted by range; a task walks its words with the path of the word before, and
    numbers the nodes that a word does not share with it.  The first nodes of a task may belong
    to words of the task before: the paths at the borders of tasks, one word each, say which,
    and these nodes take the earlier numbers.  ``rank`` grows in the order of ``key``.
    """
    kept = [words.schema[c] for c in keep]

    def walk(batches):
        base, rank, fresh = TaskContext.get().partitionId() << _PART, 0, 0
        before, path = "", []
        for batch in batches:
            nodes, ends, ranks = [], [0], []
            for word in batch.column("_key").to_pylist():
                shared = len(commonprefix((before, word)))
                del path[shared:]
                path.extend(range(base + fresh, base + fresh + len(word) - shared))
                fresh += len(word) - shared
                nodes.extend(path)
                ends.append(len(nodes))
                ranks.append(base + rank)
                rank, before = rank + 1, word
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(nodes, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ranks, pa.int64()), lists], names=[*batch.schema.names, "rank", "nodes"]
            )

    parts = max(1, -(-rows // WORDS_PER_TASK))
    ordered = words.select(F.col(key).alias("_key"), *keep).repartitionByRange(parts, "_key").sortWithinPartitions("_key")
    schema = ", ".join(["_key string", *(f"{f.name} {f.dataType.simpleString()}" for f in kept), "rank long", "nodes array<long>"])
    local = stored(ordered.mapInArrow(walk, schema), "trie")
    part = F.shiftright("rank", _PART)
    borders = local.groupBy(part.alias("part")).agg(
        F.min_by("_key", "rank").alias("first"), F.max_by("_key", "rank").alias("last"), F.max_by("nodes", "rank").alias("path")
    ).orderBy("part").collect()  # three values for each task
    entries, before, path = [], "", []
    for b in borders:
        entry = path[: len(commonprefix((before, b["first"])))]
        if entry:
            entries.append((b["part"], entry))
        # nodes of a task's first word that it shares with the task before bear that task's numbers
        low = b["part"] << _PART
        before, path = b["last"], [entry[x - low] if x - low < len(entry) else x for x in b["path"]]
    root = F.array(F.lit(-1).cast("long"))
    if not entries:
        return local.select(*keep, "rank", F.concat(root, "nodes").alias("nodes"))
    early = words.sparkSession.createDataFrame(entries, "part long, entry array<long>")
    number = lambda x: F.shiftrightunsigned(F.shiftleft(x, 64 - _PART), 64 - _PART)
    mended = F.when(F.col("entry").isNull(), F.col("nodes")).otherwise(
        F.transform("nodes", lambda x: F.when(number(x) < F.size("entry"), F.get("entry", number(x).cast("int"))).otherwise(x))
    )
    return local.join(early, part == early["part"], "left").select(*keep, "rank", F.concat(root, mended).alias("nodes"))


def _places(size: Column) -> Column:
    """0 .. size - 1 (none for 0) as an array."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def near_words(words: DataFrame) -> DataFrame:
    """``id``, ``word``, ``n``, ``n_near``, ``form_id``, ``form_n`` of the distinct words of ``words`` (``word``, ``n``).

    A word split before a letter is a pair (prefix node, suffix node); a word with a letter
    skipped is one, too.  Words with equal skipped pairs differ by that letter; a skipped pair
    equal to a split pair of another word is that word with a letter more.  A run of equal
    letters is skipped at its first letter for insertions, so that each neighbour is met once.
    A pair belongs to at most one split word and one skipped word for each letter of the alphabet,
    so its group is bounded; counts and the two best of the group are enough, and no
    neighbours are listed.
    """
    dictionary = stored(words.select("word", "n", F.monotonically_increasing_id().alias("at"), F.reverse("word").alias("back")), "words")
    rows = dictionary.count()
    forward = numbered_paths(dictionary, "word", ["word", "n", "at"], rows).select("at", "word", "n", F.col("rank").alias("id"), F.col("nodes").alias("p"))
    backward = numbered_paths(dictionary, "back", ["at"], rows).select("at", F.reverse("nodes").alias("s"))
    size = F.size("p") - 1
    both = forward.join(backward, "at").withColumn("letters", F.split("word", ""))
    splits = F.transform(_places(size + 1), lambda i: F.struct(F.get("p", i).alias("p"), F.get("s", i).alias("s"), F.lit(0).alias("role")))
    skips = F.transform(
        _places(size), lambda i: F.struct(
            F.get("p", i).alias("p"), F.get("s", i + 1).alias("s"),
            F.when((i == 0) | (F.get("letters", i) != F.get("letters", i - 1)), 1).otherwise(2).alias("role"),
        ),
    )
    pairs = both.select("id", "n", F.explode(F.concat(splits, skips)).alias("k")).select("id", "n", "k.p", "k.s", "k.role")
    group = W.partitionBy("p", "s")
    best = F.struct("n", (-F.col("id")).alias("back"))
    skipped, starts = F.col("role") > 0, F.col("role") == 1
    counted = pairs.select(
        "id", "n", "role", "p", "s",
        F.count(F.when(skipped, 1)).over(group).alias("alike"), F.count(F.when(starts, 1)).over(group).alias("longer"),
        F.max(F.when(skipped, best)).over(group).alias("top"), F.max(F.when(starts, best)).over(group).alias("top_longer"),
        F.max(F.when(F.col("role") == 0, best)).over(group).alias("shorter"),
    ).withColumn("second", F.max(F.when(skipped & (best != F.col("top")), best)).over(group))
    alike_best = F.when(F.col("top") == best, F.col("second")).otherwise(F.col("top"))
    links = counted.select(
        "id",
        F.when(F.col("role") == 0, F.col("longer"))
        .otherwise(F.col("alike") - 1 + F.when(starts & F.col("shorter").isNotNull(), 1).otherwise(0)).alias("near"),
        F.when(F.col("role") == 0, F.col("top_longer"))
        .otherwise(F.greatest(alike_best, F.when(starts, F.col("shorter")))).alias("best"),
    ).where("near > 0")
    summed = links.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    return forward.select("id", "word", "n").join(summed, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.back")).alias("form_id"), F.col("best.n").alias("form_n"),
    )


def variant_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, times: int = TIMES, every: int = TYPO_EVERY,
) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    Words are the letter runs of ``word_counts`` of at least ``least_length`` code points and
    ``least_count`` occurrences in all texts.  Near words differ by one inserted, deleted or
    replaced code point.  A word's form is its most frequent near word (of equals the first in
    code-point order) if that has at least ``times`` (2 or more) its occurrences; its root is
    the last of the chain of forms.  Each step of a chain at least doubles the count, so chains
    are short and pointer doubling ends after a few joins.  Null and empty texts have no words;
    repeated rows count again; no words, no rows.
    """
    if times < 2:
        raise ValueError("a form needs at least twice the occurrences")
    counts = word_counts(docs, id_col, text_col, every)
    words = counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count))
    strong = F.col("form_n") >= times * F.col("n")
    near = stored(near_words(words).select(
        "id", "word", "n", "n_near", F.when(strong, F.col("form_id")).alias("form_id"), F.when(strong, F.col("form_n")).alias("form_n")
    ), "near")
    roots = stored(near.where("form_id is not null").select("id", F.col("form_id").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            break
    names = near.select(F.col("id").alias("named"), F.col("word").alias("name"))
    linked = near.join(roots, "id", "left")
    forms = linked.join(names.withColumnsRenamed({"named": "form_id", "name": "form"}), "form_id", "left")
    return forms.join(names.withColumnsRenamed({"named": "root", "name": "root_word"}), "root", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root")
    )
