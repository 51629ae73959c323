"""Mix sources to target weights by blocks of words; DataFrame functions only.

The words of a source, document after document, form a stream that is cut into blocks.  A
source's target decides how many slots of the mix it fills.  For each slot a shard of the
output is drawn: the sources' counts per shard are multinomial draws, while a source's total
stays at its quota.  A shard then takes its count of the source's next slots.  A slot's number
within its source passes through a pseudorandom permutation of the block numbers, a new one
each time all blocks have been used, and is joined to the block of that number, so each taken
block knows its shards.  All draws are integer arithmetic on the slot's own numbers, so reruns
agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.session import stored

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK_WORDS = 64
SHARD_SLOTS = 4_096
CHUNK_SLOTS = 4_096
BUCKET_ROWS = 20_000
ROUNDS = 12
MOST = 3  # times a source may be used
PRIME = (1 << 31) - 1


def scrambled(x: Column) -> Column:
    """A number below the prime 2^31 - 1 that looks unrelated to ``x`` (not negative)."""
    y = x % PRIME
    return y * (y + 40503) % PRIME * 48271 % PRIME


def permuted(index: Column, size: Column, seeds: Column) -> Column:
    """Swap-or-not permutation of 0 .. size-1, one round for each number in ``seeds``.

    A round pairs each index with its mirror image at a random centre and swaps both or
    neither by a bit that depends on the larger of the two: a bijection for any size.
    """

    def turn(x, seed):
        mirror = (seed * 1048573 % size + size - x) % size
        bit = F.floor(scrambled(F.greatest(x, mirror) + seed) / 1024) % 2
        return F.when(bit == 1, mirror).otherwise(x)

    return F.aggregate(seeds, index, turn)


def source_key(source: Column) -> Column:
    """Sources as joinable text; null sorts and joins like a value of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def targets(sized: DataFrame) -> DataFrame:
    """``key``, ``source_rank``, ``source_size``, ``target`` of each source of (key, size).

    Sources in order of code points, null last, weigh 1, 2, 3, 1, ...  They share the sum of
    all sizes by weight; none exceeds three times its size, and what is cut off goes to the
    others by weight.  Ordered by the share at which a source is full, the first source that
    is not full fixes the share of all after it.  One row per source is all that any window
    here holds.
    """
    sums = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy((F.col("key") == "").cast("int"), "key"))
    ranked = sums.withColumn("source_rank", rank.cast("long"))
    weighed = ranked.withColumn("weight", (F.col("source_rank") - 1) % 3 + 1)
    filled = W.orderBy(F.col("source_size") * 1.0 / F.col("weight"), "source_rank")
    big = F.col("source_size").cast("decimal(38,0)")
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    after = filled.rowsBetween(W.currentRow, W.unboundedFollowing)
    left = weighed.select(
        "*",
        (F.sum("source_size").over(W.partitionBy()) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .alias("left_words"),
        F.sum("weight").over(after).alias("left_weight"),
    ).withColumn(
        "full",
        (big * MOST * F.col("left_weight").cast("decimal(20,0)")).cast("decimal(38,0)")
        < (F.col("left_words").cast("decimal(38,0)") * F.col("weight").cast("decimal(20,0)")).cast("decimal(38,0)"),
    )
    share = F.struct("left_words", "left_weight")
    first_open = F.first(F.when(~F.col("full"), share), ignorenulls=True).over(
        W.orderBy(F.col("source_size") * 1.0 / F.col("weight"), "source_rank")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    open_target = (
        F.col("weight").cast("double") * first_open["left_words"].cast("double") / first_open["left_weight"].cast("double")
    )
    return left.select(
        "key", "source_rank", "source_size",
        F.when(first_open.isNull(), (F.col("source_size") * MOST).cast("double")).otherwise(open_target).alias("target"),
    )


def quotas(goals: DataFrame, block_words: int) -> DataFrame:
    """Blocks of a source, full passes over them, and slots of the last, partial pass."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor((F.col("target") - F.col("passes") * F.col("source_size")) / block_words + 0.5).cast("long")
    return goals.withColumns({"blocks": blocks, "passes": passes}).withColumn(
        "rest", F.greatest(F.lit(0), F.least("blocks", F.when(F.col("passes") >= MOST, 0).otherwise(rest)))
    )


def shard_counts(plan: DataFrame, parts: int) -> DataFrame:
    """``source_rank``, ``shard``, ``n`` (slots of the source in the shard), ``first`` (its slots in shards before).

    A source's slots are listed in chunks that are dealt over the cluster, so a large source
    is not listed by one task, and draw a shard each.
    """
    total = plan.agg(F.sum(F.col("passes") * F.col("blocks") + F.col("rest"))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_SLOTS))
    per_pass = plan.select(
        "source_rank", "blocks", "passes", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("pass")
    ).withColumn("n", F.when(F.col("pass") < F.col("passes"), F.col("blocks")).otherwise(F.col("rest"))).where("n > 0")
    chunks = per_pass.select(
        "source_rank", "pass", "n",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK_SLOTS).cast("long"))).alias("chunk"),
    ).repartition(parts, "source_rank", "pass", "chunk")
    first, last = F.col("chunk") * CHUNK_SLOTS, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK_SLOTS) - 1
    listed = chunks.select("source_rank", "pass", F.explode(F.sequence(first, last)).alias("slot"))
    draw = scrambled(scrambled(F.col("slot") + F.col("source_rank") * 92821) + F.col("pass") * 31337 + 271)
    counts = listed.groupBy("source_rank", (draw % shards).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    ahead = W.partitionBy("source_rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")))


def slots(plan: DataFrame, parts: int) -> DataFrame:
    """``source_rank``, ``shard``, ``pass``, ``block`` of every slot of the mix, listed shard by shard."""
    counts = stored(shard_counts(plan, parts), "shards")
    taken = counts.join(plan.select("source_rank", "blocks"), "source_rank").repartition(parts, "source_rank", "shard")
    numbers = F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)
    listed = taken.select("source_rank", "shard", "blocks", F.explode(numbers).alias("number")).select(
        "source_rank", "shard", "blocks", F.floor(F.col("number") / F.col("blocks")).cast("long").alias("pass"),
        (F.col("number") % F.col("blocks")).alias("slot"),
    )
    seeds = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")),
        lambda r: scrambled(F.col("source_rank") * 1000003 + F.col("pass") * 7919 + r * 104729 + 12345),
    )
    return listed.select("source_rank", "shard", "pass", permuted(F.col("slot"), F.col("blocks"), seeds).alias("block"))


def positions(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Each row's first word in its source's stream (``begin``).

    Rows are dealt into buckets by id; running sums are taken over the buckets of a source
    and within a bucket, so no task orders all rows of a source.
    """
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    dealt = sized.withColumn("bucket", F.pmod(F.coalesce("id", F.lit(0)), F.lit(PRIME)) * 48271 % PRIME % buckets)
    totals = dealt.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("key", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    within = W.partitionBy("key", "bucket").orderBy("id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return (
        placed.join(starts.hint("merge"), ["key", "bucket"]).join(goals, "key")
        .withColumn("begin", F.col("ahead") + F.col("inside")).drop("ahead", "inside", "bucket")
    )


def taken_blocks(sized: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Rows with targets, and per row and block: ``word`` (first, in the row), ``words``, ``times`` taken, the ``shards``."""
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    goals = stored(quotas(targets(sized), block_words), "targets")
    rows = positions(sized, goals)
    used = slots(goals, parts).groupBy("source_rank", "block").agg(
        F.count(F.lit(1)).alias("times"), F.collect_list("shard").alias("shards")  # three full passes and a part at most
    )
    first = F.floor(F.col("begin") / block_words).cast("long")
    last = F.floor((F.col("begin") + F.col("size") - 1) / block_words).cast("long")
    cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("begin"), F.col("block") * block_words)
    stop = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = cut.withColumns({"word": start - F.col("begin"), "words": stop - start}).join(
        used.hint("merge"), ["source_rank", "block"]  # as many blocks as the corpus has: never broadcast
    )
    return rows, pieces


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("id"), source_key(F.col(source_col)).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more,
    )


def mix_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size`` in words, ``source_size``, ``target``, ``taken`` words,
    ``shards`` of the output that its blocks go to.

    Null texts have no words; null sources form one source.  Rows without words are never
    taken.  Rows that repeat an id are mixed one by one.
    """
    sized = stored(sizes(docs, id_col, text_col, source_col), "sizes")
    rows, pieces = taken_blocks(sized, block_words)
    row = ["id", "source_rank", "begin", "size", "source_size", "target"]
    found = pieces.groupBy(*row).agg(
        F.sum(F.col("words") * F.col("times")).alias("taken"), F.array_distinct(F.flatten(F.collect_list("shards"))).alias("shards")
    )
    none = F.array().cast("array<long>").alias("shards")
    whole = rows.where("size > 0").select(*row, F.lit(0).cast("long").alias("taken"), none)
    counted = whole.unionByName(found).groupBy(*row).agg(F.sum("taken").alias("taken"), F.sort_array(F.flatten(F.collect_list("shards"))).alias("shards"))
    empty = rows.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), none)
    return counted.select(*empty.columns).unionByName(empty).withColumnRenamed("id", id_col)


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    length_col: str = "n_chars", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The mix as documents with the columns of ``docs``.

    A full pass over a source gives each of its rows once more, unchanged (also those without
    words).  The last, partial pass gives a row for each run of neighbouring blocks taken
    from a document: those words joined by one space, and their length in ``length_col`` if
    there is such a column.
    """
    alike = ["_id", "_twin", "_key"]
    twin = F.xxhash64(F.col(text_col)).alias("twin")
    sized = stored(sizes(docs, id_col, text_col, source_col, twin), "sizes")
    # rows alike in id, text and source are told apart by number; they may change places
    sized = stored(sized.withColumn("n", F.row_number().over(W.partitionBy("id", "twin", "key").orderBy("size"))), "sizes")
    rows, pieces = taken_blocks(sized, block_words)
    extra = pieces.where(F.col("times") > F.col("passes")).select("id", "twin", "key", "n", "word", "words")
    in_order = W.partitionBy("id", "twin", "key", "n").orderBy("word")
    fresh = F.col("word") != F.lag(F.col("word") + F.col("words"), 1, -1).over(in_order)
    runs = (
        extra.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(in_order))
        .groupBy("id", "twin", "key", "n", "run")
        .agg(F.struct(F.min("word").alias("word"), F.sum("words").alias("words")).alias("cut"))
        .groupBy("id", "twin", "key", "n").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    )
    numbers = rows.select("id", "twin", "key", "n", "passes", F.lit(None).cast(runs.schema["cuts"].dataType).alias("cuts"))
    spare = runs.withColumn("passes", F.lit(None).cast("long"))
    plan = (
        numbers.unionByName(spare).groupBy("id", "twin", "key", "n")
        .agg(F.max("passes").alias("passes"), F.first("cuts", ignorenulls=True).alias("cuts"))
        .where("passes > 0 OR cuts IS NOT NULL")
        .groupBy(*(F.col(c).alias("_" + c) for c in ("id", "twin", "key")))
        .agg(F.max("passes").alias("_passes"), F.map_from_entries(
            F.collect_list(F.struct("n", F.coalesce("cuts", F.array().cast(runs.schema["cuts"].dataType)))))
            .alias("_cuts"))
    )
    keyed = docs.select(
        F.struct("*").alias("_doc"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_twin"),
        source_key(F.col(source_col)).alias("_key"),
    )
    counted = keyed.withColumn("_n", F.row_number().over(W.partitionBy(*alike).orderBy("_key")))
    same = [counted[c].eqNullSafe(plan[c]) if c == "_id" else counted[c] == plan[c] for c in alike]
    text = F.col("_doc")[text_col]
    cuts = F.element_at("_cuts", F.col("_n"))
    chosen = counted.join(plan.hint("merge"), same).where(cuts.isNotNull()).select(
        "_doc", "_passes", cuts.alias("_runs"),
        F.when(F.size(cuts) > 0, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("_words"),
    )
    whole = F.array_repeat(F.struct(text.alias("text"), F.lit(False).alias("cut")), F.col("_passes").cast("int"))
    part = F.transform("_runs", lambda r: F.struct(
        F.array_join(F.slice("_words", (r["word"] + 1).cast("int"), r["words"].cast("int")), " ").alias("text"),
        F.lit(True).alias("cut"),
    ))
    out = chosen.select("_doc", F.explode(F.concat(whole, part)).alias("_new"))
    fields = {c: F.col("_doc")[c] for c in docs.columns}
    fields[text_col] = F.col("_new.text")
    if length_col in fields:
        length = F.length("_new.text").cast(docs.schema[length_col].dataType)
        fields[length_col] = F.when(F.col("_new.cut"), length).otherwise(fields[length_col])
    return out.select(*(v.alias(c) for c, v in fields.items()))
