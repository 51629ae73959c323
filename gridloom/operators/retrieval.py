"""Keyword search over documents through an inverted index.

Score per (query, document): 8 for equal category, 4 per query word among the title words,
2 per query word among the body words, and 3 when any query word occurs inside the title or
body text.  A query word has no blanks, so it occurs in a text exactly when it occurs
inside one of the text's blank-separated words; the substring test therefore runs between
the distinct query words and the distinct document words, never between queries and texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut_lineage

CATEGORY_POINTS, TITLE_POINTS, BODY_POINTS, INSIDE_POINTS = 8, 4, 2, 3
SEEDS = 200  # documents of a query's rarest lists that are scored first, about
AHEAD = 10  # times k candidates that are scored to raise the floor


def words(text: Column) -> Column:
    """Distinct lower-case words split on white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))


def token_overlap(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.withColumn("overlap", F.size(F.array_intersect(words(F.col(left)), words(F.col(right)))))


def _word_matches(query_words: DataFrame, doc_words: DataFrame) -> DataFrame:
    """(term, word): query words that occur inside document words.

    Each distinct document word yields its substrings of just those lengths that query
    words have; an equi-join on the substring replaces a contains-join.
    """
    lengths = query_words.select(F.length("term").alias("_len")).distinct()
    sized = doc_words.withColumn("_len", F.explode(F.sequence(F.lit(1), F.length("word")))).join(lengths, "_len")
    cut = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.length("word") - F.col("_len") + 1),
            lambda i: F.substring(F.col("word"), i, F.col("_len")),
        )
    )
    return sized.select("word", F.explode(cut).alias("term")).join(query_words, "term")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(words(F.col("text"))).alias("term"))


def word_index(docs: DataFrame) -> DataFrame:
    """``doc_id``, distinct title words, distinct body words, lower-case category; stored once."""
    return cut_lineage(docs.select("doc_id", words(F.col("title")).alias("tw"), words(F.col("body")).alias("bw"), F.lower("category").alias("_dc")))


def _postings(index: DataFrame) -> DataFrame:
    """(doc_id, word, weight): a list for each word in titles and one for each word in bodies."""
    def tagged(column, weight):
        return F.transform(column, lambda w: F.struct(w.alias("word"), F.lit(weight).alias("weight")))

    return index.select("doc_id", F.inline(F.concat(tagged(F.col("tw"), TITLE_POINTS), tagged(F.col("bw"), BODY_POINTS))))


def asked_index(index: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The index with the words of ``vocabulary`` only; documents with none of them go."""
    held = _postings(index).join(vocabulary, "word").groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("weight") == TITLE_POINTS, F.col("word"))).alias("tw"),
        F.collect_list(F.when(F.col("weight") == BODY_POINTS, F.col("word"))).alias("bw"),
    )
    return cut_lineage(held.join(index.select("doc_id", "_dc"), "doc_id"))


def pair_scores(pairs: DataFrame, index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of pairs that share a word, by the whole formula."""
    both = pairs.join(index, "doc_id").join(asked, "query_id")
    shared = TITLE_POINTS * F.size(F.array_intersect("tw", "terms")) + BODY_POINTS * F.size(F.array_intersect("bw", "terms"))
    bonus = F.coalesce(F.when(F.col("_qc") == F.col("_dc"), CATEGORY_POINTS), F.lit(0))
    return both.select("query_id", "doc_id", (shared + INSIDE_POINTS + bonus).cast("bigint").alias("score"))


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``floor``: the k-th best score so far, of queries that have k."""
    return _ranked(scored, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))


def best_by_words(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query among those that share a word with it; exact, with an early stop.

    1. Documents of a query's rarest lists are scored; the k-th of them is a floor that any
       result must reach.
    2. Lists are laid aside, longest for their weight first, as long as all of them together
       stay below the floor: a document found in none of the others cannot reach it.
    3. The other lists give candidates with a partial score.  What a candidate may still
       gain is bounded by the lists laid aside and by its own number of words; those with the
       best partial scores are scored and raise the floor, and then those whose bound reaches it.

    Long lists are thus read for few queries, and most pairs are never scored.  A query without
    k documents in step 1 has no floor, and all its lists are read.  Lists join by word; Spark
    splits the rows of a hot word over tasks.
    """
    asked = cut_lineage(queries.select("query_id", words(F.col("text")).alias("terms"), F.lower("category").alias("_qc")))
    each = asked.select("query_id", "_qc", F.explode("terms").alias("word"))
    index = asked_index(index, each.select("word").distinct())
    posts = _postings(index)
    lengths = posts.groupBy("word", "weight").agg(F.count(F.lit(1)).alias("n"))
    lists = cut_lineage(each.join(lengths, "word"))

    rarest = Window.partitionBy("query_id").orderBy("n", "word", "weight")  # two rows for each word of the query
    seeds = lists.withColumn("sum", F.sum("n").over(rarest.rowsBetween(Window.unboundedPreceding, 0))).where(
        (F.col("sum") <= SEEDS) | (F.col("sum") == F.col("n"))
    )
    first = posts.join(seeds.select("query_id", "word", "weight"), ["word", "weight"]).select("query_id", "doc_id").distinct()
    scored = cut_lineage(pair_scores(first, index, asked))

    longest = Window.partitionBy("query_id").orderBy(F.desc(F.col("n") / F.col("weight")), "word", "weight")
    most = INSIDE_POINTS + F.when(F.col("_qc").isNotNull(), CATEGORY_POINTS).otherwise(0)
    reach = F.sum("weight").over(longest.rowsBetween(Window.unboundedPreceding, 0))
    ordered = cut_lineage(lists.join(_kth(scored, k), "query_id", "left").withColumn("aside", F.coalesce(reach + most < F.col("floor"), F.lit(False))))
    rest = ordered.groupBy("query_id").agg(
        F.count_if(F.col("aside") & (F.col("weight") == TITLE_POINTS)).alias("_rt"),
        F.count_if(F.col("aside") & (F.col("weight") == BODY_POINTS)).alias("_rb"),
    )
    partial = posts.join(ordered.where("not aside").select("query_id", "word", "weight"), ["word", "weight"]).groupBy("query_id", "doc_id").agg(F.sum("weight").alias("part"))
    sizes = index.select("doc_id", F.size("tw").alias("_t"), F.size("bw").alias("_b"), "_dc")
    bonus = F.coalesce(F.when(F.col("_qc") == F.col("_dc"), CATEGORY_POINTS), F.lit(0))
    bound = F.col("part") + TITLE_POINTS * F.least("_rt", "_t") + BODY_POINTS * F.least("_rb", "_b") + INSIDE_POINTS + bonus
    open_pairs = cut_lineage(
        partial.join(rest, "query_id").join(asked.select("query_id", "_qc"), "query_id").join(sizes, "doc_id")
        .select("query_id", "doc_id", "part", bound.alias("bound")).join(_kth(scored, k), "query_id", "left")
        .where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).drop("floor")
        .join(scored.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    )
    ahead = _ranked(open_pairs.withColumn("score", F.col("part")), AHEAD * k).select("query_id", "doc_id")
    scored = cut_lineage(scored.unionByName(pair_scores(ahead, index, asked)))
    left = (
        open_pairs.join(_kth(scored, k), "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
        .select("query_id", "doc_id").join(scored.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    )
    return cut_lineage(_ranked(scored.unionByName(pair_scores(left, index, asked)), k))


def inside_pairs(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the pairs where a query word occurs inside a document word."""
    asked = _asked(queries)
    posts = _postings(index).select("doc_id", "word").distinct()
    matches = _word_matches(asked.select("term").distinct(), posts.select("word").distinct())
    reach = matches.join(asked, "term").select("query_id", "word").distinct()
    return posts.join(reach, "word").select("query_id", "doc_id").distinct()


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keyword_search(queries: DataFrame, docs: DataFrame, k=3) -> DataFrame:
    """Top k documents per query: score descending, then document order; a query without
    any match gets the first document with score 0.

    ``queries``: query_id, text, category (may be null); ``docs``: doc_id, title, body,
    category.  Pairs without a shared word score at most 3, or 11 with a category.  Where
    k documents with shared words score more than that, nothing else can reach the top k;
    only for the other queries are word parts and plain category matches looked up.
    """
    named = queries.select("query_id", F.lower("category").alias("_qc"))
    index = word_index(docs)
    cat = index.select("doc_id", "_dc")
    bonus = F.when(F.col("_qc") == F.col("_dc"), CATEGORY_POINTS).otherwise(0)
    best = best_by_words(queries, index, k)

    most_without = INSIDE_POINTS + F.when(F.col("_qc").isNotNull(), CATEGORY_POINTS).otherwise(0)
    settled = best.join(named, "query_id").filter((F.col("rank") == k) & (F.col("score") > most_without))
    rest = cut_lineage(queries.join(settled.select("query_id"), "query_id", "left_anti"))
    rest_named = rest.filter(F.col("category").isNotNull()).select("query_id", F.lower("category").alias("_qc"))

    parts = inside_pairs(rest, index).join(rest_named, "query_id", "left").join(cat, "doc_id").select(
        "query_id", "doc_id", (INSIDE_POINTS + F.coalesce(bonus, F.lit(0))).cast("bigint").alias("score")
    )
    # documents that match by category alone all score 8 and rank by document order; if one of
    # them is not among the first k of its category, those k score at least 8 and precede it,
    # so it cannot reach a top k: the first k per category are enough
    w = Window.partitionBy("_dc").orderBy("doc_id")
    firsts = cat.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    by_category = rest_named.join(firsts, F.col("_qc") == F.col("_dc")).select(
        "query_id", "doc_id", F.lit(CATEGORY_POINTS).cast("bigint").alias("score")
    )
    # a pair's true score is the largest of its entries; entries of ``best`` are complete
    everything = best.select("query_id", "doc_id", "score").unionByName(parts).unionByName(by_category)
    final = _ranked(everything.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)
    first_doc = docs.agg(F.min("doc_id")).scalar()
    return queries.select("query_id").join(final, "query_id", "left").select(
        "query_id", F.coalesce(F.col("doc_id"), first_doc).alias("doc_id"),
        F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("rank", F.lit(1)).alias("rank"),
    )
