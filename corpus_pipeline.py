"""From raw documents to packed training sequences; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.exact_dedup import exact_dedup, text_digest
from gridloom.llm.mixing import mix_documents
from gridloom.llm.packing import pack_along_curve
from gridloom.llm.quality_classifier import fit, score
from gridloom.llm.queries import tokenizer_path
from gridloom.llm.simhash import simhash_dedup
from gridloom.session import stored
from gridloom.sources.tables import table


def _only(docs: DataFrame, kept: DataFrame, mark: Column) -> DataFrame:
    """The rows of ``docs`` whose (id, ``mark``) is in ``kept`` (``_id``, ``_mark``), unchanged; ids may repeat or be null.

    Of rows alike in id and mark as many stay as ``kept`` has, or one if ``kept`` has ``_one``.
    """
    one = F.first("_one") if "_one" in kept.columns else F.lit(False)
    wanted = stored(kept.groupBy("_id", "_mark").agg(F.count(F.lit(1)).alias("_copies"), one.alias("_one")), "kept")
    marked = docs.withColumn("_print", mark)
    same = marked["doc_id"].eqNullSafe(wanted["_id"]) & (marked["_print"] == wanted["_mark"])
    if wanted.where("_one and _copies > 1").isEmpty():
        return marked.join(wanted, same, "left_semi").select(*docs.columns)
    found = marked.join(wanted, same)
    alike = F.col("_one") & (F.col("_copies") > 1)
    first = found.where(alike).groupBy("_id", "_mark").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return found.where(~alike).select(*docs.columns).unionByName(first)


def _row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``: the id, null last, and a hash of the text, so that an id's texts are told apart."""
    return docs.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), _text_mark().alias("mark")))


def _text_mark() -> Column:
    return F.xxhash64(F.col("text"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at least one half."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    scores = score(_row_key(docs), *model, id_col="_key").where("score >= 0.5")
    return _only(docs, scores.select(F.col("id.id").alias("_id"), F.col("id.mark").alias("_mark")), _text_mark())


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document, that with the smallest id."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_mark"), F.lit(True).alias("_one"))
    return _only(docs, kept, F.lower(F.hex(text_digest(F.col("text")))))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by close fingerprints one, that with the smallest id."""
    kept = simhash_dedup(_row_key(docs), id_col="_key").where("_key = component_id")
    named = kept.select(F.col("_key.id").alias("_id"), F.col("_key.mark").alias("_mark"), F.lit(True).alias("_one"))
    return _only(docs, named, _text_mark())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: documents, and runs of blocks of documents."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 token ids, similar documents side by side."""
    return pack_along_curve(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", keep_first_copies),
    ("simhash_dedup", keep_one_of_similar),
    ("block_mixing", mix),
    ("hilbert_packing", pack),
]

#: SQL has no gradient descent, 64-bit text hash or tokenizer; tests hold run() against straight loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
