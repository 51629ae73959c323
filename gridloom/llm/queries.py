"""Registered queries of the corpus operators and the SQL that checks them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import (
    check_sql,
    exact_dedup,
    license_scan,
    line_dedup,
    mixing,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    sentence_pieces,
    simhash,
    spelling,
    url_filters,
    whitening,
)
from gridloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return add


@query("op1_hilbert_packing")
def _packing(spark, sf_dir):
    pieces = packing.pack_along_curve(table(spark, sf_dir, "documents"), tokenizer_path(), cached_words=500_000)
    return pieces.withColumn("ids_crc32", F.crc32("token_ids")).drop("token_ids")


def placed_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a directory tree: source, language, then thousands and hundreds of ids
    (a tenth of them directly below the language, two tenths below the thousands)."""
    n = F.col("doc_id")
    parts = [
        F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")),
        F.when(n % 10 != 0, F.floor(n / 1000).cast("string")), F.when(n % 10 >= 3, F.floor(n / 100).cast("string")),
        n.cast("string"),
    ]
    return docs.withColumn("path", F.concat_ws("/", *parts))


@query("op2_license_scan", check_sql.LICENSES)
def _licenses(spark, sf_dir):
    files = placed_files(table(spark, sf_dir, "documents"))
    return license_scan.license_scan(files, license_file=F.lit(True))


#: Action, host and path of the rules that every page is judged by.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op3_url_trie", check_sql.URLS)
def _urls(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), rules)


@query("op4_block_mixing", check_sql.MIX)
def _mixing(spark, sf_dir):
    mixed = mixing.mix_counts(table(spark, sf_dir, "documents"))
    return mixed.withColumn("shards", F.array_join("shards", ","))


@query("op5_simhash_dedup")
def _simhash(spark, sf_dir):
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


@query("op6_pii_deobfuscation")
def _pii(spark, sf_dir):
    found = pii.pii_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["added"])
    kinds = F.transform(base, lambda s: s["kind"])
    return found.select(
        "doc_id", *(
            (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS
        ),
        F.sha2(pii.span_text(base), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"),
    )


@query("op7_fuzzy_line_dedup")
def _lines(spark, sf_dir):
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"), least_words=1)
    return found.select(
        "doc_id", "n_lines", "n_judged", F.size("dropped").cast("long").alias("n_dropped"),
        F.concat_ws(",", F.col("dropped").cast("array<string>")).alias("dropped_lines"),
    )


@query("op8_mph_exact_dedup", check_sql.EXACT)
def _exact(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op9_subword_quality")
def _quality(spark, sf_dir):
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_compression_rules")
def _rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants")
def _variants(spark, sf_dir):
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


@query("op12_piece_coding")
def _pieces(spark, sf_dir):
    path = tokenizer_path("piece_bpe_32k.model")
    coded = sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("piece_ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op13_whitening")
def _whitening(spark, sf_dir):
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation as long)"))
