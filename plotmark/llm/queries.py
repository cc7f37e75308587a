"""The registered query of each operator: production parameters, whole tables, digests."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plotmark.llm import (
    credentials,
    decontaminate,
    mixing,
    pages,
    phrases,
    pieces,
    quality,
    sharding,
    simhash,
    spellings,
    tokens,
    urlfilter,
    urllists,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL where SQL can state it."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


@query()
def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every text, whole tokens counted directly."""
    counts = pieces.count_tokens(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query()
def op8_piece_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text by backtracking, and the text decoded from them."""
    out = pieces.encode_pieces(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op1_packed_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text written to bit-packed files, then read back from them."""
    manifest = tokens.write_tokens(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokens.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op9_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_copies(documents(spark, sf))


@query(decontaminate.ORACLE_SQL)
def op6_benchmark_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark windows in every document."""
    hits = decontaminate.benchmark_hits(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query()
def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of every text: patterns, and strings like known credentials."""
    found = credentials.find_secrets(documents(spark, sf))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in credentials.KINDS],
        F.sha2(credentials.digest_text(base), 256).alias("base_sha256"),
        credentials.digest_text(F.col("spans")).alias("spans"),
    )


@query()
def op2_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    found = pages.main_text(spark.read.parquet(f"{sf}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query(quality.ORACLE_SQL)
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Features and verdict of every document."""
    judged = quality.assess(documents(spark, sf))
    return judged.select(
        "row.doc_id",
        *[
            f"q.{c}"
            for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        ],
    )


@query(sharding.oracle_sql(8))
def op5_rendezvous_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in one of 8 equal shards, with its slot and its shard among 9."""
    placed = sharding.place(documents(spark, sf), [1.0] * 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query(urllists.ORACLE_SQL)
def op4_url_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Every capture judged by the list entries that were active when it was fetched."""
    pages_of = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    judged = urlfilter.judge(urllists.captures(pages_of), urllists.entries(pages_of))
    return judged.withColumns({"fetched": F.to_date("fetched"), "since": F.to_date("since")})


@query()
def op11_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes of every document, over all shards."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    drawn = mixing.mix(docs, keep=["doc_id"])
    taken = (F.col("size") * F.size("draws")).alias("taken")
    return drawn.select("row.doc_id", "size", "source_size", "target", taken, "draws")


@query()
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Every word with its near words, its form and its root."""
    return spellings.variants(documents(spark, sf))


@query(phrases.oracle_sql())
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The first phrases of every language by score."""
    return phrases.collocations(spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text"))
