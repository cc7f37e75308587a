"""From raw documents to token ids: quality rules, near-duplicate removal, benchmark
decontamination, secret redaction, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last
return the columns of ``docs``; a stage that changes texts also renews ``n_chars`` if there is
such a column. Rows are told apart by id and text, so repeated and null ids are handled: rows
that are equal in both count as copies. Empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plotmark.llm import credentials, decontaminate, jaccard, pieces, quality
from plotmark.session import materialize


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def _row_key():
    """Names a row by id and text, ordered by id with null ids last."""
    no_id = F.col("doc_id").isNull()
    return F.struct(
        no_id.cast("int").alias("no_id"),
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id"),
        F.xxhash64("text").alias("text_hash"),
    )


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail a rule."""
    return _counted(quality.keep_clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles alike by 0.8 or more), the document
    with the least id stays, once. Links are found by fingerprints and checked exactly; prefix
    filtering finds those that fingerprints miss."""
    copies = jaccard.near_copies(docs.select(_row_key().alias("key"), "text"), id_col="key")
    first = copies.filter(F.col("key") == F.col("component_id")).select(F.col("key").alias("_key")).distinct()
    keyed = docs.withColumn("_key", _row_key())
    return keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are a twentieth or more go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate.benchmark_hits(docs.select(_row_key().alias("_key"), "text"), benchmark, id_col="_key")
    found = hits.filter(decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select("_key").distinct()
    # Written, so that Spark plans the join from its size.
    bad = materialize(found, "contaminated")
    return docs.withColumn("_key", _row_key()).join(bad, "_key", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _counted(credentials.redact(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): ids as little-endian unsigned 32-bit integers with begin
    and end, and the text that they decode to."""
    out = pieces.encode_pieces(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("decoded", "text")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

# Shingle sets, learned formats and pieces are beyond SQL; tests hold a brute-force version against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
