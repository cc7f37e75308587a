"""Shards by rendezvous hashing of record keys, as DataFrame expressions only.

Every shard gives a key a score from a hash of both, -weight / ln(u) with u uniform in
(0, 1), and the highest takes the record (the first shard of equals). Shares follow the
weights. The key and the shards alone decide: a new shard takes records only into itself,
one that goes gives its own away, and a changed weight moves records only to or from its shard.

Slots number the records of a shard without gaps, in the order of key, size and checksum.
Records are range-partitioned in that order, which splits a hot shard, and numbered by the
counts of the partitions before; the tables joined for it have a row per partition or shard.

A null key hashes like an empty one. A null or empty text has no bytes. Repeated keys share
a shard and get a slot each; fully equal rows are interchangeable. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotmark.session import materialize

# A fixed hash that any engine can compute: the first 52 bits of an MD5.
_HEX, _BITS = 13, 52


def score(key: Column, shard: int, weight: float) -> Column:
    """The claim of a shard on a key."""
    name = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}"))
    bits = F.conv(F.substring(F.md5(name), 1, _HEX), 16, 10).cast("double")
    return F.lit(float(-weight)) / F.log((bits + 0.5) / 2.0**_BITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that holds a key; a shard of weight 0 holds none."""
    claims = [F.struct(score(key, k, w), F.lit(-k).alias("k")) for k, w in enumerate(weights) if w > 0]
    if not claims:
        raise ValueError("no shard has a positive weight")
    return -F.array_max(F.array(*claims))["k"]


def with_slots(df: DataFrame, shard: str, order: Sequence[str]) -> DataFrame:
    """The table with ``slot``: the row's place, from 0, in its shard's order."""
    by = [shard, *order]
    placed = materialize(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("slot", F.monotonically_increasing_id()),
        "placed",
    )
    # The id counts a partition's rows in its low 33 bits; the partition is above them.
    part = F.shiftright("slot", 33)
    counts = materialize(placed.groupBy(part.alias("_part"), F.col(shard).alias("_shard")).count(), "counts")
    before = lambda by: Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("_part").agg(F.sum("count").alias("n"))
    parts = parts.select("_part", F.coalesce(F.sum("n").over(before("_part")), F.lit(0)).alias("_rows"))
    shards = counts.groupBy("_shard").agg(F.sum("count").alias("n"))
    shards = shards.select("_shard", F.coalesce(F.sum("n").over(before("_shard")), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(parts), "_part")
        .join(F.broadcast(shards), F.col(shard) == F.col("_shard"))
        .select(*df.columns, (F.col("slot").bitwiseAND((1 << 33) - 1) + F.col("_rows") - F.col("_start")).alias("slot"))
    )


def place(
    df: DataFrame, weights: Sequence[float], grown: float = 1.0, key_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) per row.

    ``size`` is the text's UTF-8 bytes plus 1; ``grown_shard`` is the shard if one more of
    weight ``grown`` joins.
    """
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.col(key_col)
    slim = df.select(
        key.alias("_key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown]).alias("grown_shard"),
    )
    slots = with_slots(materialize(slim, "keys"), "shard", ["_key", "size", "text_crc32"])
    return slots.select(F.col("_key").alias(key_col), "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, weights: Sequence[float], key_col: str = "doc_id") -> None:
    """Write the table as Parquet, one folder ``shard=n`` per shard that has records."""
    df.withColumn("shard", rendezvous(F.col(key_col), weights)).write.partitionBy("shard").parquet(path)


def _crc_table() -> list[int]:
    """The table of the reflected CRC-32, from its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def oracle_sql(shards: int) -> str:
    """The query's rows in DuckDB, for ``shards`` shards of equal weight."""

    def shard(n: int) -> str:
        claim = f"-1.0 / ln((CAST('0x' || substr(md5(doc_id || ':' || k), 1, {_HEX}) AS BIGINT) + 0.5) / {2**_BITS}.0)"
        best = f"list_max(list_transform(range({n}), lambda k: {{'s': {claim}, 'k': -k}}))"
        return f"CAST(-({best}).k AS INTEGER)"

    crc = (
        "xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)),"
        f" lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    )
    return f"""
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM (SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, CAST({crc} AS BIGINT) AS text_crc32,
             {shard(shards)} AS shard, {shard(shards + 1)} AS grown_shard
      FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"""
