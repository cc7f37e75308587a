"""Exact-size samples that do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 1 << 16


def sample_n(df: DataFrame, id: str, n: int, seed: int = 0, rank: Column | None = None) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their id.

    Hashes are counted in buckets first. All rows of the buckets below the last one needed
    belong to the sample; only the last bucket, about one row in 65,536, is ordered. ``rank`` gives
    another hash, spread over all longs or the positive ones, in place of the seeded one.
    """
    rank = F.xxhash64(F.lit(seed), F.col(id)) if rank is None else rank
    bucket = F.shiftrightunsigned(rank, 48)
    marked = df.withColumns({"_rank": rank, "_bucket": bucket})
    upto = F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    counts = marked.groupBy("_bucket").count().withColumn("upto", upto)
    last = F.min_by(F.struct("_bucket", (F.col("upto") - F.col("count")).alias("below")), "_bucket")
    cut = counts.filter(F.col("upto") >= n).agg(last.alias("cut")).first()["cut"]
    if cut is None:
        return df
    # An unsigned hash order: the bucket decides first, the signed rest within a bucket.
    inside = marked.filter(F.col("_bucket") < cut["_bucket"])
    rest = marked.filter(F.col("_bucket") == cut["_bucket"]).orderBy("_rank", id).limit(n - cut["below"])
    return inside.unionByName(rest).drop("_rank", "_bucket")


def sample_groups(df: DataFrame, key: str, n: int, seed: int = 0, rank: Column | None = None) -> DataFrame:
    """All rows of ``n`` sampled groups."""
    chosen = sample_n(df.select(key).dropna().distinct(), key, n, seed, rank)
    return df.join(chosen, key, "left_semi")
