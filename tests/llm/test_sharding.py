"""Shards: shares follow weights, few records move, slots have no gaps."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plotmark.llm import sharding
from plotmark.llm.queries import QUERIES


def slow_shard(key, weights):
    def claim(k, w):
        bits = int(hashlib.md5(f"{'' if key is None else key}:{k}".encode()).hexdigest()[:13], 16)
        return -w / math.log((bits + 0.5) / 2**52)

    return max((k for k, w in enumerate(weights) if w > 0), key=lambda k: (claim(k, weights[k]), -k))


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(4000).select(F.col("id").alias("k"))


def shards(df, weights):
    return {r.k: r.s for r in df.select("k", sharding.rendezvous(F.col("k"), weights).alias("s")).collect()}


def test_equals_a_plain_version_and_follows_weights(keys):
    weights = [1.0, 2.0, 0.0, 5.0]
    got = shards(keys, weights)
    assert got == {k: slow_shard(k, weights) for k in got}
    share = Counter(got.values())
    assert 2 not in share and abs(share[3] / 4000 - 5 / 8) < 0.03 and abs(share[0] / 4000 - 1 / 8) < 0.03


def test_few_records_move(keys):
    eight, nine = shards(keys, [1.0] * 8), shards(keys, [1.0] * 9)
    moved = [k for k in eight if eight[k] != nine[k]]
    assert all(nine[k] == 8 for k in moved) and abs(len(moved) / 4000 - 1 / 9) < 0.03
    fewer = shards(keys, [1.0] * 7 + [0.0])
    assert all(fewer[k] == s for k, s in eight.items() if s != 7)
    heavier = shards(keys, [3.0] + [1.0] * 7)
    assert all(heavier[k] in (s, 0) for k, s in eight.items())
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("k"), [0.0, 0.0])


def test_odd_rows(odd_rows, no_rows):
    got = sharding.place(odd_rows, [1.0, 1.0, 2.0])
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"]
    rows = got.collect()
    want = Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
        for r in odd_rows.collect()
    )
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    for shard in range(3):
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        order = [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in own]
        assert order == sorted(order)
    assert all(r.shard == slow_shard(r.doc_id, [1.0, 1.0, 2.0]) for r in rows)
    assert sharding.place(no_rows, [1.0]).count() == 0


def test_slots_over_many_partitions(spark):
    df = spark.range(0, 3000, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("shard"), (F.col("id") * 7 % 3001).alias("k")
    )
    got = sharding.with_slots(df.repartition(9), "shard", ["k"]).collect()
    assert len(got) == 3000
    for shard in range(11):
        own = sorted((r.k, r.slot) for r in got if r.shard == shard)
        assert [s for _, s in own] == list(range(len(own)))


def test_written_shards(spark, odd_rows, tmp_path):
    sharding.write_shards(odd_rows, f"{tmp_path}/out", [1.0] * 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == odd_rows.count()
    assert all(r.shard == slow_shard(r.doc_id, [1.0] * 3) for r in back.collect())


def test_plan_has_no_python(spark, sf):
    plan = QUERIES["op5_rendezvous_shards"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
