"""Targets, draws and shards of the mix hold their laws; reruns and repartitioning agree."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from plotmark.llm import mixing


def slow_targets(sizes, most=3):
    """By bisection over the common price of a weight."""
    weights = [k % 3 + 1 for k in range(len(sizes))]
    low, high = 0.0, float(3 * sum(sizes) + 1)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(most * s, mid * w) for s, w in zip(sizes, weights)) < sum(sizes):
            low = mid
        else:
            high = mid
    return [min(most * s, high * w) for s, w in zip(sizes, weights)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for k in range(3000):
        source = "hot" if k % 3 == 0 else rng.choice(("a", "b", "é", "z", "Z", "tiny", None)) if k % 50 else "tiny"
        n = rng.choice((0, 1, 5, 40, 200))
        out.append((k, " ".join(["w"] * n) + rng.choice(("", "\n", " \x0b")), source))
    out += [(None, None, "a"), (None, "x y", None), (5, "x y z", "a"), (5, "x y z", "a"), (9, "", "none")]
    out += [(10**6, "long " * 3000, "b")]
    return out


SCHEMA = "doc_id long, text string, source string"


def drawn(spark, rows, parts=4, **options):
    wide = [(*r, 1, "x") for r in rows]
    df = spark.createDataFrame(wide, SCHEMA + ", size int, key string").repartition(parts)
    return mixing.mix(df, **options)


def facts(frame):
    got = [
        (r.row.doc_id, r.row.text, r.row.source, r.size, r.source_size, r.target, tuple(map(tuple, r.draws)))
        for r in frame.collect()
    ]
    return sorted(got, key=repr)


def test_targets_and_taken(spark, rows):
    got = facts(drawn(spark, rows, blocks=64))
    assert len(got) == len(rows)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = Counter()
    for _, text, source in rows:
        size[source] += len(re.findall("[^\x20\x09-\x0d]+", text or ""))
    want = dict(zip(names, slow_targets([size[s] for s in names])))
    taken, longest = Counter(), Counter()
    for _, text, source, n, source_size, target, draws in got:
        assert n == len(re.findall("[^\x20\x09-\x0d]+", text or ""))
        assert source_size == size[source] and target == pytest.approx(want[source])
        turns = [t for t, _ in draws]
        assert len(set(turns)) == len(turns) <= 3
        if size[source] and n:
            assert abs(len(turns) - target / size[source]) < 1
        taken[source] += n * len(draws)
        longest[source] = max(longest[source], n)
    for s in names:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6
    assert abs(sum(taken.values()) - sum(size.values())) < sum(longest.values())


def test_reruns_and_partitions_agree(spark, rows):
    assert facts(drawn(spark, rows)) == facts(drawn(spark, rows, parts=7))
    assert facts(drawn(spark, rows)) != facts(drawn(spark, rows, seed=12))


@pytest.mark.parametrize("blocks", [1, 7])
def test_few_blocks(spark, rows, blocks):
    """The cut inside a block keeps the words near the target for any number of blocks."""
    taken, target, longest = Counter(), {}, Counter()
    for _, _, source, n, _, t, draws in facts(drawn(spark, rows, blocks=blocks)):
        taken[source] += n * len(draws)
        target[source] = t
        longest[source] = max(longest[source], n)
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in target)


def test_shards_get_exact_quotas(spark, rows):
    """Every draw lands in one shard, and a large source in all of them; sizes vary as draws of blocks do."""
    frame = drawn(spark, rows, shards=8, blocks=512)
    out = mixing.mixed(frame, shards=8)
    assert out.columns == ["doc_id", "text", "source", "size", "key", "shard", "turn"]
    got = out.collect()
    assert len(got) == sum(len(r[6]) for r in facts(frame))
    hot = Counter(r.shard for r in got if r.source == "hot")
    assert len(hot) == 8 and max(hot.values()) < 3 * sum(hot.values()) / 8
    assert max(Counter((r.doc_id, r.text, r.turn) for r in got if r.doc_id not in (None, 5)).values()) == 1
    order = [r.doc_id for r in got if r.shard == got[0].shard]
    assert order != sorted(order, key=lambda x: -1 if x is None else x)


def test_splitting_tree_is_hypergeometric():
    quotas = np.array([50, 30, 0, 20])
    mean = np.zeros((4, 4))
    for seed in range(400):
        out = mixing.split_quotas(quotas, 4, seed)
        assert (out.sum(0) == quotas).all() and (out.sum(1) == 25).all()
        mean += out / 400
    assert np.allclose(mean, quotas / 4, atol=0.5)
    var = np.var([mixing.split_quotas(quotas, 4, s)[2, 0] for s in range(400)])
    assert var == pytest.approx(25 * 0.5 * 0.5 * 75 / 99, rel=0.25)


def test_tree_of_uneven_shards():
    out = mixing.split_quotas(np.array([3, 0, 7]), 6, 1)
    assert (out.sum(0) == [3, 0, 7]).all() and set(out.sum(1)) <= {1, 2}
    assert mixing.split_quotas(np.array([], np.int64), 3, 1).shape == (3, 0)


def test_targets_share_the_excess():
    assert mixing.targets([100, 1, 99], [1, 2, 3], 3) == [197 / 4, 3, 197 * 3 / 4]
    assert mixing.targets([0, 0], [1, 2], 3) == [0, 0]
    assert mixing.targets([], [], 3) == []


def test_odd_tables(spark, odd_rows, no_rows):
    named = odd_rows.withColumn("source", odd_rows["id"])
    got = mixing.mix(named).collect()
    assert len(got) == named.count()
    assert sum(r.size * len(r.draws) for r in got) == sum(r.size for r in got)
    assert mixing.mix(no_rows.withColumn("source", no_rows["id"])).collect() == []
    blank = spark.createDataFrame([(1, None, None), (1, "", "a")], SCHEMA)
    assert [(r.size, r.target) for r in mixing.mix(blank).collect()] == [(0, 0.0)] * 2
