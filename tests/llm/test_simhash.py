"""Fingerprints and components equal a brute-force version."""

import re

import numpy as np
import pytest
import xxhash

from plotmark.llm import simhash
from plotmark.llm.queries import QUERIES


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=4):
    p = np.array(prints, np.uint64)
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= radius
    label = np.arange(len(p))
    while True:
        new = np.array([label[row].min() for row in near]) if len(p) else label
        if (new == label).all():
            return label
        label = new


def clustered(rng, n):
    """Random fingerprints, most of them a few bits from an earlier one."""
    p = rng.integers(0, 2**64, n, dtype=np.uint64)
    for i in range(1, n):
        if rng.random() < 0.7:
            flips = rng.integers(0, 64, rng.integers(1, 7), dtype=np.uint64)
            p[i] = p[rng.integers(i)] ^ np.bitwise_xor.reduce(np.uint64(1) << flips)
    return np.unique(p)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
@pytest.mark.parametrize("groups", [1, 7, 200])
def test_bit_slices(radius, groups):
    rng = np.random.default_rng(radius * 10 + groups)
    p = clustered(rng, 700)
    group = np.sort(rng.integers(0, groups, len(p)))
    near = (np.bitwise_count(p[:, None] ^ p[None, :]) <= radius) & (group[:, None] == group[None, :])
    want = np.arange(len(p))
    while True:
        new = np.array([want[row].min() for row in near])
        if (new == want).all():
            break
        want = new
    assert (simhash.close_forest(p, group, radius) == want).all()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 63, 64, 65, 128, 129])
def test_word_borders(n):
    """All of one group, a bit apart in a chain: one component."""
    p = (np.uint64(1) << np.arange(n, dtype=np.uint64) % np.uint64(64)) - np.uint64(1)
    assert (simhash.close_forest(p, np.zeros(n, int), 1) == 0).all()


@pytest.mark.parametrize("match,tile", [(1, 4096), (1, 20), (2, 4096), (3, 16)])
def test_no_link_is_lost(spark, match, tile):
    """Every choice of blocks and tile size joins the same fingerprints, hot keys included."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 1, dtype=np.uint64)[0]
    dense = base ^ (np.uint64(1) << rng.integers(0, 30, 300, dtype=np.uint64)) ^ (
        np.uint64(1) << rng.integers(30, 60, 300, dtype=np.uint64)
    )
    p = np.unique(np.concatenate([clustered(rng, 500), dense])).view(np.int64)
    nodes = spark.createDataFrame([(int(x),) for x in p], "node long")
    edges = simhash.links(nodes, 4, match, tile).collect()
    at = {int(x): i for i, x in enumerate(p)}
    label = simhash._joined(
        np.arange(len(p)), np.array([at[e.a] for e in edges]), np.array([at[e.b] for e in edges])
    )
    assert (label == slow_components(p.view(np.uint64))).all()


def slow_closest(p, radius):
    """The place of the closest before each within the radius, the first of equally close ones, or -1."""
    apart = np.bitwise_count(p[:, None] ^ p[None, :]).astype(int)
    apart[np.triu_indices(len(p))] = 99
    best = apart.argmin(axis=1)
    return np.where(apart[np.arange(len(p)), best] <= radius, best, -1)


@pytest.mark.parametrize("radius", [0, 4, 8])
def test_closest_before(radius):
    p = np.random.default_rng(radius).permutation(clustered(np.random.default_rng(radius), 700))
    assert not len(simhash.closest(p[:0], np.zeros(0, int), radius))
    for n in (1, 64, 65, 700):
        part = p[:n]
        assert (simhash.closest(part, np.zeros(len(part), int), radius) == slow_closest(part, radius)).all()
    half = len(p) // 2
    want = [slow_closest(p[:half], radius), slow_closest(p[half:], radius)]
    want[1] = np.where(want[1] < 0, -1, want[1] + half)
    assert (simhash.closest(p, (np.arange(len(p)) >= half).astype(int), radius) == np.concatenate(want)).all()


@pytest.mark.parametrize("match,tile", [(1, 4096), (1, 20), (2, 30)])
def test_closest_of_a_table(spark, match, tile):
    """Neither the choice of blocks nor the tiles of hot keys change the pairs."""
    p = np.sort(clustered(np.random.default_rng(9), 500).view(np.int64))
    best = slow_closest(p.view(np.uint64), 8)
    want = sorted((int(p[a]), int(p[b])) for b, a in enumerate(best) if a >= 0)
    nodes = spark.createDataFrame([(int(x),) for x in p], "node long").repartition(4)
    assert sorted(map(tuple, simhash.closest_before(nodes, 8, match, tile).collect())) == want


def test_fingerprint_of_hashes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 70_000):
        hashes = rng.integers(0, 2**64, n, dtype=np.uint64)
        want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > n)
        assert simhash.of_hashes(hashes) == want


def test_odd_rows(spark, odd_rows, no_rows):
    got = simhash.near_copies(odd_rows)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = odd_rows.collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    label = slow_components(prints)
    least = {}
    for r, k in zip(rows, label):
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = [(r.doc_id, f"{p:016x}", least.get(k)) for r, p, k in zip(rows, prints, label)]
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert simhash.near_copies(no_rows).count() == 0
    alone = spark.createDataFrame([(None, "only this"), (None, "only this")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_copies(alone).collect()} == {None}


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    label = slow_components(prints)
    want = [(r.doc_id, f"{p:016x}", rows[k].doc_id) for r, p, k in zip(rows, prints, label)]
    assert sorted(map(tuple, QUERIES["op9_near_copies"](spark, sf).collect())) == want
    assert len({c for *_, c in want}) < len(want)


def test_blocks_follow_the_table():
    assert [simhash.blocks_to_match(n, 4) for n in (0, 10**6, 10**8, 10**11)] == [1, 1, 2, 3]
