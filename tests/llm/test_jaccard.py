"""Near copies of the pipeline's stage equal a brute-force Jaccard version."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from plotmark.llm import jaccard


def slow_sets(rows):
    out = []
    for text in rows:
        words = (text or "").lower().split()
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def slow_kept(docs):
    """Ids of the least document of each component."""
    docs = sorted(docs)
    sets = slow_sets([t for _, t in docs])
    label = list(range(len(docs)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for j in range(len(docs)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [doc for k, (doc, _) in enumerate(docs) if find(k) == k]


@pytest.fixture(scope="module")
def edited():
    """Texts with copies edited at random, a common passage, and a chain of near copies."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice((6, 12, 60, 150, 300)))] + passage * rng.randrange(2)
        for copy in range(4):
            text = list(base)
            for _ in range(copy and rng.randrange(1 + len(text) // 25)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    chain = [word() for _ in range(200)]
    for k in range(30):
        rows.append(" ".join(chain[:100] + [f"n{i}" for i in range(4 * k)] + chain[100 + 4 * k :]))
    rows += ["one two", "One  TWO", "", None]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_stage_equals_brute_force(spark, edited):
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(5)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == slow_kept(edited)
    assert len(got) < len(edited) - 60


def test_supplied_documents(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    want = slow_kept([(r.doc_id, r.text) for r in table.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, table, sf).collect()) == want


@pytest.mark.parametrize("options", [{"STARS": 0}, {"COUNTER_BITS": 15}, {"TILE": 2}, {"TILE": 3, "STARS": 1}])
def test_order_rounds_and_tiles_change_nothing(spark, edited, monkeypatch, options):
    for name, value in options.items():
        monkeypatch.setattr(jaccard, name, value)
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(3)
    got = {r.component_id for r in jaccard.near_copies(docs).collect()}
    assert sorted(got) == slow_kept(edited)


def test_stage_compares_fingerprints_first(spark, edited, monkeypatch):
    """Most links come from fingerprints within the radius, and only after a check of the whole sets."""
    taken = []
    closest, verified = jaccard.simhash.closest_before, jaccard._verified

    def spy(nodes, radius, *rest):
        taken.append((nodes.count(), radius))
        return closest(nodes, radius, *rest)

    def kept(pairs, members):
        out = verified(pairs, members)
        taken.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard.simhash, "closest_before", spy)
    monkeypatch.setattr(jaccard, "_verified", kept)
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(5)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == slow_kept(edited)
    (nodes, radius), (pairs, links), *later = taken
    assert nodes > 100 and radius == jaccard.RADIUS
    assert len(edited) - len(got) > links > sum(n for _, n in later) and pairs >= links


@pytest.mark.parametrize("radius", [0, 3, 20])
def test_radius_changes_nothing(spark, edited, monkeypatch, radius):
    """What fingerprints miss is found by shingles; what they bring wrongly is not linked."""
    monkeypatch.setattr(jaccard, "RADIUS", radius)
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(3)
    assert {r.component_id for r in jaccard.near_copies(docs).collect()} == set(slow_kept(edited))


def test_bitmaps_never_rule_out_similar_sets():
    rng = np.random.default_rng(4)
    ruled_out = 0
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, n // 4) + 1))
        b = np.unique(np.r_[a[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 2))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        alike = 5 * both >= 4 * (len(a) + len(b) - both)
        maybe = jaccard.may_reach(jaccard.parity(a), len(a), jaccard.parity(b), len(b))
        assert maybe or not alike
        ruled_out += not maybe
    assert ruled_out > 500


def test_rows_with_others_of_their_key():
    rng = random.Random(6)
    keys = sorted(rng.randrange(60) for _ in range(60))
    table = pa.table({"key": keys, "node": list(range(60))})
    for size in (1, 2, 7, 60):
        got = [k for b in jaccard._live(iter(table.to_batches(max_chunksize=size))) for k in b.column("key").to_pylist()]
        assert got == [k for k in keys if keys.count(k) > 1]


def test_odd_rows(spark, odd_rows, no_rows):
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.near_copies(odd_rows).collect()), key=repr)
    assert (2, 2) in got and (3, 2) in got and (None, 2) in got and got.count((1, 1)) == 2 and len(got) == 11
    assert jaccard.near_copies(no_rows).collect() == []
