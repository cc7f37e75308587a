"""Benchmark hits equal a brute-force version."""

import hashlib
import random
import re

import pytest

from plotmark.llm import decontaminate
from plotmark.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_hits(docs, items):
    """(id, n_words, n_hit, items) per document, every window against every position."""
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    names |= found
        out.append((doc, len(w), len(hit), sorted(names)))
    return out


def key(row):
    return str(row[0]), row[1:]


@pytest.mark.parametrize("bits", [6, 22])
def test_random_texts(spark, bits):
    """Few different words, so windows overlap, repeat and meet at borders; a full filter changes nothing."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(["a", "B", "c1", "é", "d,"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 5, 12, 13, 14, 30]))) for k in range(2, 40)]
    items += [(40, items[5][1]), (40, items[6][1]), (None, items[7][1]), (41, None), (42, ""), (43, "!? -")]
    docs = [(k, text(rng.choice([0, 1, 5, 20, 60]))) for k in range(60)]
    docs += [(k, f"{text(4)} {rng.choice(items[:38])[1]}. {text(5)} {rng.choice(items[:38])[1]}") for k in range(50, 90)]
    docs += [(None, items[3][1]), (None, None), (7, docs[7][1]), (7, items[9][1]), (91, "x " * 5000 + items[12][1])]
    frame = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, item int, row string")
    bench = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, n_words int")
    got = decontaminate.benchmark_hits(frame.repartition(4), bench.repartition(2), filter_bits=bits)
    assert got.columns == ["doc_id", "n_words", "n_hit", "items"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(slow_hits(docs, items), key=key)


def test_empty_tables(spark, odd_rows, no_rows):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.benchmark_hits(odd_rows, bench).collect()
    assert len(rows) == odd_rows.count() and all(r.n_hit == 0 and r.items == [] for r in rows)
    bench = spark.createDataFrame([(1, "cat sat on the mat the cat")], "item_id long, text string")
    assert decontaminate.benchmark_hits(no_rows, bench).count() == 0
    rows = decontaminate.benchmark_hits(odd_rows, bench).collect()
    assert sorted((r.n_words, r.n_hit) for r in rows if r.n_hit) == [(10, 7), (10, 7)]


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [
        (d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0 and 20 * h >= n)
        for d, n, h, i in slow_hits(docs, items)
    ]
    assert sorted(map(tuple, QUERIES["op6_benchmark_hits"](spark, sf).collect())) == sorted(want)
    assert any(w[5] for w in want)
