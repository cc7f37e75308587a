"""Near words, forms and roots equal a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest

from plotmark.llm import spellings


def slow_words(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow(rows):
    words = slow_words(rows)
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    form = {}
    for w, of in near.items():
        best = min(of, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé÷") for _ in range(rng.randrange(6, 10))) for _ in range(25)]
    # A chain of forms: each next one is six times as common and one letter away.
    chain = {"aaaaaa": 9000, "aaaaab": 1500, "aaaabb": 250, "aaabbb": 40, "aabbbb": 6}
    tokens = [w for w, n in chain.items() for _ in range(n)]
    for w in base:
        tokens += [w] * rng.choice((5, 30, 160))
        k = rng.randrange(len(w))
        for v in (w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :], w[1] + w[0] + w[2:]):
            tokens += [v.upper() if rng.random() < 0.2 else v] * rng.choice((4, 5, 6, 31))
    rng.shuffle(tokens)
    out, at = [], 0
    while at < len(tokens):
        n = rng.randrange(1, 60)
        out.append((len(out), "".join(t + rng.choice((" ", ",", "9", "漢", "ſ", "\n")) for t in tokens[at : at + n])))
        at += n
    out += [(None, "a row without an id " * 6), (None, None), (7, ""), (3, out[3][1]), (-5, "ÀÉÿ×÷ß " * 7)]
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def got(spark, rows, **options):
    wide = [(i, t, "w", 1) for i, t in rows]
    df = spark.createDataFrame(wide, "doc_id long, text string, word string, n int").repartition(4)
    out = spellings.variants(df, **options)
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=lambda r: r[0])


def test_equals_brute_force(spark, rows):
    want = slow(rows)
    assert sum(r[1] is not None for r in want) > 15
    assert {r[0]: r[2] for r in want}["aabbbb"] == "aaaaaa"
    assert got(spark, rows) == want


@pytest.mark.parametrize("tile", [1, 3])
def test_tiles_change_nothing(spark, rows, tile):
    assert got(spark, rows, tile=tile) == slow(rows)


def test_supplied_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = slow([tuple(r) for r in docs.collect()])
    assert sorted((tuple(r) for r in spellings.variants(docs).collect()), key=lambda r: r[0]) == want


def test_long_texts_in_stretches():
    text = "Word " * 1000 + "y" * 500
    parts = list(spellings.runs(text, stretch=64))
    assert len(parts) > 50 and sum(parts, []) == [b"word"] * 1000 + [b"y" * 500]


def test_odd_rows(spark, odd_rows, no_rows):
    rows = [(r.doc_id, r.text) for r in odd_rows.select("doc_id", "text").collect()]
    want = slow(rows)
    assert sorted(tuple(r) for r in spellings.variants(odd_rows).collect()) == want
    assert spellings.variants(no_rows).collect() == []


def test_moves_reach_every_edit():
    """The blocks of two words one edit apart differ by one of the listed moves."""
    rng = random.Random(2)
    letters = sorted(spellings._LETTERS)
    moves = set(spellings._moves())

    def cell(w):
        return (len(w), *[sum(b % spellings.CLASSES == k for b in w) for k in range(spellings.CLASSES - 1)])

    for _ in range(2000):
        w = [rng.choice(letters) for _ in range(rng.randrange(6, 12))]
        k = rng.randrange(len(w))
        for v in (w[:k] + [rng.choice(letters)] + w[k + 1 :], w[:k] + [rng.choice(letters)] + w[k:]):
            step = tuple(b - a for a, b in zip(cell(w), cell(v)))
            assert step in moves or tuple(-x for x in step) in moves
