"""Phrases equal a brute-force count on odd rows, for every stretch, filter and range."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from plotmark.llm import phrases


def slow(rows, least, share=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, of in counts.items():
        kept = []
        for p, a in of.items():
            if len(p) < 2 or a < least:
                continue
            inside = any(len(q) == 3 and f >= least and p in (q[:2], q[1:]) and 100 * f >= share * a for q, f in of.items())
            if len(p) == 2 and inside:
                continue
            score, _, l, r = min((10**6 * a * a // (of[p[:k]] * of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["New", "york", "city", "the", "of", "É", "é", "漢字", "a\x1cb", "😀"] + [f"w{k}" for k in range(30)]
    out = []
    for k in range(300):
        words = [rng.choice(vocabulary[: rng.choice((5, 10, 40))]) for _ in range(rng.randrange(40))]
        if k % 3 == 0:
            words += ["new", "York", "City"]
        text = "".join(w + rng.choice((" ", "  ", "\t", ", ", ".", "\n", " \x0b")) for w in words)
        out.append((rng.choice(("en", "und", None, "fr")), text))
    out += [("en", None), (None, None), ("de", ""), ("en", "new york city " * 3000), ("fr", "x" * 5000)]
    return out


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def got(spark, rows, **options):
    # Columns named as the operator's own ones.
    wide = [(lang, text, "w", 1, "p") for lang, text in rows]
    df = spark.createDataFrame(wide, "lang string, text string, w1 string, n int, phrase string").repartition(4)
    out = phrases.collocations(df, **options)
    assert out.columns == COLUMNS
    return sorted(tuple(r) for r in out.collect())


def test_equals_brute_force(spark, rows):
    want = slow(rows, 10)
    assert len(want) > 30 and {r[0] for r in want} == {"en", "und", "fr"}
    assert got(spark, rows) == want


@pytest.mark.parametrize("options", [{"stretch": 64}, {"filter_bits": 8}, {"stretch": 1, "filter_bits": 27}])
def test_stretches_and_filter_change_nothing(spark, rows, options):
    short = rows[:120] + rows[-5:-2] + [("en", "new york city " * 200)]
    assert got(spark, short, **options) == slow(short, 10)


def test_few_hashes_at_a_time(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "FLUSH_HASHES", 50)
    monkeypatch.setattr(phrases, "FLUSH_WINDOWS", 7)
    assert got(spark, rows[:150], least=4) == slow(rows[:150], 4)


def test_top_and_ties(spark):
    pairs = [("en", f"{a} {a}x") for a in ("b", "é", "a", "z") for _ in range(10)]
    want = slow(pairs, 10, top=3)
    assert [r[2] for r in want] == ["a ax", "b bx", "z zx"]
    assert got(spark, pairs, top=3) == want


def test_scores_beyond_64_bits():
    """A million times the square of a large count still fits the decimals used."""
    a = 10**13
    assert len(str(10**6 * a * a)) <= 7 + 19 + 19


def test_empty_table(spark, no_rows):
    assert phrases.collocations(no_rows.withColumn("lang", no_rows["id"])).collect() == []


def test_packed_hashes_round_trip():
    rng = np.random.default_rng(1)
    slots = rng.integers(0, 2**32, 1000, np.uint64)
    slots = np.r_[slots, np.repeat(slots[:3], 40)]
    steps = phrases.pack(slots, 10).astype("<u4")
    back = phrases.unpack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())
    assert Counter(back.tolist()) == Counter({k: min(n, 10) for k, n in Counter(slots.tolist()).items()})


def test_windows_are_counted_once_and_rolled_up(spark, rows):
    """No join or window makes the counts: one aggregation over a rollup does."""
    df = spark.createDataFrame(rows, "lang string, text string")
    plan = phrases.phrase_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan and "Join" not in plan and "Window" not in plan
