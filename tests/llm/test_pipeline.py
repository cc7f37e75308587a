"""The pipeline's rows equal a brute-force version; each stage keeps its contract on odd rows."""

import re

import public_tokenizers
import pytest
import sentencepiece
from test_decontaminate import slow_hits
from test_jaccard import slow_kept
from test_quality import slow as slow_quality

import corpus_pipeline
from plotmark.llm import credentials, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passes(line):
    words = len(WORD.findall(line))
    if not words:
        return True
    decorated = 3 * max(len(re.findall(quality.SYMBOL, line)), line.count("!")) >= words
    bare = words < 5 and not re.search(quality.ENDED, line)
    notice = len(line) <= 400 and words <= 40 and re.search(quality.NOTICE, line, re.A)
    return not (decorated or bare or notice)


def brute_force(docs, items):
    """(doc_id, ids, text) of what should remain."""
    cleaned = []
    for doc, text in docs:
        kept = "\n".join(x for x in (text or "").split("\n") if passes(x))
        if text is not None and not slow_quality(text)[5] and 3 * len(kept) >= len(text):
            cleaned.append((doc, kept))
    cleaned.sort()
    first = set(slow_kept(cleaned))
    cleaned = [row for row in cleaned if row[0] in first]
    hits = slow_hits(cleaned, items)
    cleaned = [row for row, (_, n, h, _) in zip(cleaned, hits) if not (h and 20 * h >= n)]
    samples = {k: {} for k in credentials.LABELS}
    for _, text in cleaned:
        spans = credentials.pattern_spans(text)
        found = [(credentials.KINDS[k], v) for _, k, _, v in spans]
        for kind, v in found + [("ordinary", c) for _, _, c in credentials.candidates(text, spans)]:
            if len(v) <= credentials.LONGEST:
                samples[kind][v] = credentials.xxhash.xxh64_intdigest(v) >> 1
    chosen = {k: [v for v, _ in sorted(s.items(), key=lambda x: (x[1], x[0]))[:400]] for k, s in samples.items()}
    scorer = credentials.Scorer(chosen)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for doc, text in cleaned:
        spans = credentials.pattern_spans(text)
        ranges = [(s, e) for s, _, e, _ in spans]
        ranges += [(s, e) for s, e, c in credentials.candidates(text, spans) if scorer.score(c) > credentials.MARGIN]
        covered = [False] * len(text)
        for s, e in ranges:
            covered[s:e] = [True] * (e - s)
        pieces, at = [], 0
        while at < len(text):
            if not covered[at]:
                pieces.append(text[at])
                at += 1
                continue
            first = at
            while at < len(text) and covered[at]:
                at += 1
            pieces.append("[secret]" * (1 + sum(s == x for s, _ in set(ranges) for x in range(first + 1, at) if all(not a < x < b for a, b in ranges))))
        ids = [1, *library.encode("".join(pieces)), 2]
        out.append((doc, ids, library.decode(ids)))
    return out


def test_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute_force(docs, items)
    rows = corpus_pipeline.run(spark, sf).collect()
    got = sorted((r.doc_id, [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)], r.text) for r in rows)
    assert got == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)
    assert 0 < len(want) < len(docs)


@pytest.fixture(scope="module")
def odd_documents(spark):
    base = " ".join(f"word{k}" for k in range(40)) + "."
    other = " ".join(f"other{k}" for k in range(40)) + "."
    rows = [
        (5, base, "en", "a", 1, "k"), (5, base, "en", "a", 1, "k"), (2, base, None, None, None, "k"),
        (None, base, "en", "b", 1, "k"), (5, other, "en", "a", 1, "k"), (None, other + " more", "en", "a", 1, None),
        (9, None, "en", "a", 1, "k"), (10, "", "en", "a", 1, "k"),
        (11, other.replace("other", "x") + " password=abc12345", "en", "a", 1, "k"),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, key string"
    ).repartition(3)


def test_stages_on_odd_rows(spark, sf, odd_documents):
    docs = odd_documents
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, docs.limit(0), sf).count() == 0
        sizes.append(out.count())
        docs = out
    assert sizes == [7, 3, 3, 3]
    rows = {(r.doc_id, r.text[:5]): r for r in docs.collect()}
    assert set(rows) == {(2, "word0"), (5, "other"), (11, "x0 x1")}
    assert rows[11, "x0 x1"].text.endswith("[secret]")
    assert all(r.n_chars == len(r.text) for r in rows.values())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == 3 and last.columns == ["doc_id", "n_tokens", "ids", "text"]
