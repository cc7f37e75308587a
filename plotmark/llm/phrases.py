"""Collocations per language: phrases whose words meet more often than their parts explain.

A text's ASCII letters fold to lower case; it is cut at ``[.,;:!?`` and line ends ``]`` into
pieces, and these at spaces and tabs into words. Each word leads one window: itself and the
words that follow it in its piece, padded with empty words up to ``longest``. Only these
windows are counted; a ROLLUP over their columns then gives the count of every shorter phrase
and of all words, as each occurrence of a phrase is the start of exactly one window.

Nearly all long windows are rare, and a candidate needs ``least`` occurrences. So a first scan
sends hashes of each window's phrases, sorted and as differences, to tasks that own a range
of the hashes and keep those that may reach ``least``. A bit filter of these (of bounded size)
goes to the second scan, which pads a window from where its phrase is surely too rare. Hash
collisions and a full filter keep some windows longer than needed; counts, and so results,
are exact in any case. The cut moves the cost only: with a filter too small for the corpus
nearly every window is shuffled whole.

A candidate has 2 to ``longest`` words. Its score is the least over its cuts into two parts of
floor(1000000 * a * a / (l * r)), with a, l and r the occurrences of the phrase and of the two
parts; ties go to the shorter first part. A candidate inside a longer one that has at least
``share`` percent of its occurrences is dropped, whether or not the longer one is dropped.

Null and empty texts have no words. A null language counts as ``und``, together with a
language of that name. Repeated rows count each. Ids are not read; other columns neither. A long text
is read in stretches, so its words are never held at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from plotmark.llm.common import Memo, bit_filter, held, in_filter
from plotmark.session import materialize, materialize_counted

# Bytes of text that are cut into words at a time.
STRETCH = 1 << 20
# Hashes that a task sorts before it hands them on, and windows that it counts before.
FLUSH_HASHES, FLUSH_WINDOWS = 1 << 22, 200_000
# Bits of a window's hash that are compared; most bits of the filter.
HASH_BITS, FILTER_BITS = 40, 27
# Parts that a language's candidates are ranked in before they are ranked together.
RANK_PARTS = 64
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
# No word holds a full stop, so one stands for the end of a piece.
_STOP = b"."
_ROOM = re.compile(rb"[\x20\x09-\x0D.,;:!?]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _tokens(data: bytes) -> list[bytes]:
    return _BREAK.sub(b" . ", data).split()


def _stretches(rows: list[str], width: int, stretch: int) -> Iterator[tuple[list[bytes], int]]:
    """(words and stops, n): the first n lead windows; the rest are there to fill these."""
    short: list[bytes] = []
    held_bytes = 0
    for text in rows:
        data = text.encode().lower()
        if len(data) <= stretch:
            short.append(data)
            held_bytes += len(data)
            if held_bytes >= stretch:
                tokens = _tokens(b" . ".join(short))
                yield tokens, len(tokens)
                short, held_bytes = [], 0
            continue
        low, carried = 0, []
        while low < len(data):
            room = _ROOM.search(data, low + stretch)
            high = room.end() if room else len(data)
            tokens = carried + _tokens(data[low:high])
            n = len(tokens) if high == len(data) else max(0, len(tokens) - width + 1)
            yield tokens, n
            low, carried = high, tokens[n:]
    if short:
        tokens = _tokens(b" . ".join(short))
        yield tokens, len(tokens)


def _by_language(batches: Iterator[pa.RecordBatch], width: int, stretch: int) -> Iterator[tuple[str, list[bytes], int]]:
    for batch in batches:
        rows: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text:
                rows.setdefault(lang, []).append(text)
        for lang, of in rows.items():
            for tokens, n in _stretches(of, width, stretch):
                yield lang, tokens, n


def _grams(lang: str, tokens: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, complete) of the phrases of 1 to ``width`` words at each position where they fit."""
    memo = held("word-hashes", lambda: Memo(xxhash.xxh64_intdigest))
    words = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    word = words != np.uint64(memo[_STOP])
    gram = np.full(len(words), np.uint64(xxhash.xxh64_intdigest(lang)))
    whole = np.ones(len(words), bool)
    for k in range(width):
        m = len(words) - k
        if m <= 0:
            return
        gram = (gram[:m] ^ words[k:]) * _MIX
        gram ^= gram >> np.uint64(29)
        whole = whole[:m] & word[k:]
        yield gram, whole


def pack(slots: np.ndarray, least: int) -> np.ndarray:
    """Ascending hashes, each up to ``least`` times, as differences from the one before."""
    ordered = np.sort(slots)
    over = np.zeros(len(ordered), bool)
    over[least:] = ordered[least:] == ordered[:-least]
    ordered = ordered[~over]
    return np.diff(ordered, prepend=ordered[:1] * 0)


def _hashes(docs: DataFrame, width: int, least: int, range_bits: int, stretch: int) -> DataFrame:
    """(range, packed): hashes of all phrases of 2 to ``width`` words by range of the hash."""
    low_bits = np.uint64(HASH_BITS - range_bits)

    def rows(held_slots: list[np.ndarray]) -> pa.RecordBatch:
        slots = np.sort(np.concatenate(held_slots))
        ends = np.searchsorted(slots >> low_bits, np.arange(1, (1 << range_bits) + 1))
        starts = np.r_[0, ends[:-1]]
        used = np.flatnonzero(ends > starts)
        mask = (np.uint64(1) << low_bits) - np.uint64(1)
        blobs = []
        for k in used:
            steps = pack(slots[starts[k] : ends[k]] & mask, least).astype("<u4")
            # By byte planes, of which the high ones are nearly empty and compress well.
            blobs.append(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], ["range", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for lang, tokens, leads in _by_language(batches, width, stretch):
            for k, (gram, whole) in enumerate(_grams(lang, tokens, width)):
                if k:
                    found = gram[:leads][whole[:leads]] >> np.uint64(64 - HASH_BITS)
                    out.append(found)
                    n += len(found)
            if n >= FLUSH_HASHES:
                yield rows(out)
                out, n = [], 0
        if n:
            yield rows(out)

    return docs.mapInArrow(run, "range int, packed binary")


def unpack(packed: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def merged(values: np.ndarray, counts: np.ndarray, more: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their counts, up to ``least``."""
    found, n = np.unique(np.concatenate(more), return_counts=True)
    both = np.concatenate([values, found])
    of = np.concatenate([counts, np.minimum(n, least).astype(np.uint16)])
    out, place = np.unique(both, return_inverse=True)
    return out, np.minimum(np.bincount(place, of, len(out)), least).astype(np.uint16)


def _frequent(hashes: DataFrame, least: int, range_bits: int) -> DataFrame:
    """(hash) of those met ``least`` times; two different hashes each, for two places in a filter."""
    low_bits = np.uint64(HASH_BITS - range_bits)

    def done(key: int, values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        slots = values[counts >= least] | np.uint64(key) << low_bits
        return pa.RecordBatch.from_arrays([pa.array(spots(slots).ravel().view(np.int64))], ["hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, none = None, (np.zeros(0, np.uint64), np.zeros(0, np.uint16))
        values, counts, more, n = *none, [], 0
        for batch in batches:
            for k, packed in zip(batch.column("range").to_pylist(), batch.column("packed").to_pylist()):
                if key is not None and (k != key or n >= FLUSH_HASHES):
                    values, counts = merged(values, counts, more, least)
                    more, n = [], 0
                    if k != key:
                        yield done(key, values, counts)
                        values, counts = none
                key = k
                more.append(unpack(packed))
                n += len(more[-1])
        if key is not None:
            yield done(key, *merged(values, counts, more, least))

    return hashes.repartition("range").sortWithinPartitions("range").mapInArrow(run, "hash long")


def spots(slots: np.ndarray) -> np.ndarray:
    """Two evenly spread hashes of each slot."""
    one = (slots + np.uint64(1)) * _MIX
    one ^= one >> np.uint64(31)
    one *= np.uint64(0xC2B2AE3D27D4EB4F)
    two = (one ^ one >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)
    return np.stack([one, two])


def _windows(docs: DataFrame, width: int, known, bits: int, stretch: int) -> DataFrame:
    """(lang, w1.., n): counted windows, padded from where their phrase is surely too rare."""
    names = [f"w{k + 1}" for k in range(width)]

    def rows(counts: dict[tuple[str, int], Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, k), of in counts.items():
            keys = [(w,) for w in of] if k == 1 else list(of)
            words = [pa.array(c, pa.binary()).cast(pa.string()) for c in zip(*keys)]
            words += [pa.array([""] * len(of))] * (width - k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(of)), *words, pa.array(list(of.values()), pa.int64())], ["lang", *names, "n"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(known.value, np.uint8)
        counts: dict[tuple[str, int], Counter] = {}
        for lang, tokens, leads in _by_language(batches, width, stretch):
            level = np.zeros(len(tokens), np.int8)
            for k, (gram, whole) in enumerate(_grams(lang, tokens, width), 1):
                longer = np.flatnonzero(whole & (level[: len(gram)] == k - 1))
                if k > 1:
                    one, two = spots(gram[longer] >> np.uint64(64 - HASH_BITS))
                    longer = longer[in_filter(one, table, bits) & in_filter(two, table, bits)]
                level[longer] = k
            for k in range(1, width + 1):
                at = np.flatnonzero(level[:leads] == k)
                if len(at):
                    columns = [map(tokens.__getitem__, (at + j).tolist()) for j in range(k)]
                    counts.setdefault((lang, k), Counter()).update(columns[0] if k == 1 else zip(*columns))
            if sum(map(len, counts.values())) >= FLUSH_WINDOWS:
                yield from rows(counts)
                counts = {}
        yield from rows(counts)

    kinds = ", ".join(f"{n} string" for n in names)
    return docs.mapInArrow(run, f"lang string, {kinds}, n long")


def phrase_counts(
    df: DataFrame,
    longest: int = 3,
    least: int = 10,
    text_col: str = "text",
    lang_col: str = "lang",
    stretch: int = STRETCH,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, words, phrase, f): phrases of up to ``longest`` words with ``least`` occurrences,
    and one row per language with 0 words that holds all occurrences."""
    docs = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word takes about six bytes; a range should hold about four million hashes.
    range_bits = min(max((size * (longest - 1) // 6 >> 22).bit_length(), 8), 18)
    hashes = _hashes(docs, longest, least, range_bits, stretch)
    frequent, seen = materialize_counted(_frequent(hashes, least, range_bits), "frequent", rows=F.count("*"))
    bits = min(max((8 * seen["rows"]).bit_length(), 12), filter_bits)
    counted = _windows(docs, longest, bit_filter(frequent, bits), bits, stretch)
    names = [f"w{k + 1}" for k in range(longest)]
    rolled = counted.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("summed"))
    # The summed-out columns are the last ones, each a bit.
    words = longest - F.bit_count("summed")
    last = F.element_at(F.array(F.lit("all"), *names), (words + 1).cast("int"))
    real = (words >= 0) & (last != "") & ((F.col("f") >= least) | (words == 0))
    return rolled.filter(real).select(
        "lang", words.cast("int").alias("words"), F.concat_ws(" ", *names).alias("phrase"), "f"
    )


def collocations(
    df: DataFrame,
    longest: int = 3,
    least: int = 10,
    share: int = 50,
    top: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    **scan: int,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` candidates of each language by score
    descending, then a descending, then phrase in byte order."""
    table = materialize(phrase_counts(df, longest, least, text_col, lang_col, **scan), "phrases")
    totals = table.filter("words = 0").select("lang", F.col("f").alias("n"))
    phrases = table.filter("words > 0")
    candidates = table.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = phrases.select("lang", "phrase", "f")

    split = F.split("phrase", " ")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang",
        "phrase",
        "a",
        "cut",
        F.concat_ws(" ", F.slice(split, F.lit(1), F.col("cut"))).alias("first"),
        F.concat_ws(" ", F.slice(split, F.col("cut") + 1, F.col("words") - F.col("cut"))).alias("rest"),
    )
    known = cuts.join(
        parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]
    ).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    product = (F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a")).alias("p")
    scored = known.select("lang", "phrase", "a", "cut", "l", "r", product, (wide("l") * wide("r")).alias("q"))
    scored = scored.withColumn("score", F.expr("p div q"))
    worst = scored.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("w")
    )

    inside = candidates.filter("words > 2").select("lang", "phrase", "words", F.col("a").alias("longer"))
    inside = inside.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inside = inside.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inside = inside.select("lang", F.concat_ws(" ", F.slice(split, F.col("at"), F.col("size"))).alias("phrase"), "longer")
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = worst.join(most, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))
    )
    kept = kept.select("lang", "phrase", "a", "w.l", "w.r", "w.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    near = kept.withColumn("part", part).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    )
    ranked = near.filter(F.col("place") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    )
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def oracle_sql(least: int = 10, share: int = 50, top: int = 2000) -> str:
    """``collocations`` of up to three words in DuckDB's SQL."""
    gram = {
        1: "ws",
        2: "list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])",
        3: "list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])",
    }
    counts = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, phrase, count(*) AS f FROM (SELECT lang, unnest({g}) AS phrase FROM cut) GROUP BY ALL"
        for k, g in gram.items()
    )
    return f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
cut AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM piece),
counts AS ({counts}),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE k > 1 AND f >= {least}),
cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(ws[1:c], ' ') AS x, array_to_string(ws[c + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, c, l.f AS l, r.f AS r,
    (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts JOIN counts l ON l.lang = cuts.lang AND l.phrase = x JOIN counts r ON r.lang = cuts.lang AND r.phrase = y),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (
  SELECT * FROM worst s WHERE NOT (s.k = 2 AND EXISTS (
    SELECT 1 FROM cand t WHERE t.lang = s.lang AND t.k = 3 AND 100 * t.a >= {share} * s.a
      AND s.phrase IN (t.ws[1] || ' ' || t.ws[2], t.ws[2] || ' ' || t.ws[3])))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {top}
"""
