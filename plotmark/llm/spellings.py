"""Spelling variants: words one edit apart, found by Gram matrices of letter counts.

Words are runs of letters, ``A-Z`` in lower case. The counts of a word's letters form a vector;
one inserted or deleted letter moves it by a squared distance of 1, one replaced letter by 2. A
block of words is compared with another by one matrix product of their vectors, which gives
all squared distances; pairs of equal length at distance 2 and of adjacent lengths at distance 1
are verified letter by letter.

Blocks are words of one length and, within it, of equal counts in ``CLASSES`` classes of
letters. A pair at such a distance lies in the same block or in one whose counts differ by one
letter moved, added or removed, so a block meets a fixed number of others, whatever the
vocabulary. A block of over ``tile`` words is split into tiles that meet pairwise. Only
verified pairs leave a task; of each word, only its number of near words and the best of them
are kept.

For the contract of the query, a letter is taken out of every 199th word of a document, by a
checksum of id and word (``thin``); a null id counts as an empty one. Null and empty texts have
no words. Repeated rows count each. Other columns are not read. Long texts are cut into
stretches. No table, no words: the result of an empty table is empty.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plotmark.session import materialize, materialize_counted

# One in so many words of a document loses a letter.
RARITY = 199
# Letters fall into classes by code point; the last class is what the length leaves.
CLASSES = 5
# Words of one block that are compared at a time.
TILE = 2048
# Words that a task counts before it hands them on, and bytes of text that it cuts at a time.
FLUSH, STRETCH = 400_000, 1 << 22
# Pairs that are verified at a time.
_SLAB = 1 << 16
_LETTERS = {*range(0x61, 0x7B), *range(0xC0, 0x100)}
# Of a text in Latin-1, what is no letter becomes a space.
_FOLD = bytes(b if b in _LETTERS else 0x20 for b in bytes(range(256)).lower())


def runs(text: str, stretch: int = STRETCH) -> Iterator[list[bytes]]:
    """The letter runs of a text in Latin-1, a stretch at a time."""
    # Letters outside Latin-1 turn into question marks, which end a run as they do.
    data = text.encode("latin-1", "replace").translate(_FOLD)
    low = 0
    while low < len(data):
        high = data.find(b" ", low + stretch)
        high = len(data) if high < 0 else high
        yield data[low:high].split()
        low = high


def thin(run: bytes, doc: int) -> bytes:
    """The run, or every ``RARITY``-th time the run less a letter; ``doc`` is the crc32 of the id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), doc)
    if h % RARITY:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(df: DataFrame, shortest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, of words with ``shortest`` letters or more."""

    def rows(found: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in found], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for part in runs(text or ""):
                    for word, n in Counter(part).items():
                        word = thin(word, start)
                        if len(word) >= shortest:
                            found[word] += n
                if len(found) >= FLUSH:
                    yield rows(found)
                    found = Counter()
        if found:
            yield rows(found)

    docs = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _class_counts(word: Column) -> list[Column]:
    """Letters of each class but the last."""
    of = ["".join(chr(b) for b in sorted(_LETTERS) if b % CLASSES == k) for k in range(CLASSES - 1)]
    return [(F.char_length(word) - F.char_length(F.translate(word, letters, ""))).cast("int") for letters in of]


def _moves() -> list[tuple[int, ...]]:
    """What may be added to (length, class counts) of a block to reach one it meets, each pair once."""
    unit = [tuple(int(j == k) for j in range(CLASSES)) for k in range(CLASSES)]
    same = [tuple(b - a for a, b in zip(unit[i], unit[j])) for i in range(CLASSES) for j in range(i + 1, CLASSES)]
    return [(0,) * CLASSES] + [(0, *m[:-1]) for m in same] + [(1, *u[:-1]) for u in unit]


def _meetings(cells: DataFrame, cell: list[str], tile: int) -> DataFrame:
    """(cell, tile, meeting, side): the tiles that are compared; a tile also meets itself."""
    tiles = cells.select(*cell, F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    steps = [F.struct(F.lit(i).alias("move"), *[F.lit(x).alias(c) for x, c in zip(m, cell)]) for i, m in enumerate(_moves())]
    moves = F.explode(F.array(*steps))
    left = tiles.withColumn("m", moves).select(
        *cell, "tiles", "m.move", *[(F.col(c) + F.col(f"m.{c}")).alias(f"r_{c}") for c in cell]
    )
    right = tiles.select(*[F.col(c).alias(f"r_{c}") for c in cell], F.col("tiles").alias("r_tiles"))
    pairs = left.join(right, [f"r_{c}" for c in cell])
    pairs = pairs.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    first = F.when(F.col("move") == 0, F.col("tile")).otherwise(0)
    pairs = pairs.withColumn("r_tile", F.explode(F.sequence(first, F.col("r_tiles") - 1)))
    pairs = materialize(
        pairs.withColumn("meeting", F.concat_ws(",", *cell, "move", "tile", "r_tile")).select(
            *cell, "tile", *[f"r_{c}" for c in cell], "r_tile", "move", "meeting"
        ),
        "meetings",
    )
    ours = pairs.select(*cell, "tile", "meeting", F.lit(0).alias("side"))
    other = pairs.filter("move <> 0 OR tile <> r_tile").select(
        *[F.col(f"r_{c}").alias(c) for c in cell], F.col("r_tile").alias("tile"), "meeting", F.lit(1).alias("side")
    )
    return ours.unionByName(other)


def _letters(words: list[bytes]) -> np.ndarray:
    """One row of letters per word; all have one length."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def _vectors(letters: np.ndarray) -> np.ndarray:
    n = len(letters)
    at = (np.arange(n)[:, None] * 256 + letters).ravel()
    return np.bincount(at, minlength=n * 256).reshape(n, 256)


def near_pairs(one: list[bytes], two: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the words that are one edit apart; without ``two`` among ``one``, i before j.

    All words of a list have one length; those of the lists are equal or differ by one.
    """
    a = _letters(one)
    b = a if two is None else _letters(two)
    x, y = _vectors(a), _vectors(b)
    used = x.any(0) | y.any(0)
    x, y = x[:, used].astype(np.float32), y[:, used].astype(np.float32)
    distance = -2 * (x @ y.T)
    distance += (x * x).sum(1)[:, None]
    distance += (y * y).sum(1)[None, :]
    same = a.shape[1] == b.shape[1]
    # Counts and their products are whole, so the distances are exact.
    i, j = np.nonzero(distance == (2 if same else 1))
    if two is None:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for low in range(0, len(i), _SLAB):
        s = slice(low, low + _SLAB)
        keep[s] = _one_replaced(a[i[s]], b[j[s]]) if same else _one_inserted(a[i[s]], b[j[s]])
    return i[keep], j[keep]


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def _one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``b`` is ``a`` with one more letter; the two may come the other way round."""
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    n = a.shape[1]
    ahead = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= n


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, other, n) both ways, of the rows of each meeting."""

    def compared(sides: tuple[list, list]) -> pa.RecordBatch | None:
        lists = [([w.encode("latin-1") for w, _ in s], [n for _, n in s]) for s in sides]
        (one, n_one), (two, n_two) = lists
        if not one or len(one) + len(two) < 2:
            return None
        i, j = near_pairs(one, two or None)
        if not len(i):
            return None
        if not two:
            two, n_two = one, n_one
        words = [one[k].decode("latin-1") for k in i], [two[k].decode("latin-1") for k in j]
        count = [n_one[k] for k in i], [n_two[k] for k in j]
        return pa.RecordBatch.from_arrays(
            [pa.array(words[0] + words[1]), pa.array(words[1] + words[0]), pa.array(count[1] + count[0], pa.int64())],
            ["word", "other", "n"],
        )

    meeting, sides = None, ([], [])
    for batch in batches:
        for m, side, word, n in zip(*(batch.column(c).to_pylist() for c in ("meeting", "side", "word", "n"))):
            if m != meeting:
                out = compared(sides)
                if out is not None:
                    yield out
                meeting, sides = m, ([], [])
            sides[side].append((word, n))
    out = compared(sides)
    if out is not None:
        yield out


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, other, n): both directions of all pairs one edit apart, with the count of ``other``.

    ``words`` is a written table of distinct words with their counts.
    """
    cell = ["length", *[f"c{k}" for k in range(CLASSES - 1)]]
    placed = words.select(
        "word", "n", F.char_length("word").cast("int").alias("length"),
        *[c.alias(n) for c, n in zip(_class_counts(F.col("word")), cell[1:])],
    )
    cells = materialize(placed.groupBy(*cell).count(), "cells")
    sized = cells.select(*cell, F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    tiled = placed.join(sized, cell).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    met = tiled.join(_meetings(cells, cell, tile), [*cell, "tile"]).select("meeting", "side", "word", "n")
    dealt = met.repartition("meeting").sortWithinPartitions("meeting", "side")
    return dealt.mapInArrow(_near, "word string, other string, n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form, following forms from a word; each round doubles the step.

    Counts grow at each step by a factor, so that chains are short.
    """
    table = forms
    while True:
        ahead = table.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = table.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        table, seen = materialize_counted(step, "word-roots", moved=F.count_if("moved"))
        table = table.select("word", "root")
        if not seen["moved"]:
            return table


def variants(
    df: DataFrame,
    shortest: int = 6,
    least: int = 5,
    factor: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    tile: int = TILE,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with ``shortest`` letters and ``least`` occurrences.

    ``form`` is the near word of the largest count, ties to the least, if it has ``factor`` times
    the word's count; ``root`` is where following forms ends.
    """
    words = materialize(word_counts(df, shortest, id_col, text_col).filter(F.col("n") >= least), "words")
    near = near_words(words, tile).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("other"))).alias("best")
    )
    best_n = -F.col("best.less")
    real = best_n >= factor * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word",
        F.when(real, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(real, best_n).alias("form_n"),
    )
    table = materialize(joined, "forms")
    roots = _roots(table.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return table.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
