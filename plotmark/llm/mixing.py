"""Mix sources to target weights, by blocks dealt to shards through a splitting tree.

A document's size is its number of words. Sources take turns with the ``weights`` in code point
order, null last, and share all words; a target stops at ``most`` times its source's size, and
what it leaves is shared again by weight until none is above.

Each source is cut into blocks by a hash of its rows' ids and texts, so that a block is a fair
draw of the source and no block holds much of a large one. A source is drawn in passes; each
pass permutes its blocks anew, and a block comes once in a pass. The words of the blocks tell how
many are drawn to reach the target; of the last one, only rows up to a bound of a second
hash, found by sums over its digits, so that the words taken miss the target by half a document
at most (equal rows share a hash and go together).

The blocks drawn are divided among output shards by a tree: a node holds exact quotas of blocks
per source and gives its left half a draw from the multivariate hypergeometric distribution, so
that a shard's mix is that of a random sample without replacement and all quotas add up. A
shard's quota of a source is a stretch of the source's sequence of permuted blocks, disjoint
from all other shards'. Rows are shuffled by a hash inside their shard.

The driver holds a row per source, as the weights do, and sums of up to ``blocks`` blocks more.
Rows are never collected; which rows are drawn follows from hashes and seeds, so reruns agree
and a lost task repeats itself.

A null or empty text has size 0: such rows go with their block. Null ids, repeated ids and
repeated rows are all rows of their own. An empty table gives no rows. Input columns are
kept in a struct meanwhile, so no name clashes inside.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plotmark.session import materialize

WEIGHTS, MOST = (1, 2, 3), 3
BLOCKS, SHARDS, SEED = 4096, 64, 11
# Bits of the second hash that one round of sums fixes.
DIGIT = 12
WORD, SPACE = r"[^ \t\n\x0B\f\r]+", " \t\n\x0b\f\r"


def size_of(text: Column) -> Column:
    """The number of words of a text, 0 if null; no list of words is made."""
    marks = F.translate(F.regexp_replace(text, WORD, "."), SPACE, "")
    return F.coalesce(F.char_length(marks), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[int], most: int) -> list[Fraction]:
    """Shares of all words by weight, none above ``most`` times its size."""
    out: list[Fraction | None] = [None] * len(sizes)
    rest = Fraction(sum(sizes))
    while True:
        free = [k for k, t in enumerate(out) if t is None]
        total = sum(weights[k] for k in free)
        full = [k for k in free if rest * weights[k] > total * most * sizes[k]]
        if not full:
            for k in free:
                out[k] = rest * weights[k] / total
            return out
        for k in full:
            out[k] = Fraction(most * sizes[k])
        rest -= sum(out[k] for k in full)


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas per shard and source: a tree of multivariate hypergeometric draws.

    Shards get numbers of blocks that differ by one at most. A node's draw depends on the seed
    and its shards only.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    nodes = [(0, shards, np.asarray(quotas, np.int64))]
    while nodes:
        low, high, have = nodes.pop()
        total = int(have.sum())
        if high - low == 1 or not total:
            out[low] = have
            continue
        mid = (low + high) // 2
        # Blocks of the shards before ``at`` when the node's blocks are dealt in turn.
        left = total * (mid - low) // (high - low)
        rng = np.random.default_rng((seed, low, high))
        drawn = _hypergeometric(rng, have, left)
        nodes += [(low, mid, drawn), (mid, high, have - drawn)]
    return out


def _hypergeometric(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """One draw of ``n`` without replacement: source by source, each from what is left."""
    out = np.zeros_like(have)
    after = int(have.sum())
    for k in np.flatnonzero(have):
        after -= int(have[k])
        out[k] = rng.hypergeometric(int(have[k]), after, n) if n else 0
        n -= int(out[k])
    return out


def _permutation(source: str | None, n: int, turn: int, seed: int) -> np.ndarray:
    name = zlib.crc32(b"" if source is None else b"." + source.encode())
    return np.random.default_rng((seed, name, turn)).permutation(n)


def _unsigned(x: Column, bits: int) -> Column:
    """The leading bits of a hash, as a number that is not negative."""
    return F.shiftrightunsigned(x, 64 - bits)


class _Source:
    """The sequence of one source's permuted blocks, up to its target."""

    def __init__(self, name: str | None, words: np.ndarray, target: Fraction, seed: int):
        self.blocks: list[tuple[int, int]] = []
        self.cut: tuple[int, Fraction] | None = None
        left, turn = target, 0
        while left > 0:
            order = _permutation(name, len(words), turn, seed)
            for b in order.tolist():
                if left <= 0:
                    return
                if words[b] > left:
                    self.cut = (b, left)
                    break
                self.blocks.append((turn, b))
                left -= int(words[b])
            if self.cut:
                self.blocks.append((turn, self.cut[0]))
                return
            turn += 1


def _bounds(work: DataFrame, cuts: dict[int, tuple[int, Fraction]]) -> dict[int, int]:
    """The bound of the second hash, per source, up to which its cut block is taken.

    Hashes are 60 bits long. Each round sums sizes by the next digit and goes on inside the digit
    in which the words wanted end, until it holds a single hash.
    """
    spark = work.sparkSession
    done: dict[int, int] = {}
    # Per source: block, bits fixed, their value, words still wanted.
    state = {s: (block, 0, 0, left) for s, (block, left) in cuts.items()}
    while state:
        fixed = next(iter(state.values()))[1]
        table = pa.table(
            {
                "s": pa.array(list(state), pa.int32()),
                "block": pa.array([x[0] for x in state.values()], pa.int32()),
                "prefix": pa.array([x[2] for x in state.values()], pa.int64()),
            }
        )
        inside = work.join(spark.createDataFrame(table), ["s", "block"]).filter(
            F.shiftright("fine", 60 - fixed) == F.col("prefix")
        )
        digit = F.shiftright("fine", 60 - fixed - DIGIT).alias("digit")
        # Several digits may hold one row each; what matters is whether the one at the bound does.
        sums = inside.groupBy("s", digit).agg(
            F.sum("size").alias("words"), F.min("fine").alias("low"), F.max("fine").alias("high")
        )
        rows: dict[int, list] = {}
        for r in sums.collect():
            rows.setdefault(r.s, []).append((r.digit, r.words, r.low, r.high))
        further = {}
        for s, (block, _, _, left) in state.items():
            bound = -1
            for value, words, low, high in sorted(rows.get(s, [])):
                if words <= left:
                    left -= words
                    bound = high
                    continue
                if low == high:
                    # A single hash, all or nothing: what comes nearer.
                    bound = high if 2 * left >= words else low - 1
                else:
                    further[s] = (block, fixed + DIGIT, value, left)
                break
            if s not in further:
                done[s] = bound
        state = further
    return done


def mix(
    df: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    shards: int = SHARDS,
    blocks: int = BLOCKS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """(row, key, size, source_size, target, draws) per row of the input.

    ``row`` holds the columns ``keep`` (all, unless given); ``draws`` lists the times the row is
    taken, each with its ``turn`` and ``shard``.
    """
    spark = df.sparkSession
    kept = df.columns if keep is None else list(keep)
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    work = materialize(
        df.select(
            F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
            F.col(source_col).cast("string").alias("source"),
            size_of(F.col(text_col)).alias("size"),
            key.alias("key"),
        ),
        "mix-rows",
    )
    found = work.groupBy("source").agg(F.sum("size").alias("size")).collect()
    # Code points compare as UTF-8 bytes do.
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    names, sizes = [r.source for r in found], [r.size for r in found]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(names))], most)
    total = max(sum(sizes), 1)
    parts = [max(1, blocks * s // total) for s in sizes]
    sources = pa.table(
        {
            "source": pa.array(names, pa.string()),
            "s": pa.array(range(len(names)), pa.int32()),
            "parts": pa.array(parts, pa.int32()),
            "source_size": pa.array(sizes, pa.int64()),
            "target": pa.array([float(t) for t in goal], pa.float64()),
        }
    )
    known = spark.createDataFrame(sources).withColumnRenamed("source", "_source")
    placed = work.join(known, F.col("source").eqNullSafe(F.col("_source"))).select(
        "row", "size", "key", "s", "source_size", "target",
        F.shiftright(_unsigned(F.col("key"), 31) * F.col("parts"), 31).cast("int").alias("block"),
        _unsigned(F.xxhash64("key", F.lit(seed)), 60).alias("fine"),
    )
    words = [np.zeros(n, np.int64) for n in parts]
    for r in placed.groupBy("s", "block").agg(F.sum("size").alias("words")).collect():
        words[r.s][r.block] = r.words
    drawn = [_Source(n, w, t, seed) for n, w, t in zip(names, words, goal)]
    bounds = _bounds(placed.select("s", "block", "size", "fine"), {s: d.cut for s, d in enumerate(drawn) if d.cut})
    quotas = split_quotas(np.array([len(d.blocks) for d in drawn], np.int64), shards, seed)
    ends = np.cumsum(quotas, axis=0)
    rows: dict[tuple[int, int], list[dict]] = {}
    for s, d in enumerate(drawn):
        of = np.searchsorted(ends[:, s], np.arange(len(d.blocks)), side="right")
        for p, (turn, block) in enumerate(d.blocks):
            bound = bounds[s] if d.cut and p == len(d.blocks) - 1 else None
            rows.setdefault((s, block), []).append({"turn": turn, "shard": int(of[p]), "bound": bound})
    kind = pa.list_(pa.struct([("turn", pa.int32()), ("shard", pa.int32()), ("bound", pa.int64())]))
    draws = pa.table(
        {
            "s": pa.array([k[0] for k in rows], pa.int32()),
            "block": pa.array([k[1] for k in rows], pa.int32()),
            "draws": pa.array(list(rows.values()), kind),
        }
    )
    taken = placed.join(spark.createDataFrame(draws), ["s", "block"], "left")
    inside = F.filter("draws", lambda d: d["bound"].isNull() | (F.col("fine") <= d["bound"]))
    plain = F.transform(inside, lambda d: F.struct(d["turn"].alias("turn"), d["shard"].alias("shard")))
    none = F.array().cast("array<struct<turn:int,shard:int>>")
    return taken.select("row", "key", "size", "source_size", "target", F.coalesce(plain, none).alias("draws"))


def mixed(drawn: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of the mix: input columns with ``shard`` and ``turn``, each shard in one partition
    and in an order of its own. ``drawn`` comes from ``mix``."""
    each = drawn.select("row", "key", F.explode("draws").alias("draw"))
    place = F.xxhash64("key", "draw.turn", F.lit(seed))
    dealt = each.withColumn("place", place).repartition(shards, "draw.shard").sortWithinPartitions("draw.shard", "place", "key")
    return dealt.select("row.*", "draw.shard", "draw.turn")
