"""SimHash fingerprints of word shingles, and their links by bit-sliced comparison.

A fingerprint bit is set if it is set in over half of the hashes of the text's shingles,
repeats included. Documents whose fingerprints differ in at most ``radius`` bits are linked.

Equal fingerprints become one node first, so copies are never paired. Nodes that differ in
``radius`` bits at most agree in ``match`` of ``radius + match`` bit blocks, whatever the
bits: each choice of blocks is a key, and only nodes with an equal key are compared. Larger
tables take more blocks, hence longer keys; the links are the same for every choice. A key
with many nodes is split into tiles that meet pairwise, so no task holds a whole hot key.
Within a tile, distances to 64 nodes at a time are counted in bit planes, and what exceeds
the radius in every lane is dropped early. A tile gives a spanning forest of its links, never
its pairs, or each fingerprint's closest one before it.

Null and empty texts have no shingle and the fingerprint zero, linked like any other. A
component's id is its least document id; null ids never are, unless all its ids are null.
Repeated rows keep their count. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plotmark.llm.common import texts
from plotmark.operators.components import connected_components
from plotmark.session import materialize, materialize_counted

# Nodes of one key that meet in one tile.
TILE = 4096
# (node, word) pairs held at a time while distances are counted.
_SLAB = 1 << 16


def fingerprint(text: str, size: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text; ASCII letters count in lower case."""
    # Splitting bytes is splitting at ASCII white space: tab to carriage return, and space.
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    counts, half = np.zeros(64, np.int64), n
    for low in range(0, n, 1 << 16):
        part = words[low : low + (1 << 16) + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)))) if len(words) >= size else [b" ".join(part)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), "<u8")
        counts += _set_bits(hashes)
    return _majority(counts, half)


def of_hashes(hashes: np.ndarray) -> int:
    """The unsigned 64-bit fingerprint of a text given by the hashes of its shingles."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        counts += _set_bits(hashes[low : low + (1 << 16)])
    return _majority(counts, len(hashes))


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, half: int) -> int:
    return int(np.packbits(2 * counts > half, bitorder="little").view("<u8")[0])


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42
) -> DataFrame:
    """(id, fingerprint) per row, the fingerprint as a signed 64-bit integer of the same bits."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in texts(batches, "text"):
            prints = np.array([fingerprint(t, size, seed) for t in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["id", "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, f"id {kind}, fingerprint long").withColumnRenamed("id", id_col)


def _ones(n: np.ndarray) -> np.ndarray:
    """Words whose lowest ``n`` bits are set, for n from 1 to 64."""
    return np.uint64(2**64 - 1) >> (64 - n).astype(np.uint64)


def close_forest(prints: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint, a member of its component among those of its group.

    ``group`` numbers are ascending. Members are in one component if a chain of
    distances up to ``radius`` joins them; the member named is the first of it.
    """
    label = np.arange(len(prints))
    for a, b in _near(prints, group, radius):
        label = _joined(label, a, b)
    return label


def closest(prints: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint, the place of the closest of those before it in its group, the first
    of equally close ones, or -1 if none is within ``radius``. ``group`` numbers are ascending."""
    none = np.iinfo(np.int64).max
    best = np.full(len(prints), none)
    for a, b in _near(prints, group, radius, _SLAB // 4):
        np.minimum.at(best, b, np.bitwise_count(prints[a] ^ prints[b]).astype(np.int64) << 32 | a)
    return np.where(best == none, -1, best & (2**32 - 1))


def _near(
    prints: np.ndarray, group: np.ndarray, radius: int, slab: int = _SLAB
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), part by part: the places a < b of a group whose fingerprints are within ``radius``."""
    n = len(prints)
    if n < 2:
        return
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    words = -(-sizes // 64)
    # Bit planes: of each group, 64 members are the lanes of one word.
    lane = np.arange(n) - np.repeat(starts, sizes)
    first_word = np.cumsum(words) - words
    word = np.repeat(first_word, sizes) + lane // 64
    padded = np.zeros(int(words.sum()) * 64, np.uint64)
    padded[word * 64 + lane % 64] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little")
    planes = np.ascontiguousarray(planes).view("<u8").reshape(64, -1)
    members = np.minimum(np.repeat(sizes, words) - (np.arange(len(planes[0])) - np.repeat(first_word, words)) * 64, 64)
    lanes = _ones(members)
    # Each member meets the words from its own on.
    meets = np.repeat(first_word + words, sizes) - word
    ends = np.cumsum(meets)
    low = 0
    while low < n:
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + slab, "right"))
        high = min(max(high, low + 1), n)
        m = meets[low:high]
        query = np.repeat(np.arange(low, high), m)
        target = np.repeat(word[low:high], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        a, b = _close_pairs(prints, planes, lanes, query, target, radius)
        b = np.repeat(starts - first_word * 64, sizes)[a] + b
        keep = b > a
        yield a[keep], b[keep]
        low = high


def _close_pairs(prints, planes, lanes, query, target, radius):
    """(query, 64 * word + lane) of the lanes within ``radius`` of their query.

    Counters hold one bit of 64 distances each, and start so that the top one carries
    out at ``radius + 1`` differences. Two planes at a time go through a full adder.
    """
    digits = (radius + 1).bit_length()
    preset = 2**digits - (radius + 1)
    full = np.uint64(2**64 - 1)
    count = [np.full(len(query), full if preset >> d & 1 else np.uint64(0)) for d in range(digits)]
    over = ~lanes[target]
    one = np.uint64(1)
    for plane in range(0, 64, 2):
        own = prints[query]
        x, y = (planes[p][target] ^ (np.uint64(0) - (own >> np.uint64(p) & one)) for p in (plane, plane + 1))
        both = count[0] ^ x
        carry = count[0] & x | both & y
        count[0] = both ^ y
        for d in range(1, digits):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry
        if plane % 8 == 6:
            alive = over != full
            if not alive.all():
                query, target, over = query[alive], target[alive], over[alive]
                count = [c[alive] for c in count]
                if not len(query):
                    break
    near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(near)
    return query[row], target[row] * 64 + lane


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]: the least index of each component."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def _keys(radius: int, match: int) -> list[int]:
    """Masks: each joins ``match`` of ``radius + match`` nearly equal bit blocks."""
    cuts = [64 * k // (radius + match) for k in range(radius + match + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, match)]


def _signed(x: int) -> int:
    return x - 2**64 if x >> 63 else x


def blocks_to_match(nodes: int, radius: int) -> int:
    """The least number of equal blocks with at most ``TILE`` evenly spread nodes per key."""
    match = 1
    while match < 4 and nodes >> (64 * match // (radius + match)) > TILE:
        match += 1
    return match


# A node meets those with the same of these; the tiles are null where the key has one.
_CELL = ["choice", "key", "s", "t"]


def _dealt(nodes: DataFrame, radius: int, match: int, tile: int) -> DataFrame:
    """The nodes under each of their keys, and of hot keys in each pair of tiles."""
    masks = [F.col("node").bitwiseAND(F.lit(_signed(m))) for m in _keys(radius, match)]
    keyed = nodes.select("node", F.posexplode(F.array(*masks)).alias("choice", "key"))
    hot = materialize(
        keyed.groupBy("choice", "key").count().filter(F.col("count") > tile), "hot-keys"
    ).select("choice", "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    return (
        keyed.join(hot, ["choice", "key"], "left")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .withColumn(
            "other",
            F.explode(
                F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(
                    F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: t != F.col("own"))
                )
            ),
        )
        .select(
            "choice",
            "key",
            F.least("own", "other").alias("s"),
            F.greatest("own", "other").alias("t"),
            "node",
        )
    )


def links(nodes: DataFrame, radius: int, match: int, tile: int = TILE) -> DataFrame:
    """(a, b): edges that join all nodes within ``radius``; ``nodes`` has distinct prints ``node``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prints, group in _grouped(batches):
            root = close_forest(prints.view(np.uint64), group, radius)
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(prints[moved]), pa.array(prints[root[moved]])], ["a", "b"])

    dealt = _dealt(nodes, radius, match, tile).repartition(*_CELL).sortWithinPartitions(*_CELL)
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def closest_before(nodes: DataFrame, radius: int, match: int, tile: int = TILE) -> DataFrame:
    """(a, b): of all nodes a < b within ``radius`` the closest, the least of equally close ones,
    for each node b that has one; ``nodes`` has distinct prints ``node``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prints, group in _grouped(batches):
            best = closest(prints.view(np.uint64), group, radius)
            found = np.flatnonzero(best >= 0)
            if len(found):
                a, b = prints[best[found]], prints[found]
                differ = np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(differ)], ["a", "b", "differ"])

    dealt = _dealt(nodes, radius, match, tile).repartition(*_CELL).sortWithinPartitions(*_CELL, "node")
    near = dealt.mapInArrow(compare, "a long, b long, differ int")
    return near.groupBy("b").agg(F.min(F.struct("differ", "a")).alias("near")).select("near.a", "b")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes, ascending number of each one's cell) of stretches of sorted rows."""
    for block in _whole_cells(batches, _CELL):
        prints = block.pop("node")
        change = np.zeros(len(prints), bool)
        for c in block.values():
            change[1:] |= c[1:] != c[:-1]
        yield prints, np.cumsum(change)


def _whole_cells(batches, cell, rows: int = 1 << 16):
    """Columns of sorted rows in stretches of about ``rows`` that never cut a cell."""
    held: list[dict[str, np.ndarray]] = []
    n = 0

    def joined():
        return {k: np.concatenate([h[k] for h in held]) for k in held[0]}

    for batch in batches:
        # A cell without tiles has a null pair of tile numbers.
        part = {k: batch.column(k).fill_null(-1).to_numpy(zero_copy_only=False) for k in (*cell, "node")}
        if not batch.num_rows:
            continue
        held.append(part)
        n += batch.num_rows
        if n < rows:
            continue
        block = joined()
        same = np.ones(n, bool)
        for k in cell:
            same &= block[k] == block[k][-1]
        cut = int(np.argmax(same))
        if cut:
            yield {k: v[:cut] for k, v in block.items()}
            held, n = [{k: v[cut:] for k, v in block.items()}], n - cut
        else:
            held = [block]
    if held:
        yield joined()


def near_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4,
    radius: int = 4,
    seed: int = 42,
    match: int | None = None,
    tile: int = TILE,
) -> DataFrame:
    """(id, fingerprint as 16 hexadecimal digits, component_id) per row."""
    prints = materialize(
        fingerprints(df, id_col, text_col, size, seed).select(F.col(id_col).alias("id"), "fingerprint"), "prints"
    )
    nodes, seen = materialize_counted(
        prints.groupBy(F.col("fingerprint").alias("node")).agg(F.min("id").alias("least")), "nodes", rows=F.count("*")
    )
    edges = links(nodes.select("node"), radius, match or blocks_to_match(seen["rows"], radius), tile)
    roots = materialize(connected_components(edges), "roots")
    linked = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    least = linked.filter("root <> node OR least IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"))
    known = materialize(linked.join(least, "root", "left").select("node", "component_id"), "components")
    out = prints.join(known, prints["fingerprint"] == known["node"], "left")
    return out.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
