"""Near copies by exact Jaccard similarity of word shingles, found by fingerprints and, where
these miss links, by prefix filtering.

Two texts are linked if the sets of their shingles (runs of ``size`` words, ASCII letters in
lower case; a shorter text is one shingle) have a similarity of ``SHARE`` or more. With all
shingles in one common order, two such sets share one of the first n - ceil(0.8 n) + 1 of each,
so no link is lost. Common shingles come last in that order. It is taken from hashed counters
of all texts, of a fixed size; the order moves the work, never the result.

Texts with equal sets become one node first, and each node has the SimHash fingerprint of its
set. Bit-sliced comparison (``simhash``) finds for each node the closest of those before it
within ``RADIUS`` bits; these pairs are checked on the whole sets like all others, so that a
fingerprint alone links nothing, and most near copies are in their component before a shingle
is compared. Fingerprints miss a part of the links, most of all near the least similarity; the
rounds below find every link that is then still missing between components.

Nodes of different components that share a prefix shingle and can still
reach the similarity, by their sizes and the shingle's places, are candidates. Each node has a
parity bitmap, in which each shingle toggles a bit: two bitmaps differ in no more bits than
their sets differ in shingles, so a candidate whose bitmaps differ in more than the similarity
allows is out. The rest are verified on the whole sets, which only their texts are read again
for. Two rounds compare a shingle's nodes with one of them only (the first with the same for all
shingles of a group, the second with one of each shingle's own), then a last one compares those
that are not yet in one component, with the bitmaps at hand, so that large groups of near copies
never give all their pairs. A shingle of over ``TILE`` nodes is split into tiles.

Null and empty texts have the empty set and are copies of each other. A component's id is its
least document id. Other columns of the input are not read. A text's set is held at once by
the task that reads it, eight bytes a word; sets and shingles are told apart by 64-bit hashes, and
"exact" is up to these. Tables of one round are deleted once the next one needs them no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from plotmark.llm import simhash
from plotmark.llm.common import release, small_batches, texts
from plotmark.operators.components import connected_components
from plotmark.session import discard, materialize, materialize_counted

# The least similarity, as a fraction.
SHARE = (4, 5)
# Bits in which the fingerprints of candidates may differ.
RADIUS = 8
# Bits of a shingle's hash that choose its counter, and counters that are summed together.
COUNTER_BITS, SUM_BITS = 22, 14
# Least bits of a bitmap.
LEAST_BITS = 512
# Rounds in which each shingle compares its nodes with one of them only.
STARS = 2
# Nodes of one shingle that meet in one tile.
TILE = 4096
# Candidate pairs held at a time.
_SLAB = 1 << 18
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingles(text: str, size: int = 5) -> np.ndarray:
    """The ascending distinct hashes of a text's shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64))


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a set's shingles, common ones last, of which similar sets share one."""
    n = len(hashes)
    num, den = SHARE
    keep = n + num * -n // den + 1 if n else 0
    rank = counts[hashes >> np.uint64(64 - (len(counts).bit_length() - 1))]
    return hashes[np.lexsort((hashes, rank))[:keep]]


def parity(hashes: np.ndarray) -> bytes:
    """A bitmap in which each shingle toggles its bit: about a bit per shingle, a power of two, and
    ``LEAST_BITS`` at least, so that for short texts few shingles share a bit."""
    bits = max(LEAST_BITS, 1 << (max(len(hashes), 1) * 7 // 10).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_reach(a: bytes, n_a: int, b: bytes, n_b: int) -> bool:
    """Whether two sets of these sizes and bitmaps can be alike enough."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    size = min(len(a), len(b)) * 8
    x, y = _folded(x, size), _folded(y, size)
    num, den = SHARE
    # Of sets alike by num / den, at most (den - num) / (den + num) of all shingles differ.
    return (den + num) * (x ^ y).bit_count() <= (den - num) * (n_a + n_b)


def _folded(x: int, size: int) -> int:
    out = 0
    while x:
        out ^= x & ((1 << size) - 1)
        x >>= size
    return out


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few sets are held at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _counts(docs: DataFrame, size: int) -> np.ndarray:
    """Texts per hashed counter, over all rows: a table of fixed size on the driver."""
    width = 1 << SUM_BITS

    def rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        blocks = total.reshape(-1, width)
        used = np.flatnonzero(blocks.any(1))
        # By byte planes, of which the high ones are nearly empty and compress well.
        packed = [np.ascontiguousarray(blocks[k].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for k in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], ["block", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(1 << COUNTER_BITS, np.uint32)
        for _, batch in texts(_parts(batches), "text"):
            # Equal texts of a part count once, and so do shingles of a text with one counter.
            for text in set(batch):
                total[shingles(text, size) >> np.uint64(64 - COUNTER_BITS)] += 1
        yield from rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, np.zeros(width, np.uint64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([held.tobytes()])], ["block", "packed"])

        for batch in batches:
            for k, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist()):
                if k != block and block is not None:
                    yield done()
                    held[:] = 0
                block = k
                held += np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()
        if block is not None:
            yield done()

    kinds = "block int, packed binary"
    counted = docs.select("text").mapInArrow(count, kinds).repartition("block").sortWithinPartitions("block")
    out = np.zeros((1 << (COUNTER_BITS - SUM_BITS), width), np.uint64)
    for r in counted.mapInArrow(add, kinds).collect():
        out[r.block] = np.frombuffer(r.packed, np.uint64)
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


def _sets(docs: DataFrame, counts: Broadcast, size: int) -> DataFrame:
    """(id, node, n, text_hash, print, prefix, bitmap) per row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(counts.value, np.uint32)
        for batch, rows in texts(_parts(batches), "text"):
            sets = [shingles(t, size) for t in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([_node(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    batch.column("text_hash"),
                    pa.array(np.array([simhash.of_hashes(s) for s in sets], np.uint64).view(np.int64)),
                    pa.array([prefix(s, table).view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([parity(s) for s in sets], pa.binary()),
                ],
                ["id", "node", "n", "text_hash", "print", "prefix", "bitmap"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    columns = "node long, n long, text_hash long, print long, prefix array<long>, bitmap binary"
    return docs.mapInArrow(make, f"id {kind}, {columns}")


def _members(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, hashes) of the given nodes, from one text of each and its equals."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in texts(_parts(batches), "text"):
            sets = [shingles(t, size) for t in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["node", "hashes"],
            )

    known = nodes.select("text_hash").distinct()
    # A copy of each text is enough.
    once = docs.join(known, "text_hash", "left_semi").select("text_hash", "text").dropDuplicates(["text_hash"])
    return once.select("text").mapInArrow(make, "node long, hashes array<long>").join(nodes, "node", "left_semi")


def _cells(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(columns, starts, ends) of stretches of sorted rows that never cut a key."""
    held: list[dict[str, np.ndarray]] = []

    def joined():
        block = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        new = np.ones(len(block[keys[0]]), bool)
        new[1:] = np.any([block[k][1:] != block[k][:-1] for k in keys], axis=0)
        return block, np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names})
        if sum(len(h[keys[0]]) for h in held) < rows:
            continue
        block, starts = joined()
        last = starts[-1]
        if last:
            yield {k: v[:last] for k, v in block.items()}, starts[:-1], np.r_[starts[1:-1], last]
        held = [{k: v[last:] for k, v in block.items()}]
    if held:
        block, starts = joined()
        yield block, starts, np.r_[starts[1:], len(block[keys[0]])]


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by key, whose key has others; one row at most is held."""
    last: tuple[pa.RecordBatch, bool] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last[0], batch]).combine_chunks().to_batches()[0]
        key = batch.column("key").to_numpy()
        same = np.r_[last is not None and last[1], key[1:] == key[:-1]]
        live = same[:-1] | same[1:]
        if live.any():
            yield batch.slice(0, len(live)).filter(pa.array(live))
        last = batch.slice(len(live)), bool(same[-1])
    if last is not None and last[1]:
        yield last[0]


def _turn(block: dict, round_: int) -> np.ndarray:
    """An order of the nodes of each key. In the first round all keys agree, so that a group of near
    copies meets one node; later each key has its own, so that what is left meets many."""
    x = block["node"].view(np.uint64) ^ _SALT[0] * np.uint64(round_)
    if round_:
        x = x ^ block["key"].view(np.uint64) * _SALT[2]
    x = (x ^ x >> np.uint64(32)) * _SALT[1]
    return x ^ x >> np.uint64(29)


def _first(turn: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each stretch, the position of the least value, for each row."""
    least = np.repeat(np.minimum.reduceat(turn, starts), ends - starts)
    at = np.flatnonzero(turn == least)
    stretch = np.searchsorted(starts, at, "right") - 1
    first = np.zeros(len(starts), np.int64)
    first[stretch[::-1]] = at[::-1]
    return np.repeat(first, ends - starts)


def _can(block: dict, i, j) -> np.ndarray:
    """Whether sizes and places of a shared shingle leave room for the similarity."""
    num, den = SHARE
    n, pos = block["n"], block["pos"]
    most = np.minimum(n[i] - pos[i], n[j] - pos[j])
    return (block["root"][i] != block["root"][j]) & ((num + den) * most >= num * (n[i] + n[j]))


def _batch(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(c) for c in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _print_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): candidates by fingerprint, a pair per node at most. Nodes of one fingerprint meet the
    least of them; these meet the closest fingerprint before theirs within ``RADIUS``."""
    prints, seen = materialize_counted(
        nodes.groupBy("print").agg(F.min("node").alias("first")), "prints", rows=F.count("*")
    )
    same = nodes.select("node", "print").join(prints, "print").filter("node <> first")
    near = simhash.closest_before(
        prints.select(F.col("print").alias("node")), RADIUS, simhash.blocks_to_match(seen["rows"], RADIUS)
    )
    of = lambda x: prints.select(F.col("print").alias(x), F.col("first").alias(f"node_{x}"))
    ends = near.join(of("a"), "a").join(of("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    both = ends.unionByName(same.select(F.col("first").alias("a"), F.col("node").alias("b")))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _star_pairs(cells: DataFrame, round_: int) -> DataFrame:
    """(a, b): candidates of each key's first node, in this round's order, with the others."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, starts, ends in _cells(batches, ["key", "own"]):
            one = _first(_turn(block, round_), starts, ends)
            two = np.arange(len(one))
            keep = (one != two) & _can(block, one, two)
            if keep.any():
                yield _batch([(block["node"][one[keep]], block["node"][two[keep]])])

    dealt = cells.repartition("key", "own").sortWithinPartitions("key", "own")
    return dealt.mapInArrow(pair, "a long, b long").distinct()


def _screened(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that their bitmaps leave."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("map_a", "n_a", "map_b", "n_b"))
            keep = pa.array([may_reach(*row) for row in zip(*columns)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    of = lambda x: nodes.select(F.col("node").alias(x), F.col("bitmap").alias(f"map_{x}"), F.col("n").alias(f"n_{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(screen, "a long, b long")


def _all_pairs(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): what the bitmaps leave of all candidates that no round has compared."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for block, starts, ends in _cells(batches, ["key", "s", "t"]):
            node, n, maps = block["node"], block["n"], block["bitmap"]
            mixed = np.maximum.reduceat(block["root"], starts) != np.minimum.reduceat(block["root"], starts)
            # A key of one tile has met its first nodes in full.
            met = np.zeros(len(node), bool)
            for r in range(STARS):
                met |= _first(_turn(block, r), starts, ends) == np.arange(len(node))
            met &= block["s"] < 0
            for s, e in zip(starts[mixed], ends[mixed]):
                rows = s + np.flatnonzero(~met[s:e])
                for k in range(len(rows) - 1):
                    i, rest = rows[k], rows[k + 1 :]
                    near = rest[_can(block, i, rest)]
                    near = np.array([j for j in near if may_reach(maps[i], n[i], maps[j], n[j])], np.int64)
                    if len(near):
                        out.append((np.full(len(near), node[i]), node[near]))
                        held += len(near)
                    if held >= _SLAB:
                        yield _batch(out)
                        out, held = [], 0
        if out:
            yield _batch(out)

    one = F.col("tiles") == 1
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: t != F.col("own"))
    dealt = cells.withColumn("other", F.explode(F.when(one, F.array(F.lit(-1))).otherwise(others))).withColumns(
        {
            "s": F.when(one, -1).otherwise(F.least("own", "other")),
            "t": F.when(one, -1).otherwise(F.greatest("own", "other")),
        }
    )
    mapped = dealt.select("key", "s", "t", "node", "n", "pos", "root").join(nodes.select("node", "bitmap"), "node")
    sorted_ = mapped.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t")
    return sorted_.mapInArrow(pair, "a long, b long").distinct()


def _verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    num, den = SHARE
    one = members.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
    two = members.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    enough = (num + den) * both >= num * (F.size("of_a") + F.size("of_b"))
    return pairs.join(one, "a").join(two, "b").filter(enough).select("a", "b")


def links(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, root) of the nodes with links; ``nodes`` has node, n, text_hash, print, prefix and bitmap."""
    none = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    edges = materialize(none, "links")
    roots = connected_components(edges)

    def link(near: DataFrame) -> None:
        nonlocal edges, roots
        ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = materialize(nodes.select("node", "text_hash").join(ends, "node", "left_semi"), "wanted")
        members = materialize(_members(docs, wanted, size), "members")
        more, seen = materialize_counted(_verified(near, members), "links", rows=F.count("*"))
        for table in (near, wanted, members):
            discard(table)
        if seen["rows"]:
            edges = edges.unionByName(more)
            roots = materialize(connected_components(edges), "roots")

    def screened(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        near = materialize(_screened(pairs, nodes), "near")
        discard(pairs)
        return near

    link(screened(_print_pairs(nodes)))
    keys = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "key")).withColumn("pos", F.col("pos").cast("long"))
    live = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_live, "node long, n long, pos long, key long")
    cells = materialize(live, "cells")
    hot, seen = materialize_counted(
        cells.groupBy("key").count().filter(F.col("count") > TILE), "hot-keys", rows=F.count("*")
    )
    tiled = cells.withColumns({"tiles": F.lit(1), "own": F.lit(0)})
    if seen["rows"]:
        tiles = hot.select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
        tiled = cells.join(tiles, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        tiled = tiled.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    for round_ in range(STARS + 1):
        rooted = tiled.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if round_ < STARS:
            link(screened(_star_pairs(rooted, round_)))
        else:
            link(materialize(_all_pairs(rooted, nodes), "near"))
    discard(cells)
    return roots


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """(id, component_id) per row."""
    with small_batches(df.sparkSession):
        return _components(df, id_col, text_col, size)


def _components(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    counts = df.sparkSession.sparkContext.broadcast(_counts(docs, size).tobytes())
    sets = materialize(_sets(docs, counts, size), "sets")
    grouped = sets.groupBy("node").agg(
        F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("n", "text_hash", "print", "prefix", "bitmap")]
    )
    nodes = materialize(grouped, "nodes")
    known = materialize(sets.select("id", "node"), "ids")
    discard(sets)
    roots = links(docs, nodes, size)
    linked = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    components = materialize(linked.join(least, "root").select("node", "component_id"), "components")
    discard(nodes)
    return known.join(components, "node").select(F.col("id").alias(id_col), "component_id")
