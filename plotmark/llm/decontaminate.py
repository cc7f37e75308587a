"""Benchmark passages in documents, by a prefix-filtered join with exact verification.

A window is ``window`` consecutive words of a benchmark item, or the whole of a shorter
item. A document has a window if all its words occur in a row, so every shingle of the window
must be there and one necessary shingle is enough to join on. Shingles are ordered by how
often the corpus has them, and each window is joined on its rarest one. Of the pairs that
meet, the shingle's offset and the two lengths rule out those where the window would not lie
inside the document; the rest are compared word by word.

Documents are read twice: to count the shingles the benchmark has, and to find the joining
ones. Both scans test a bit filter of fixed size (``filter_bits``) that is sent to the
executors; the benchmark itself is never sent or collected. A larger benchmark needs a
larger filter to stay fast, not to stay right. Each scan keeps a row per document or
passage, so texts are not shuffled.

Null, empty and wordless texts have no words, no hits and no items. A null item id counts as
an empty one; equal items count each. Rows with equal id and text get equal results; other
rows never share any, repeated or null ids included. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from plotmark.llm.common import Memo, bit_filter, held, passing, texts
from plotmark.session import materialize

WINDOW = 13
SHINGLE = 4
FILTER_BITS = 22

# ASCII letters fold to lower case; digits, letters and bytes of other characters are word bytes.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    memo = held("word-hashes", lambda: Memo(xxhash.xxh64_intdigest))
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, from 1 to ``SHINGLE``."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * _MIX[k]
        out ^= out >> np.uint64(29)
    return out


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item, window, size): the windows of every item, each with its words joined by spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in texts(batches, "text"):
            for item, text in zip(batch.column("item").to_pylist(), rows):
                words = words_of(text)
                size = min(window, len(words))
                found = {b" ".join(words[i : i + size]).decode() for i in range(len(words) - size + 1)} if words else ()
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(found)), pa.array(list(found)), pa.array([size] * len(found), pa.int32())],
                        ["item", "window", "size"],
                    )

    return items.mapInArrow(cut, "item string, window string, size int")


def _shingles(windows: DataFrame) -> DataFrame:
    """(window, size, shingle, at, hash) of each window's shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for window, size in zip(batch.column("window").to_pylist(), batch.column("size").to_pylist()):
                width = min(SHINGLE, size)
                hashes = shingle_hashes(_word_hashes(window.encode().split()), width).view(np.int64).tolist()
                out += [(window, size, width, at, h) for at, h in enumerate(hashes)]
            if out:
                names = ["window", "size", "width", "at", "hash"]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return windows.mapInArrow(cut, "window string, size int, width int, at int, hash long")


def _counts(docs: DataFrame, known: Broadcast, bits: int, widths: list[int]) -> DataFrame:
    """(hash, n): documents of each shingle that passes the filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(known.value, np.uint8)
        for _, rows in texts(batches, "text"):
            found = []
            for text in rows:
                hashes = _word_hashes(words_of(text))
                for width in widths:
                    shingles = shingle_hashes(hashes, width)
                    found.append(np.unique(shingles[passing(shingles, table, bits)]))
            each, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), found)
            if len(each):
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n)], ["hash", "n"])

    return docs.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, known: Broadcast, bits: int, widths: list[int], window: int) -> DataFrame:
    """(id, row, n_words, found) per row of the documents.

    ``row`` names the row by its id and text. ``found`` has each joining shingle with its
    position and the words around it that any of its windows can need.
    """
    place = pa.struct([("hash", pa.int64()), ("pos", pa.int32()), ("first", pa.int32()), ("around", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(known.value, np.uint8)
        for batch, rows in texts(batches, "text"):
            counts, found, names = [], [], []
            for name, text in zip(batch.column("name").to_pylist(), rows):
                words = words_of(text)
                hashes = _word_hashes(words)
                here = []
                for width in widths:
                    shingles = shingle_hashes(hashes, width)
                    for pos in passing(shingles, table, bits).tolist():
                        first = max(0, pos - window + width)
                        around = b" ".join(words[first : pos + window]).decode()
                        here.append({"hash": int(shingles[pos].view(np.int64)), "pos": pos, "first": first, "around": around})
                counts.append(len(words))
                found.append(here)
                names.append(xxhash.xxh3_128_digest(f"{name}\n{text}".encode()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(names, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(found, pa.list_(place)),
                ],
                ["id", "row", "n_words", "found"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.col("id").cast("string").alias("name"), "text").mapInArrow(
        find, f"id {kind}, row binary, n_words long, found array<struct<hash long, pos int, first int, around string>>"
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """Hit at all, and in a twentieth of the words at least."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def benchmark_hits(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(id, n_words, n_hit, items) per row: words inside any occurrence of a window, and the
    sorted ids, as strings, of the items with a window in the document."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")
    )
    of_items = materialize(_windows(items, window), "windows")
    shingles = materialize(_shingles(of_items.select("window", "size").distinct()), "shingles")
    widths = [r.width for r in shingles.select("width").distinct().orderBy("width").collect()]  # at most SHINGLE rows

    counts = _counts(docs, bit_filter(shingles, filter_bits), filter_bits, widths)
    rarest = F.min_by(F.struct("width", "at", "hash"), F.struct(F.coalesce("n", F.lit(0)), F.col("at")))
    prefixes = materialize(
        shingles.join(counts, "hash", "left").groupBy("window", "size").agg(rarest.alias("p")).select("window", "size", "p.*"),
        "prefixes",
    )
    scanned = materialize(_candidates(docs, bit_filter(prefixes, filter_bits), filter_bits, widths, window), "candidates")

    places = scanned.select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*").distinct()
    start = F.col("pos") - F.col("at")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), start - F.col("first") + 1, F.col("size")), " ") == F.col("window")
    # The comparison runs only where the window lies inside: a slice must not start before 1.
    hits = materialize(
        places.join(prefixes, "hash")
        .filter(F.when(inside, same).otherwise(False))
        .select("row", start.alias("start"), (start + F.col("size")).alias("end"), "window"),
        "hits",
    )
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = (
        hits.select("row", "start", "end").distinct()
        .select("row", F.greatest(F.col("end") - reached, F.lit(0)).alias("new"))
        .groupBy("row").agg(F.sum("new").alias("n_hit"))
    )
    named = (
        hits.select("row", "window").distinct().join(of_items.select("window", "item"), "window")
        .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = materialize(covered.join(named, "row"), "found")
    return scanned.select("id", "row", "n_words").join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _sql_words(text: str) -> str:
    upper = "".join(map(chr, range(65, 91)))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '{word}')"


#: The query's rows in DuckDB: every window against every position.
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words('text')} AS w FROM documents),
 items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_sql_words('text')} AS w FROM benchmark),
 windows AS (SELECT DISTINCT item, k, array_to_string(w[i + 1:i + k], ' ') AS s FROM (
   SELECT item, w, least({WINDOW}, len(w)) AS k, unnest(range(0, len(w) - least({WINDOW}, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
 places AS (SELECT r, i, k, array_to_string(w[i + 1:i + k], ' ') AS s FROM (
   SELECT r, w, k, unnest(range(0, greatest(len(w) - k + 1, 0))) AS i FROM docs, (SELECT DISTINCT k FROM windows))),
 hits AS (SELECT r, i, k, item FROM places JOIN windows USING (k, s)),
 covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
 named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""
