"""Helpers shared by the operators: model files, bounded memos, Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

# Objects of this Python worker (models, memos), the latest last. Workers are reused, so an
# object is made once per worker; only the latest few stay, or memory would grow by the stage.
_HELD: dict[Hashable, Any] = {}
_HOLD = 2


class Memo(dict):
    """Remembers ``fill(key)`` for up to ``limit`` keys of at most ``longest`` items.

    Memory is bounded: a full memo starts anew from ``always``, and long keys are not kept.
    """

    def __init__(self, fill: Callable, limit: int = 400_000, longest: int = 48, always: dict | None = None):
        super().__init__(always or {})
        self.fill, self.limit, self.longest, self.always = fill, limit, longest, always or {}

    def __missing__(self, key):
        value = self.fill(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.always)
            self[key] = value
        return value


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """One object per worker and key, while it is among the latest used."""
    if key in _HELD:
        if key != next(reversed(_HELD)):
            _HELD[key] = _HELD.pop(key)
    else:
        while len(_HELD) >= _HOLD:
            del _HELD[next(iter(_HELD))]
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Drop what earlier operators left in this worker."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()


def ship_file(spark: SparkSession, path: str, at_most: int = 64 << 20) -> tuple[str, Broadcast]:
    """A vocabulary file of the driver as a broadcast of checked size, with its digest.

    Executors then need no copy of the file. A file above ``at_most`` bytes is refused.
    """
    with open(path, "rb") as f:
        data = f.read(at_most + 1)
    if len(data) > at_most:
        raise ValueError(f"{path} has more than {at_most} bytes")
    return hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Jobs run inside hand texts to Python workers in Arrow batches of about ``size`` bytes.

    Batches are held by the JVM and by the worker at once, for each task; what is computed
    from them adds to it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(size, _bytes(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bytes(size: str) -> int:
    """A setting such as 64m or 67108864b in bytes; what is not limited is large."""
    units = {"b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}
    digits = size.rstrip("bkmgBKMG")
    number = int(digits) << units.get(size[len(digits) :].lower(), 0)
    return number if number > 0 else 1 << 62


def texts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch with its texts; a null text is empty."""
    for batch in batches:
        yield batch, [t or "" for t in batch.column(text).to_pylist()]


def bit_filter(hashes: DataFrame, bits: int) -> Broadcast:
    """A bit per leading ``bits`` of the column ``hash``, as at most 2 ** (bits - 6) words on the driver."""
    spots = hashes.select(F.shiftrightunsigned("hash", 64 - bits).alias("spot"))
    words = (
        spots.select(F.expr("spot div 64").alias("word"), F.expr("shiftleft(1L, int(spot % 64))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(out.tobytes())


def in_filter(hashes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have their bit in a ``bit_filter`` (its bytes as ``table``)."""
    spot = hashes >> np.uint64(64 - bits)
    return (table[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def passing(hashes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the hashes that have their bit in a ``bit_filter``."""
    return np.flatnonzero(in_filter(hashes, table, bits))
