"""A file of token ids at a fixed bit width, with block offsets for random access.

Layout: blocks, then the index, then a trailer of fixed size.

* A block holds ``block`` ids (the last may hold fewer), each in ``width`` bits, low bits
  first, padded to whole bytes.
* The index has, per document, its id (signed 64 bits) and whether it has one, its token
  count (unsigned 64 bits), and the offset of every block and of the index (unsigned 64).
* The trailer names width, block size, ids, documents, blocks and the index offset.

All integers are little-endian. Packing and unpacking work on whole blocks in NumPy.
"""

from __future__ import annotations

import struct
from typing import BinaryIO

import numpy as np

MAGIC = b"PMTOKEN1"
_TRAILER = struct.Struct("<8sIIQQQQ")


def width_of(vocabulary: int) -> int:
    """The least number of bits that holds every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if width % 8 == 0:
        return octets[:, : width // 8].tobytes()
    bits = np.unpackbits(octets, axis=1, count=width, bitorder="little")
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    octets = np.zeros((n, 4), np.uint8)
    packed = np.frombuffer(data, np.uint8)
    if width % 8:
        bits = np.unpackbits(packed, count=n * width, bitorder="little").reshape(n, width)
        packed = np.packbits(bits, axis=1, bitorder="little")
    octets[:, : (width + 7) // 8] = packed.reshape(n, -1)
    return octets.view("<u4").reshape(-1)


class TokenWriter:
    """Writes documents one after another; only one block is held in memory."""

    def __init__(self, out: BinaryIO, width: int, block: int = 1 << 16):
        self.out, self.width, self.block = out, width, block
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_tokens = self.at = 0
        self.offsets: list[int] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"id {int(ids.max())} does not fit {self.width} bits")
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.n_tokens += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        done = 0
        while len(ids) - done >= self.block or last and done < len(ids):
            data = pack(ids[done : done + self.block], self.width)
            self.offsets.append(self.at)
            self.at += self.out.write(data) or len(data)
            done += self.block
        self.waiting = [ids[done:]]
        self.n_waiting = len(self.waiting[0])

    def close(self) -> None:
        self._flush(last=True)
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        self.out.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.out.write(known.tobytes())
        self.out.write(np.array(self.counts, "<u8").tobytes())
        self.out.write(np.array([*self.offsets, self.at], "<u8").tobytes())
        self.out.write(
            _TRAILER.pack(
                MAGIC, self.width, self.block, self.n_tokens, len(self.counts), len(self.offsets), self.at
            )
        )


class TokenReader:
    """Reads any range of ids or documents, touching only the blocks it needs."""

    def __init__(self, source: BinaryIO, size: int):
        self.source = source
        source.seek(size - _TRAILER.size)
        magic, self.width, self.block, self.n_tokens, self.n_docs, blocks, at = _TRAILER.unpack(
            source.read(_TRAILER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(at)
        data = source.read(size - _TRAILER.size - at)
        n = self.n_docs
        self.known = np.frombuffer(data, np.uint8, n, 8 * n).astype(bool)
        self.doc_ids = np.frombuffer(data, "<i8", n)
        self.starts = np.zeros(n + 1, np.int64)
        np.cumsum(np.frombuffer(data, "<u8", n, 9 * n), out=self.starts[1:])
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, 17 * n)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from ``first`` up to, not including, ``last``."""
        if last <= first:
            return np.zeros(0, "<u4")
        low, high = first // self.block, (last - 1) // self.block
        self.source.seek(int(self.offsets[low]))
        data = self.source.read(int(self.offsets[high + 1] - self.offsets[low]))
        parts = []
        for k in range(low, high + 1):
            a, b = int(self.offsets[k] - self.offsets[low]), int(self.offsets[k + 1] - self.offsets[low])
            parts.append(unpack(data[a:b], min(self.block, self.n_tokens - k * self.block), self.width))
        return np.concatenate(parts)[first - low * self.block : last - low * self.block]
