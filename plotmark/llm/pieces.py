"""Byte-pair pieces of a SentencePiece model: exact token counts, encoding and decoding.

Both operators cut the normalised text into chunks, each a run of the space mark followed
by other characters. No piece has a space mark after another character (checked when the
model is loaded), so no merge crosses a chunk border and the text's pieces are those of
its chunks. A chunk is looked up without its first space mark.

Null and empty texts have no pieces. Repeated rows, ties and null ids pass through row by
row. Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from plotmark.llm.common import Memo, held, ship_file, texts

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
_NORMAL, _USER_DEFINED, _UNUSED = 1, 4, 5


class PieceModel:
    """The library's processor with the pieces that merging can make."""

    def __init__(self, data: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        norm = proto.normalizer_spec
        plain = (
            proto.trainer_spec.model_type == 2
            and proto.trainer_spec.byte_fallback
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and not norm.precompiled_charsmap
            and norm.add_dummy_prefix
            and norm.escape_whitespaces
            and not norm.remove_extra_whitespaces
        )
        if not plain or any(p.type in (_USER_DEFINED, _UNUSED) for p in proto.pieces):
            raise ValueError("needs a byte-pair model with byte fallback, space prefix and no normalisation")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        if SPACE not in self.ids or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")


def chunk_keys(text: str) -> list[str]:
    """The chunks of a text, each without its first space mark."""
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [c[1:] for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


def whole_tokens(data: bytes) -> list[str]:
    """The chunk keys proven to be one token: each piece that starts with one space mark
    and that the library, given it alone, encodes as exactly itself."""
    model = PieceModel(data)
    keys = [p[1:] for p in model.ids if len(p) > 1 and p[0] == SPACE and p[1] != SPACE]
    return [k for k, got in zip(keys, model.library.encode(keys)) if got == [model.ids[SPACE + k]]]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) per row, as the library counts them without begin or end id.

    The driver proves which vocabulary strings are one token. Chunks among them count
    directly; only the rest is merged, by the library. A null text counts as empty.
    """
    digest, model = ship_file(df.sparkSession, path)
    proven = df.sparkSession.sparkContext.broadcast(whole_tokens(model.value))

    def counter() -> Memo:
        encode = PieceModel(model.value).library.encode
        # The library encodes nothing for an empty text; the lone space mark is one piece.
        return Memo(lambda key: len(encode(key)), always=dict.fromkeys([*proven.value, ""], 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = held(("counts", digest), counter).__getitem__
        for batch, rows in texts(batches, "text"):
            n = pa.array([sum(map(tokens, chunk_keys(t))) for t in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["id", "n_bytes", "n_tokens"])

    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )
    kind = df.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)


class Backtracker:
    """Exact merge encoding of a chunk by search over its tokens.

    A segmentation is the one that merging makes if each adjacent pair of tokens is what
    merging makes of the pair alone. From left to right the longest matching piece is
    tried first; a piece that does not fit its predecessor gives way to the next shorter
    one, and a position from which nothing fits is marked in a bit field and not tried again.
    """

    def __init__(self, model: PieceModel):
        self.scores = model.scores
        self.matches = ahocorasick.Automaton()
        for piece in model.ids:
            self.matches.add_word(piece, len(piece))
        self.matches.make_automaton()
        self.fits = Memo(lambda pair: self.merge(pair[0] + pair[1]) == list(pair), limit=200_000)
        # Characters that are no piece fall back to their UTF-8 bytes.
        bytes_at = [model.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.ids_of = Memo(
            lambda t: np.array([model.ids[t]] if t in model.ids else [bytes_at[b] for b in t.encode()], "<u4").tobytes()
        )

    def merge(self, text: str) -> list[str]:
        """Merging itself: always the best-scored adjacent pair, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def split(self, chunk: str) -> list[str]:
        n = len(chunk)
        # Matches come by end position, so those of one start ascend in length; the last is the longest.
        lengths: list[list[int]] = [[] for _ in range(n)]
        for end, length in self.matches.iter(chunk):
            lengths[end - length + 1].append(length)
        for options in lengths:
            if not options or options[0] != 1:
                options.insert(0, 1)
        failed, at, fits = 0, 0, self.fits
        chosen: list[tuple[str, int]] = []
        option = len(lengths[0]) - 1
        while at < n:
            while option >= 0:
                token = chunk[at : at + lengths[at][option]]
                if not failed >> at + len(token) & 1 and (not chosen or fits[chosen[-1][0], token]):
                    break
                option -= 1
            if option < 0:
                failed |= 1 << at
                token, option = chosen.pop()
                at -= len(token)
                option -= 1
                continue
            chosen.append((token, option))
            at += len(token)
            option = len(lengths[at]) - 1 if at < n else -1
        return [token for token, _ in chosen]

    def encode(self, key: str) -> bytes:
        """The ids of a chunk, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.ids_of.__getitem__, self.split(SPACE + key)))


def encode_pieces(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    begin: bool = True,
    end: bool = True,
    decoded: bool = True,
) -> DataFrame:
    """(id, n_tokens, ids, decoded) per row: exactly the library's ids, packed as
    little-endian unsigned 32-bit integers (see ``unpack_ids``), and the library's text of
    these ids. A null text is encoded like an empty one: begin and end id only."""
    digest, model = ship_file(df.sparkSession, path)

    def encoder():
        pieces = PieceModel(model.value)
        back = Backtracker(pieces)
        return pieces.library, Memo(back.encode, limit=400_000)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, known = held(("pieces", digest), encoder)
        first = np.array([library.bos_id()] * begin, "<u4").tobytes()
        last = np.array([library.eos_id()] * end, "<u4").tobytes()
        for batch, rows in texts(batches, "text"):
            ids = [first + b"".join(map(known.__getitem__, chunk_keys(t))) + last for t in rows]
            back = [library.decode(unpack_ids(x).tolist()) if decoded else None for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(back, pa.string()),
                ],
                ["id", "n_tokens", "ids", "decoded"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(encode, f"id {kind}, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)


def unpack_ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4")
