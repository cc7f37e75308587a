"""Token ids of whole texts, written as bit-packed files in document order and read back.

Documents are dealt into ranges of their id and sorted inside each, so the files, in the
order of their part number, hold them in ascending id (null ids first, repeated ids by
text). A task streams its rows into one file in a shared folder. The file's name is unique
to the attempt, and only files named by the manifest, which Spark commits, are ever read:
lost or repeated attempts leave files that nobody sees.

A null text is empty; an empty text has the end id alone. Other columns are not read.
"""

from __future__ import annotations

import os
import string
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plotmark.llm.common import Memo, held, ship_file, texts
from plotmark.llm.tokenfile import TokenReader, TokenWriter, width_of
from plotmark.session import materialize, scratch_path

_PUNCTUATION = string.punctuation.encode()
_ALPHANUMERIC = frozenset((string.ascii_letters + string.digits).encode())
# Ids unpacked at a time by a reader.
_READ_IDS = 1 << 20


def _ends_in_letter(word: bytes) -> bool:
    """Whether UTF-8 ends in an ASCII letter or digit, or in a letter of À to ÿ."""
    return word[-1] in _ALPHANUMERIC or word[-2:-1] == b"\xc3" and word[-1] not in (0x97, 0xB7)


class WordEncoder(Memo):
    """Ids of a text by the library, which encodes each distinct word once.

    White space ends every pre-token of this vocabulary and is dropped, and characters do
    not compose across it, so a text's ids are those of its words. ASCII case is folded
    first, and punctuation after a letter or digit is a pre-token of its own; both only
    make words repeat more often. Words with "<|" are left to the library as they are.
    """

    def __init__(self, data: bytes, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode())
        self.width = width_of(self.library.get_vocab_size(with_added_tokens=True))
        super().__init__(self._word, limit)

    def _word(self, word: bytes) -> bytes:
        if b"<|" not in word:
            low = word.lower()
            if low != word:
                return self[low]
            body = word.rstrip(_PUNCTUATION)
            if body != word and body and _ends_in_letter(body):
                return self[body] + self[word[len(body) :]]
        return array("I", self.library.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, text.encode().split()))


def write_tokens(
    df: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Write all texts as token files; returns the manifest (part, file, n_docs, n_tokens, first).

    ``first`` is the number of ids in all earlier files. ``folder`` is a path or URI that
    every executor can write to; by default a new one in the session's shared folder.
    The manifest has one row per file, so numbering the files is not work that grows with rows.
    """
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    digest, model = ship_file(spark, path)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("words", digest), lambda: WordEncoder(model.value))
        store, root = fs.FileSystem.from_uri(folder)
        out = name = None
        for batch, rows in texts(batches, "text"):
            if batch.num_rows and out is None:
                store.create_dir(root, recursive=True)
                part = TaskContext.get().partitionId()
                name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
                out = store.open_output_stream(f"{root}/{name}")
                writer = TokenWriter(out, encoder.width)
            for doc_id, text in zip(batch.column("id").to_pylist(), rows):
                writer.add(doc_id, np.frombuffer(encoder.encode(text) + end, "<u4"))
        if out is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": f"{folder}/{name}", "n_docs": len(writer.counts), "n_tokens": writer.n_tokens}],
                pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    manifest = materialize(dealt.mapInArrow(write, "part int, file string, n_docs long, n_tokens long"), "manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the files of a manifest.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian
    unsigned 32-bit integers. A file is read by one task, a stretch of documents at a time.
    """
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as source:
                    yield from _documents(TokenReader(source, source.size()), first)

    def _documents(reader: TokenReader, first: int) -> Iterator[pa.RecordBatch]:
        low = 0
        while low < reader.n_docs:
            high = int(np.searchsorted(reader.starts, reader.starts[low] + _READ_IDS, "right")) - 1
            high = min(max(high, low + 1), reader.n_docs)
            bounds = reader.starts[low : high + 1]
            data = reader.ids(int(bounds[0]), int(bounds[-1])).tobytes()
            inner = (bounds - bounds[0]) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(reader.doc_ids[low:high], mask=~reader.known[low:high]),
                    pa.array(bounds[:-1] + first),
                    pa.array(np.diff(bounds)),
                    pa.array([data[a:b] for a, b in zip(inner[:-1], inner[1:])], pa.binary()),
                ],
                schema=schema,
            )
            low = high

    # One task per file at most; files are few against rows, so this moves only their names.
    out = manifest.repartition(F.col("part")).mapInArrow(read, "id long, start long, n_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)
