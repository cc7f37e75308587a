"""Token files: ids equal the library's, files round-trip, any range can be read."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plotmark.llm import tokenfile, tokens
from plotmark.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_words_equal_the_library(library):
    encoder = tokens.WordEncoder(open(PATH, "rb").read(), limit=50)
    parts = "a B e . , ' 's 'll – … İ Σ ñ ñ 漢 0 ½ \n \t \xa0 \x85 \x1c ﬁ Ω <|endoftext|> <|ENDOFTEXT|> 😀 \x00".split(" ")
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice([*parts, " "]) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(library, text), repr(text)


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 24, 32])
def test_file_round_trip_and_random_access(width):
    rng = np.random.default_rng(width)
    docs = [rng.integers(0, 2**width, n, dtype=np.uint64).astype("<u4") for n in (0, 5, 64, 1000, 0, 63, 1)]
    out = io.BytesIO()
    writer = tokenfile.TokenWriter(out, width, block=64)
    for k, ids in enumerate(docs):
        writer.add(None if k == 2 else -k, ids)
    writer.close()
    reader = tokenfile.TokenReader(out, out.tell())
    flat = np.concatenate(docs)
    assert reader.n_tokens == len(flat) and np.diff(reader.starts).tolist() == [len(d) for d in docs]
    assert reader.known.tolist() == [k != 2 for k in range(7)] and reader.doc_ids[3] == -3
    for a in (0, 1, 63, 64, 65, 700, len(flat)):
        for b in (a, a + 1, a + 64, len(flat)):
            assert (reader.ids(a, min(b, len(flat))) == flat[a:b]).all()


def test_an_id_beyond_the_width_is_refused():
    with pytest.raises(ValueError):
        tokenfile.TokenWriter(io.BytesIO(), 3).add(1, np.array([8], "<u4"))
    assert tokenfile.width_of(49_408) == 16 and tokenfile.width_of(2) == 1 and tokenfile.width_of(1) == 1


def test_odd_rows(odd_rows, no_rows, library):
    got = tokens.read_tokens(tokens.write_tokens(odd_rows, PATH)).orderBy("start").collect()
    rows = sorted(odd_rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    at = 0
    for r, row in zip(got, rows):
        ids = [*ids_of(library, row.text), 1]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)
    assert tokens.read_tokens(tokens.write_tokens(no_rows, PATH)).count() == 0


def test_query(spark, sf, library):
    rows = {r.doc_id: r for r in QUERIES["op1_packed_token_files"](spark, sf).collect()}
    at = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = [*ids_of(library, d.text), 1]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert tuple(rows[d.doc_id]) == (d.doc_id, at, len(ids), crc)
        at += len(ids)
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
