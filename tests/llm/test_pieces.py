"""Piece counts, ids and decoded texts equal the library's."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from plotmark.llm import pieces
from plotmark.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_backtracking_equals_merging_and_the_library(library):
    back = pieces.Backtracker(pieces.PieceModel(open(PATH, "rb").read()))
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("abet▁ hñ漢\n\t0<>x😀qu\x00ing") for _ in range(rng.randint(0, 40)))
        ids = b"".join(back.encode(k) for k in pieces.chunk_keys(text))
        assert pieces.unpack_ids(ids).tolist() == library.encode(text)
        for key in pieces.chunk_keys(text):
            assert back.split(pieces.SPACE + key) == back.merge(pieces.SPACE + key)


def test_whole_tokens_are_single(library):
    whole = pieces.whole_tokens(open(PATH, "rb").read())
    assert len(whole) > 10_000
    assert all(len(x) == 1 for x in library.encode(whole))


def test_odd_rows(odd_rows, no_rows, library):
    counts = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in pieces.count_tokens(odd_rows, PATH).collect())
    rows = [(r.doc_id, r.text or "") for r in odd_rows.collect()]
    assert counts == sorted((i or 0, len(t.encode()), len(library.encode(t))) for i, t in rows)
    got = pieces.encode_pieces(odd_rows, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    found = sorted((r.doc_id or 0, pieces.unpack_ids(r.ids).tolist(), r.decoded, r.n_tokens) for r in got.collect())
    want = [(i or 0, [1, *library.encode(t), 2]) for i, t in rows]
    assert found == sorted((i, ids, library.decode(ids), len(ids)) for i, ids in want)
    assert pieces.count_tokens(no_rows, PATH).count() == pieces.encode_pieces(no_rows, PATH).count() == 0


def test_queries(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_token_counts"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
    rows = QUERIES["op8_piece_round_trip"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = [1, *library.encode(texts[r.doc_id]), 2]
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_a_model_with_normalisation_is_refused():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        pieces.PieceModel(proto.SerializeToString())
