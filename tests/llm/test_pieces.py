import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm.pieces import PieceCodec, encode_documents, read_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(*read_pieces(MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab the ing\n\t▁é😀1中", max_size=80)))
def test_same_as_the_library(codec, library, text):
    ids = library.encode(text, add_eos=True)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == library.decode(ids)
    n, ids_sha, back_sha = codec.digest(text)
    assert n == len(ids)
    assert ids_sha == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert back_sha == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_border_rule_is_merging(codec, library):
    texts = ["".join(chr(97 + (i * i + k) % 26) for i in range(60)) for k in range(40)]
    for text in texts:
        codec.encode(text)
    assert codec.fits
    for key, known in codec.fits.items():
        left, right = codec.text[key >> 24], codec.text[key & 0xFFFFFF]
        assert known == (codec._merged(left + right) == [left, right])


def test_nulls_empty_long_and_repeated_rows(spark, library):
    long = "the theing " * 30_000 + "x" * 20_000
    rows = [(1, None, "a"), (2, "", "b"), (None, "a  b", "c"), (4, long, None), (4, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sorted(encode_documents(docs, MODEL).collect(), key=str)
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert [tuple(r) for r in out] == sorted(want, key=lambda w: str(w).replace("(", "Row(", 1)) or sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert encode_documents(docs.limit(0), MODEL).count() == 0


def test_ids_and_decoded_text(spark):
    docs = spark.createDataFrame([(1, "a b▁c")], "doc_id long, text string")
    assert encode_documents(docs, MODEL, with_ids=True).first()["decoded"] == "a b c"
