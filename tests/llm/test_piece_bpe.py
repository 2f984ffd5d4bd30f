"""SentencePiece encoding against the library."""

import hashlib
from functools import cache

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from atril.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a ", "\n", "a\n\nb", "▁a", "a▁b", "a ▁▁b ▁", "ﬁ Ａ é", "\x00a", "　x", "<s>", "</s> x", "<0x0A>", "É�", "日本語テスト", "x" * 3000,
       "ab" * 2000, " " * 500, "a_. b², c_( ).", "🎉👨‍👩‍👧 é", "𐀀", "﻿", "don't.stop,now", "word." * 9000]


@cache
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


def same(text):
    tool, ids = piece_bpe.encoder(PATH), library().encode(text, add_eos=True)
    assert tool.encode(text) == ids
    assert tool.encode(text, end=False) == ids[:-1]
    assert tool.decode(ids) == tool.decimal(text)[1] == library().decode(ids)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60), st.text(alphabet="abcdehinorst  \n▁é日<0x>.,'_²(\"🎉\t", max_size=80))
def test_any_text(a, b):
    for text in (a, b, a + " " + b):
        same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdehinorst▁", max_size=60))
def test_cut_of_a_whole_text(text):
    """Without any cut into parts the backtracking gives the merges of the whole text, and is what repeated merging gives."""
    tool = piece_bpe.encoder(PATH)
    assert tool.tokens(text) == tool.pieces.merged(text)


@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(3, 258)), max_size=15))
def test_decode_any_ids(ids):
    assert piece_bpe.encoder(PATH).decode(ids) == library().decode(ids)


def test_going_back():
    """A place where no token fits sends the encoder back, and is not tried again."""
    tool = piece_bpe.Encoder(PATH)
    sure = {("", "aa"): True, ("", "a"): True, ("aa", "a"): False, ("aa", "b"): False, ("a", "aa"): True, ("a", "a"): True}
    tool.pairs = {**sure, ("aa", "aa"): False}
    tool.pieces.longest = type("Longest", (), {"iter": lambda self, text: [(e, "aa") for e in range(1, len(text))]})()
    tool.pieces.shorter = {"aa": "a"}
    assert tool.tokens("aaa") == ["a", "aa"]


def test_table(spark):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "no id"), (77, None)]
    docs = spark.createDataFrame([(i, t, "n", 5, "d") for i, t in rows], "doc_id long, text string, ids string, n_tokens int, decoded string")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library().encode(t or "", add_eos=True)
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(library().decode(ids))))
    got = piece_bpe.encode_decode(docs, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    shown = {(r.doc_id, tuple(r.ids), r.decoded) for r in piece_bpe.encode_decode(docs, PATH, texts=True).collect()}
    assert (3, tuple(library().encode(" a ", add_eos=True)), " a ") in shown
    assert piece_bpe.encode_decode(docs.limit(0), PATH).count() == 0
