import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from tessella.llm import pieces
from tessella.llm.bpe import vocabulary_file
from tests.llm import data

PATH = vocabulary_file("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()
PIECES = pieces.Pieces(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
AWKWARD = ["", " ", "  ", "a ", " a", "▁", "a▁b", "▁▁ x", "<s> hi </s> <unk> <0x41>", "x" * 5000, " " * 301, "line\n\n two\t\r\n", "漢字梦\x00テ", "\U0001f600\U0010ffff", "1234567890", "don't we'll", "word" * 40]


def same(texts):
    ids, ends, agreed = pieces.PieceEncoder(PIECES, LIBRARY).encode(texts)
    told = pieces.decode(PIECES, ids, ends)
    assert agreed.all()
    for i, t in enumerate(texts):
        expected = LIBRARY.encode(t)
        assert ids[ends[i] : ends[i + 1]].tolist() == expected
        assert told[i] == LIBRARY.decode(expected)


def test_awkward_texts():
    same(AWKWARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    same(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2), st.integers(3, 258), st.integers(0, 31_999)), max_size=12))
def test_any_ids_decode_as_by_the_library(ids):
    assert pieces.decode(PIECES, np.array(ids, np.int64), np.array([0, len(ids)])) == [LIBRARY.decode(ids)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("▁abcdehinorst一梦é\U0001f600\n", min_size=1, max_size=40), min_size=1, max_size=6))
def test_agendas_in_step_equal_heaps(words):
    ids, ends = pieces.merge_many(PIECES, words)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [pieces.merge(PIECES, w) for w in words]


def test_equal_scores_go_by_place():
    """Of pieces with one score the first place is merged first, and a better pair that this makes goes before the rest."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(MODEL)
    made = sentencepiece_model_pb2.ModelProto()
    made.CopyFrom(model)
    del made.pieces[:]
    made.pieces.extend([*model.pieces[:259]])
    for piece, score in (("ab", -5.0), ("bc", -5.0), ("abb", -1.0), ("▁", -9.0), ("a", -9.0), ("b", -9.0), ("c", -9.0)):
        made.pieces.add(piece=piece, score=score, type=pieces.NORMAL)
    raw = made.SerializeToString()
    ours, library = pieces.Pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in ("abc", "abbc", "ababbc", "bcabc", "abbabab", "cabbbcab"):
        ids, ends, agreed = pieces.PieceEncoder(ours, library).encode([text])
        assert ids.tolist() == library.encode(text) == pieces.merge(ours, "▁" + text) and agreed.all()


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_WORDS", 2)
    monkeypatch.setattr(pieces, "MEMORY_CHARS", 5)
    encoder = pieces.PieceEncoder(PIECES)
    for _ in range(3):
        for t in AWKWARD:
            assert encoder.encode([t])[0].tolist() == LIBRARY.encode(t)


def test_a_word_of_which_the_library_makes_another_thing_is_told():
    class Other:
        encode = staticmethod(lambda words, **_: [[5] if w == "hello" else LIBRARY.encode(w) for w in words])
        decode = staticmethod(lambda ids, **_: [LIBRARY.decode(i) for i in ids])
        piece_to_id = staticmethod(LIBRARY.piece_to_id)

    assert pieces.PieceEncoder(PIECES, Other).encode(["good day", "oh hello you", "", "bye"])[2].tolist() == [True, False, True, True]


def test_other_vocabularies_are_refused():
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(MODEL)
    model.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        pieces.Pieces(model.SerializeToString())


def test_frame(spark):
    frame = data.frame(spark)
    got = pieces.encode_and_decode_pieces(frame, PATH, check=True).collect()
    of = lambda t: LIBRARY.encode(t or "")
    expected = [(i, len(of(t)), np.array(of(t), "<u4").tobytes(), LIBRARY.decode(of(t)), True) for i, t, *_ in data.rows()]
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded, r.agrees) for r in got), key=str) == sorted(expected, key=str)
    assert pieces.encode_and_decode_pieces(data.empty(spark), PATH).count() == 0


def test_query(spark, tmp_path):
    data.frame(spark).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in pieces.op12_sentencepiece(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {(i, sha(",".join(map(str, LIBRARY.encode(t or "")))), sha(LIBRARY.decode(LIBRARY.encode(t or "")))) for i, t, *_ in data.rows()}
