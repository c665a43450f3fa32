import hashlib
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import bpe
from tests.llm import data

PATH = bpe.vocabulary_file()
VOCABULARY = bpe.Vocabulary(PATH)
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
AWKWARD = ["", "aaa aaaa aaaaa", "  x  \n\n y\t\t", "a\x1cb \x85 c", "hello<|endoftext|> world <|endoftext|>", "😀 ‍ zz", "x" * 5000, "don't we'll I'M 123abc ½ ² ٣", "　中文 テスト", "a" * 1001 + " " * 30, "\x00\x01"]


def same(texts):
    ids, ends = bpe.Encoder(VOCABULARY).encode(texts)
    decoded = bpe.decode(VOCABULARY, ids, ends)
    for i, t in enumerate(texts):
        expected = LIBRARY.encode(t, add_special_tokens=False).ids
        assert ids[ends[i] : ends[i + 1]].tolist() == expected
        assert decoded[i] == LIBRARY.decode(expected, skip_special_tokens=False) == t


def test_awkward_texts():
    same(AWKWARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    same(texts)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 2)
    encoder = bpe.Encoder(VOCABULARY)
    for t in AWKWARD:
        ids, _ = encoder.encode([t])
        assert ids.tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_bad_bytes_decode_as_replacement():
    ids = VOCABULARY.of_byte[[0xE2, 0x82]]
    assert bpe.decode(VOCABULARY, ids, __import__("numpy").array([0, 2])) == [LIBRARY.decode(ids.tolist(), skip_special_tokens=False)]


def test_documents(spark):
    got = bpe.encode_and_decode(data.frame(spark), PATH).collect()
    expected = []
    for i, t, *_ in data.rows():
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), t or ""))
    assert sorted(((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), r.decoded) for r in got), key=str) == sorted(expected, key=str)
    assert bpe.encode_and_decode(data.empty(spark), PATH).count() == 0


def test_long_words_equal_the_library_in_linear_time():
    import random
    import time

    rng = random.Random(8)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    same([some("abcdefghijklmnopqrstuvwxyz", 20_000), "a" * 9_001, some("ab", 8_000) + " tail " + some("the in", 3_000).replace(" ", ""), some("éaßñ漢z", 6_000), some("-=+", 5_000)])
    start = time.time()
    bpe.Encoder(VOCABULARY).encode([some("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 1_000_000)])
    assert time.time() - start < 15
