"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks all neighbouring pairs up
by binary search over the sorted pair keys, takes the lowest rank of every word, merges all
places where it stands, and closes the gaps. Words whose pairs have no rank leave the rounds.

A very long word has as many rounds as it has ranks, so its rounds read only what changed: its
symbols are linked, places are listed by rank, and a merge looks up the two pairs beside it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import two_columns
from tessella.plans.session import table

#: How texts are cut into words before merging; fixed by the vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Words whose tokens a worker remembers, and characters of text it takes at once.
MEMORY_WORDS, CHUNK_CHARS = 300_000, 1 << 20
#: Bytes of a word beyond which it is merged by itself, and isn't remembered.
LONG_WORD = 2_000
NO_RANK = np.int64(1 << 40)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabularies of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Arrays for merging and decoding, from a ``tokenizers`` file of byte-level BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids = file["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.of_byte = np.array([ids[letters[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        texts = {i: bytes(back[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        parts = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.token_ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def merge_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after the other, and where each word's begin; the end last."""
    lengths = np.array([len(w) for w in words], np.int64)
    ids = vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    done_ids, done_owner = [], []
    while len(ids):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        key = ids[:-1] << 20 | ids[1:]
        at = np.minimum(np.searchsorted(vocabulary.keys, key), len(vocabulary.keys) - 1)
        known = (vocabulary.keys[at] == key) & (owner[1:] == owner[:-1])
        rank = np.full(len(ids), NO_RANK)
        rank[:-1][known] = vocabulary.ranks[at[known]]
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
        ended = lowest == NO_RANK
        done_ids.append(ids[ended])
        done_owner.append(owner[ended])
        here = np.flatnonzero((rank == lowest) & ~ended)
        if not len(here):
            break
        run_first = np.concatenate([[True], np.diff(here) != 1])  # of aaa, the first two merge
        run_start = here[run_first][np.cumsum(run_first) - 1]
        here = here[(here - run_start) % 2 == 0]
        ids[here] = vocabulary.made[at[here]]
        stay = ~ended
        stay[here + 1] = False
        ids, owner = ids[stay], owner[stay]
    all_ids, all_owner = np.concatenate(done_ids or [ids]), np.concatenate(done_owner or [owner])
    order = np.argsort(all_owner, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(all_owner, minlength=len(words)))])
    return all_ids[order], ends


def merge_long_word(vocabulary: Vocabulary, word: bytes) -> np.ndarray:
    """Token ids of one word, in time that grows with its length and not with its square."""
    n = len(word)
    ids = vocabulary.of_byte[np.frombuffer(word, np.uint8)]
    after, before = np.arange(1, n + 1), np.arange(-1, n)
    rank = np.full(n, NO_RANK)
    made, alive = np.zeros(n, np.int64), np.ones(n, bool)
    places: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def look_up(at: np.ndarray) -> None:
        at = at[at >= 0]
        rank[at] = NO_RANK
        at = at[after[at] < n]
        key = ids[at] << 20 | ids[after[at]]
        found = np.minimum(np.searchsorted(vocabulary.keys, key), len(vocabulary.keys) - 1)
        known = vocabulary.keys[found] == key
        at, found = at[known], found[known]
        rank[at], made[at] = vocabulary.ranks[found], vocabulary.made[found]
        order = np.argsort(rank[at], kind="stable")
        at = at[order]
        first = np.flatnonzero(np.diff(rank[at], prepend=-1))
        for a, b in zip(first, np.append(first, len(at))[1:]):
            r = int(rank[at[a]])
            if r not in places:
                places[r] = []
                heapq.heappush(waiting, r)
            places[r].append(at[a:b])

    look_up(np.arange(n))
    while waiting:
        r = heapq.heappop(waiting)
        here = np.unique(np.concatenate(places.pop(r)))
        here = here[rank[here] == r]
        if not len(here):
            continue
        run_first = np.concatenate([[True], after[here[:-1]] != here[1:]])  # of aaa, the first two merge
        run_start = np.flatnonzero(run_first)[np.cumsum(run_first) - 1]
        here = here[(np.arange(len(here)) - run_start) % 2 == 0]
        gone = after[here]
        ids[here] = made[here]
        rank[gone], alive[gone] = NO_RANK, False
        after[here] = after[gone]
        before[after[here]] = here
        look_up(np.unique(np.concatenate([here, before[here]])))
    return ids[alive]


def spans(ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the chosen spans, one after the other, and the length of each."""
    length = ends[which + 1] - ends[which]
    shift = np.repeat(ends[which] - (np.cumsum(length) - length), length)
    return np.arange(len(shift)) + shift, length


class Encoder:
    """Encodes texts; remembers the tokens of a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.forget()

    def forget(self) -> None:
        self.places = {name: i for i, name in enumerate(self.vocabulary.special)}
        self.ids = np.array(list(self.vocabulary.special.values()), np.int64)
        self.ends = np.arange(len(self.places) + 1)

    def words(self, text: str) -> list[str]:
        if self.special and any(name in text for name in self.vocabulary.special):
            return [w for part in self.special.split(text) for w in ([part] if part in self.vocabulary.special else WORDS.findall(part))]
        return WORDS.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin; the end last."""
        cut = [self.words(t) for t in texts]
        if len(self.places) > MEMORY_WORDS:
            self.forget()
        long = {w for words in cut for w in words if len(w) > LONG_WORD}
        new = [w for w in dict.fromkeys(w for words in cut for w in words) if w not in self.places and w not in long]
        if new:
            ids, ends = merge_words(self.vocabulary, [w.encode("utf-8") for w in new])
            self.ends = np.concatenate([self.ends, ends[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        places, known, known_ends = self.places, self.ids, self.ends
        if long:  # for these texts only
            merged = [merge_long_word(self.vocabulary, w.encode("utf-8")) for w in long]
            places = places | dict(zip(long, range(len(places), len(places) + len(long))))
            known_ends = np.concatenate([known_ends, len(known) + np.cumsum([len(m) for m in merged])])
            known = np.concatenate([known, *merged])
        which = np.fromiter((places[w] for words in cut for w in words), np.int64)
        at, length = spans(known_ends, which)
        word_ends = np.concatenate([[0], np.cumsum([len(w) for w in cut])]).astype(np.int64)
        return known[at], np.concatenate([[0], np.cumsum(length)])[word_ends]


def decode(vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """The text of each stretch of ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
    ids = np.where(ids < len(vocabulary.token_ends) - 1, ids, len(vocabulary.token_ends) - 1)
    at, length = spans(np.append(vocabulary.token_ends, vocabulary.token_ends[-1]), ids)
    data = vocabulary.token_bytes[at].tobytes()
    where = np.concatenate([[0], np.cumsum(length)])[ends]
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(where[:-1], where[1:])]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _coded(vocabulary_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary_of.value)
        for batch in batches:
            ids_of, texts_of = [], []
            for part in _chunks([t or "" for t in batch.column("text").to_pylist()]):
                ids, ends = encoder.encode(part)
                packed = ids.astype("<u4").tobytes()
                ids_of += [packed[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:])]
                texts_of += decode(encoder.vocabulary, ids, ends)
            if ids_of:
                n = pa.array([len(x) // 4 for x in ids_of], pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": n, "ids": pa.array(ids_of, pa.binary()), "decoded": pa.array(texts_of, pa.string())})

    return run


def encode_and_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text, and the text that they decode to.

    Returns ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers) and ``decoded``.
    The driver reads the vocabulary once and broadcasts its tables, whose size is that of the
    vocabulary. A special token that stands in a text is encoded as that token.

    A null or empty text has no tokens and decodes to the empty text. Rows that repeat an id,
    and null ids, pass through as they are. An empty table gives an empty result.
    """
    rows = two_columns(docs, id_col, text_col)
    vocabulary_of = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))
    return rows.mapInArrow(_coded(vocabulary_of), "doc_id long, n_tokens long, ids binary, decoded string")


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the box keeps a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """Digests of the ids, and of the text decoded from them, of every document."""
    coded = encode_and_decode(table(spark, sf_dir, "documents"), vocabulary_path or vocabulary_file())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
