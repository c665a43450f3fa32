"""SentencePiece encoding and decoding for vocabularies of the merge type.

A text's characters are symbols; neighbouring pairs whose joined string is a piece wait on an
agenda, ordered by the piece's score and then by place. The best pair is merged, and the two new
pairs beside it join the agenda in place of those that it ended. What no piece covers falls back
to the pieces of its bytes.

Merges can't cross a place where no piece has those two characters side by side. In vocabularies
whose pieces hold the space mark at their beginning only, texts are cut there, before each
stretch of spaces, and a worker remembers the ids of such words. The agendas of many new words
lie in one flat array and are popped in step, one pair of each word a round; a long word has a
heap of its own.

In each Arrow batch the sentencepiece library encodes and decodes the words that are new to the
worker too, and is compared with. As no merge leaves a word, a text agrees if all its words do.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import spans, vocabulary_file
from tessella.llm.common import two_columns
from tessella.plans.session import table

#: What stands for a space in pieces; fixed by the format.
SPACE = "▁"
#: Kinds of pieces in a model file; fixed by the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model type that is merged by scores; fixed by the format.
MERGES = 2
#: Words whose ids a worker remembers, characters of the longest one, and characters of text
#: that are taken at once.
MEMORY_WORDS, MEMORY_CHARS, CHUNK_CHARS = 300_000, 64, 1 << 20
#: The rank of pairs that make no piece.
NO_RANK = 1 << 24


def _byte_by_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("tessella.byte_by_byte", _byte_by_byte)


class Pieces:
    """What encoding and decoding need of a model file."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as format

        file = format.ModelProto()
        file.ParseFromString(model)
        kinds = [p.type for p in file.pieces]
        if file.trainer_spec.model_type != MERGES:
            raise ValueError("the vocabulary isn't of the merge type")
        if {USER_DEFINED, UNUSED} & set(kinds) or not file.trainer_spec.byte_fallback or kinds.count(BYTE) != 256:
            raise ValueError("user-defined and unused pieces, and vocabularies without all bytes, aren't supported")
        normal = file.normalizer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or file.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only texts that aren't normalised, with marks before words, are supported")
        self.model = model
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(file.pieces) if p.type == NORMAL}
        # Equal scores share a rank: then the place decides.
        order = {s: r for r, s in enumerate(sorted({p.score for p in file.pieces if p.type == NORMAL}, reverse=True))}
        self.ranks = {p.piece: order[p.score] for p in file.pieces if p.type == NORMAL}
        self.of_byte = [0] * 256
        for i, p in enumerate(file.pieces):
            if p.type == BYTE:
                self.of_byte[int(p.piece[3:5], 16)] = i
        self._list_pairs()
        inner = {p.lstrip(SPACE) for p in self.ids}
        self.cuts = not any(SPACE in p for p in inner)

        def said(p) -> bytes:
            if p.type == BYTE:
                return bytes([int(p.piece[3:5], 16)])
            return {UNKNOWN: file.trainer_spec.unk_surface, CONTROL: ""}.get(p.type, p.piece.replace(SPACE, " ")).encode()

        parts = [said(p) for p in file.pieces]
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.marked = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in file.pieces])
        self.silent = np.array([p.type == CONTROL for p in file.pieces])

    def _list_pairs(self) -> None:
        """Sorted keys of two symbols that join to a piece, with its rank and symbol.

        Symbols are the pieces, and the characters that only stand inside of pieces.
        """
        chars = sorted({c for p in self.ids for c in p} - set(self.ids))
        self.symbols = {p: i for i, p in enumerate([*self.ids, *chars])}
        self.id_of_symbol = np.array([*self.ids.values(), *[-1] * len(chars)], np.int64)
        find = self.symbols.get
        pairs = [(a << 20 | b, self.ranks[p], i) for p, i in self.symbols.items() if p in self.ids for k in range(1, len(p)) if (a := find(p[:k])) is not None and (b := find(p[k:])) is not None]
        self.keys, self.key_rank, self.key_made = np.array(sorted(pairs), np.int64).T.copy()


def merge(pieces: Pieces, word: str) -> list[int]:
    """Ids of a stretch of text, by the agenda."""
    symbols: list[str | None] = list(word)
    n = len(symbols)
    ranks = pieces.ranks
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = []
    for i in range(n - 1):
        rank = ranks.get(symbols[i] + symbols[i + 1])
        if rank is not None:
            agenda.append((rank, i, 2))
    heapq.heapify(agenda)
    while agenda:
        _, left, size = heapq.heappop(agenda)
        a = symbols[left]
        right = after[left]
        if a is None or right >= n or len(a) + len(symbols[right]) != size:
            continue
        a += symbols[right]
        symbols[left], symbols[right] = a, None
        beyond = after[left] = after[right]
        if beyond < n:
            before[beyond] = left
            rank = ranks.get(a + symbols[beyond])
            if rank is not None:
                heapq.heappush(agenda, (rank, left, size + len(symbols[beyond])))
        ahead = before[left]
        if ahead >= 0:
            rank = ranks.get(symbols[ahead] + a)
            if rank is not None:
                heapq.heappush(agenda, (rank, ahead, size + len(symbols[ahead])))
    out: list[int] = []
    for s in symbols:
        if s is not None:
            known = pieces.ids.get(s)
            if known is None:
                out += [pieces.of_byte[b] for b in s.encode("utf-8")]
            else:
                out.append(known)
    return out


def merge_many(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and where each word's begin; the end last."""
    text = "".join(words)
    lengths = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    # A character that no piece holds is itself, as a negative number, and joins with nothing.
    codes, which = np.unique(code, return_inverse=True)
    symbol = np.array([pieces.symbols.get(chr(c), -c - 1) for c in codes], np.int64)[which]
    owner = np.repeat(np.arange(len(words)), lengths)

    def ranked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the pair at each place, and what it makes."""
        joined = (at + 1 < len(symbol)) & (at >= 0)
        next_to = np.minimum(at + 1, len(symbol) - 1)
        key = symbol[at] << 20 | symbol[next_to]
        found = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
        known = joined & (pieces.keys[found] == key) & (owner[at] == owner[next_to]) & (symbol[at] >= 0) & (symbol[next_to] >= 0)
        return np.where(known, pieces.key_rank[found], NO_RANK), np.where(known, pieces.key_made[found], -1)

    rank, made = ranked(np.arange(len(symbol)))
    done_symbol, done_owner = [], []
    while len(symbol):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.minimum.reduceat(rank << 32 | np.arange(len(symbol)), first)
        more = best >> 32 < NO_RANK
        ended = np.repeat(~more, np.diff(np.append(first, len(symbol))))
        done_symbol.append(symbol[ended])
        done_owner.append(owner[ended])
        at = best[more] & 0xFFFFFFFF
        if not len(at):
            break
        symbol[at] = made[at]
        stay = ~ended
        stay[at + 1] = False
        at = np.cumsum(stay)[at] - 1
        symbol, owner, rank, made = symbol[stay], owner[stay], rank[stay], made[stay]
        beside = np.concatenate([at, at[at > 0] - 1])
        rank[beside], made[beside] = ranked(beside)
    symbol, owner = np.concatenate(done_symbol or [symbol]), np.concatenate(done_owner or [owner])
    order = np.argsort(owner, kind="stable")
    symbol, owner = symbol[order], owner[order]
    ids = np.where(symbol >= 0, pieces.id_of_symbol[np.maximum(symbol, 0)], -1)
    alone = np.flatnonzero(ids < 0)
    if len(alone):  # characters without a piece become bytes
        names = {i: c for c, i in pieces.symbols.items() if len(c) == 1}
        spelled = [(names[s] if s >= 0 else chr(-s - 1)).encode("utf-8") for s in symbol[alone].tolist()]
        times = np.ones(len(ids), np.int64)
        times[alone] = [len(b) for b in spelled]
        ids, owner = np.repeat(ids, times), np.repeat(owner, times)
        ids[ids < 0] = np.array(pieces.of_byte)[np.frombuffer(b"".join(spelled), np.uint8)]
    return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(np.int64)


class PieceEncoder:
    """Encodes texts; remembers the ids of a bounded number of words."""

    WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def __init__(self, pieces: Pieces, library=None) -> None:
        self.pieces, self.library = pieces, library
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.ids = np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)
        self.agreed = np.zeros(0, bool)

    def agreeing(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the library makes the same of each word, which begins with the prefix.

        It gets the words as one text first, as merges don't leave words, and one by one if
        anything differs then.
        """
        if self.library is None:
            return np.ones(len(words), bool)
        prefix = self.pieces.prefix
        if self.pieces.cuts and prefix:
            theirs = self.library.encode("".join(words).removeprefix(prefix).replace(SPACE, " "))
            if np.array_equal(ids, theirs) and decode(self.pieces, ids, np.array([0, len(ids)]))[0] == self.library.decode(theirs):
                return np.ones(len(words), bool)
        plain = [w.removeprefix(prefix).replace(SPACE, " ") for w in words]
        theirs = self.library.encode(plain, num_threads=1)
        texts = self.library.decode(theirs, num_threads=1)
        ours = [ids[a:b].tolist() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        told = decode(self.pieces, ids, ends)
        # The library puts no mark before an empty text: the mark alone is looked up.
        return np.array([o == t and a == b if p else o == [self.library.piece_to_id(prefix)] for o, t, a, b, p in zip(ours, theirs, told, texts, plain)], bool)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, where each text's begin, the end last, and
        whether the library, if there is one, agrees on all words of each text."""
        marked = [self.pieces.prefix + t.replace(" ", SPACE) if t else "" for t in texts]
        cut = [self.WORDS.findall(t) if self.pieces.cuts else [t] if t else [] for t in marked]
        flat = list(chain.from_iterable(cut))
        if len(self.places) > MEMORY_WORDS:
            self.forget()
        new = set(flat).difference(self.places)
        unknown = [w for w in new if len(w) <= MEMORY_CHARS]
        kept = len(unknown)
        if kept < len(new):  # long ones last, for these texts only
            unknown += [w for w in new if len(w) > MEMORY_CHARS]
        places = self.places
        start, known, ends, agreed = len(places), self.ids, self.ends, self.agreed
        if unknown:
            new, new_ends = merge_many(self.pieces, unknown[:kept])
            long = [merge(self.pieces, w) for w in unknown[kept:]]
            new_ends = np.concatenate([new_ends, new_ends[-1] + np.cumsum([len(m) for m in long], dtype=np.int64)])
            new = np.concatenate([new, np.array([i for m in long for i in m], np.int64)])
            agreed = np.concatenate([agreed, self.agreeing(unknown, new, new_ends)])
            ends = np.concatenate([ends, len(known) + new_ends[1:]])
            known = np.concatenate([known, new])
            self.places.update(zip(unknown[:kept], range(start, start + kept)))
            self.ids, self.ends, self.agreed = known[: ends[start + kept]], ends[: start + kept + 1], agreed[: start + kept]
            if kept < len(unknown):
                places = places | dict(zip(unknown[kept:], range(start + kept, start + len(unknown))))
        which = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
        at, length = spans(ends, which)
        word_ends = np.concatenate([[0], np.cumsum([len(w) for w in cut])]).astype(np.int64)
        doubts = np.concatenate([[0], np.cumsum(~agreed[which])])[word_ends]
        return known[at], np.concatenate([[0], np.cumsum(length)])[word_ends], np.diff(doubts) == 0


def decode(pieces: Pieces, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """The text of each stretch of ids, without the mark that was put before the first word.

    Each byte that isn't of valid UTF-8 becomes U+FFFD.
    """
    at, length = spans(pieces.ends, ids)
    data = pieces.bytes[at].tobytes()
    where = np.concatenate([[0], np.cumsum(length)])
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        # Control pieces say nothing, and part the bytes beside them.
        parts = np.append(a + np.flatnonzero(pieces.silent[ids[a:b]]), b).tolist()
        said, begun = [], False
        for e in parts:
            skip = 1 if not begun and pieces.prefix and a < e and pieces.marked[ids[a]] else 0
            begun = begun or a < e
            said.append(data[where[a] + skip : where[e]].decode("utf-8", "tessella.byte_by_byte"))
            a = e + 1
        out.append("".join(said))
    return out


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


def _coded(pieces_of, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = None
        if check:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_proto=pieces_of.value.model)
        encoder = PieceEncoder(pieces_of.value, library)
        for batch in batches:
            ids_of, texts_of, agrees = [], [], []
            for part in _chunks([t or "" for t in batch.column("text").to_pylist()]):
                ids, ends, same = encoder.encode(part)
                packed = ids.astype("<u4").tobytes()
                ids_of += [packed[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:])]
                texts_of += decode(encoder.pieces, ids, ends)
                agrees += same.tolist() if check else [None] * len(part)
            if ids_of:
                columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids_of], pa.int64()), "ids": pa.array(ids_of, pa.binary())}
                yield pa.RecordBatch.from_pydict(columns | {"decoded": pa.array(texts_of, pa.string()), "agrees": pa.array(agrees, pa.bool_())})

    return run


def encode_and_decode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """Ids of every whole text, without begin and end, and the text that they decode to.

    Returns ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers), ``decoded`` and
    ``agrees``: with ``check``, whether the library makes the same of all its words, else null. The
    driver reads the model once and broadcasts its tables, whose size is that of the model.

    A null or empty text has no ids and decodes to the empty text. Rows that repeat an id, and
    null ids, pass through as they are; other columns are ignored. An empty table gives an empty
    result. Very long texts, and words without a space, take time that grows as n log n.
    """
    rows = two_columns(docs, id_col, text_col)
    with open(model_path, "rb") as f:
        pieces_of = docs.sparkSession.sparkContext.broadcast(Pieces(f.read()))
    return rows.mapInArrow(_coded(pieces_of, check), "doc_id long, n_tokens long, ids binary, decoded string, agrees boolean")


def _listed(ids):
    """Packed ids as decimal numbers with commas between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [",".join(map(str, np.frombuffer(b, "<u4").tolist())) for b in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names if c != ids} | {"listed": pa.array(lists, pa.string())})

    return run


def op12_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Digests of the ids, and of the text decoded from them, of every document.

    ``agrees`` says whether the sentencepiece library makes the same of all words of a document.
    """
    coded = encode_and_decode_pieces(table(spark, sf_dir, "documents"), model_path or vocabulary_file("piece_bpe_32k.model"), check=True)
    listed = coded.mapInArrow(_listed("ids"), "doc_id long, n_tokens long, decoded string, agrees boolean, listed string")
    return listed.select("doc_id", "n_tokens", F.sha2("listed", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees")
