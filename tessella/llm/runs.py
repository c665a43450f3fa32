"""Periodic runs of words: seeds on diagonals, extended both ways.

A run of period q and length at least max(24, 3q) is a match of the text with itself, shifted by
the lag q, of at least max(24 - q, 2q) words: 16 for any q up to 15, 2^b words for q from
2^(b-1) to 2^b - 1 beyond. These are the guaranteed overlaps. For each, the k-grams of a
document are indexed, and the pairs of an occurrence with the next one in the same document are
seeds, of the lag between them. A k-gram is longer than the lags of its band, so inside a run
its next occurrence is one smallest period on (nearer ones would give the run a smaller period,
by the theorem of Fine and Wilf): no other pairs are needed, and the seeds of a band are no more
than its words.

Seeds of a lag are taken from left to right. A table holds how far each lag is covered; a seed
that is covered is dropped, another one is extended to the left and right along its diagonal
while the words agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import SPACE_CLASS, SPACES, raw_texts, two_columns
from tessella.plans.session import table

#: Least words of a run, and how many periods it has at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the shortest guaranteed overlap, and the longest lag that it serves.
SHORTEST, SERVES = 16, 15
#: Bytes of texts that are searched at once for documents that repeat anything.
CHUNK_BYTES = 4 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def repeating(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Owners that may hold one sequence of ``SHORTEST`` words twice; those that do, for certain.

    ``words`` are numbers of the words of many texts, one after the other.
    """
    h, k = _mixed(words.astype(np.uint64) + np.uint64(1)), 1
    while k < SHORTEST:
        h = _mixed(h[: max(len(h) - k, 0)] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
        k *= 2
    own = owner[: len(h)]
    whole = own == owner[SHORTEST - 1 :][: len(h)]
    h, own = h[whole], own[whole]
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    return np.unique(own[1:][(h[1:] == h[:-1]) & (own[1:] == own[:-1])])


def _longer(names: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the sequences of 2k words, from those of k."""
    left = names[: max(len(names) - k, 0)].astype(np.int64)
    return np.unique(left * (len(names) + 1) + names[k:], return_inverse=True)[1]


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of a text, by start, then period."""
    n = len(words)
    names = np.unique(words, return_inverse=True)[1]
    k = 1
    while k < SHORTEST:
        names, k = _longer(names, k), 2 * k
    found = []
    low, high = 1, SERVES
    while len(names) > 1 and low * LEAST_PERIODS <= n:
        order = np.argsort(names, kind="stable")
        lag = np.diff(order)
        seeds = (names[order[1:]] == names[order[:-1]]) & (lag >= low) & (lag <= high)
        if seeds.any():
            at, lag = order[:-1][seeds], lag[seeds]
            left_to_right = np.argsort(at, kind="stable")
            found += _extended(words, at[left_to_right], lag[left_to_right])
        names, k = _longer(names, k), 2 * k
        low, high = high + 1, 2 * high + 1
    return sorted(found)


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of two arrays agree, read in stretches that double."""
    n, done, step = min(len(a), len(b)), 0, 32
    while done < n:
        differ = a[done : min(done + step, n)] != b[done : min(done + step, n)]
        if differ.any():
            return done + int(differ.argmax())
        done += step
        step *= 2
    return n


def _extended(words: np.ndarray, at: np.ndarray, lag: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs along the diagonals of seeds."""
    found = []
    covered: dict[int, int] = {}
    for i, q in zip(at.tolist(), lag.tolist()):
        if i < covered.get(q, 0):
            continue
        start = i - _agreeing(words[:i][::-1], words[: i + q][::-1])
        end = covered[q] = i + _agreeing(words[i:], words[i + q :])
        length = end + q - start
        if length >= max(LEAST_WORDS, LEAST_PERIODS * q):
            found.append((start, length, q))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run repeats: of each run only the first period stays, if no other takes it."""
    stay = np.ones(len(words), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(stay)]


def _searched(texts: list[bytes]) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Number of words, runs and collapsed text of each text."""
    cut = [t.split() for t in texts]
    flat = [w for words in cut for w in words]
    numbers = pd.factorize(np.array(flat, object))[0] if flat else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(cut)), [len(w) for w in cut])
    ends = np.concatenate([[0], np.cumsum([len(w) for w in cut])]).astype(np.int64)
    runs = {int(d): runs_of(numbers[ends[d] : ends[d + 1]]) for d in repeating(numbers, owner)}
    return [(len(w), r := runs.get(d, []), b" ".join(collapse(w, r) if r else w)) for d, w in enumerate(cut)]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        texts, done, part, size = raw_texts(batch.column("text")), [], [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= CHUNK_BYTES:
                done += _searched(part)
                part, size = [], 0
        done += _searched(part)
        if done:
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r, _ in done]
            rest = {"n_words": pa.array([n for n, _, _ in done], pa.int64()), "runs": pa.array(runs, kind), "collapsed": pa.array([c for _, _, c in done], pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | rest)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every run of a whole text, and the text without what runs repeat.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with smallest
    period q, at least ``max(24, 3q)`` long, that no neighbouring word extends. Returns ``doc_id,
    n_words, runs`` (an array of ``start, length, period``, by start, then period) and
    ``collapsed``: the words that no run contains after its first q, joined by one space.

    A null or empty text has no words, no runs, and the empty text. Rows that repeat an id, and
    null ids, are searched one by one; other columns are ignored. An empty table gives an empty
    result. Time grows as n log n with the length of a text, whatever repeats in it.
    """
    rows = two_columns(docs, id_col, text_col)
    return rows.mapInArrow(_found, "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text with the words of some documents repeated, as the contract of op13 has it."""
    clean = F.btrim(text, F.lit(SPACES))
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def repeated(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))

    # The words stand in an array of one list, so that the inner lambda splits them once.
    words = F.transform(F.array(F.split(clean, SPACE_CLASS + "+")), lambda w: F.array_join(repeated(w), " "))[0]
    return F.when((h % 10 == 0) & (clean != ""), words).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document: the one of greatest exponent, and digests of all."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(docs["doc_id"], docs["text"]).alias("text")))
    # Runs come by start, then period: of equal exponents the first stays.
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", nothing, lambda b, r: F.when(better(b, r), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    told = found.withColumn("best", best)
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: The crc of the id goes nibble by nibble through the 16 entries of the reflected polynomial's
#: table (fixed values). Matches of 16 words at a lag, grouped into stretches; of stretches that
#: cover each other only the smallest period stays.
OP13_SQL = r"""
WITH hashed AS (
  SELECT doc_id, row_number() OVER () AS r, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text,
         [instr('0123456789ABCDEF', c) - 1 FOR c IN string_split(hex(encode(CAST(doc_id AS VARCHAR))), '')] AS n
  FROM documents
), crcs AS (
  SELECT doc_id, r, CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(text, '[\x20\x09-\x0D]+') END AS w,
         xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), [CAST(n[(i - 1) // 2 * 2 + 2 - (i - 1) % 2] AS BIGINT) FOR i IN range(1, len(n) + 1)]),
           lambda c, x: xor([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
                       3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108
                      ][CAST((xor(c, x) & 15) + 1 AS BIGINT)], c >> 4)), 4294967295) AS h
  FROM hashed
), planned AS (
  SELECT doc_id, r, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g,
         CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM crcs
), words AS (
  SELECT doc_id, r, n, CASE WHEN planted THEN [w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1] FOR i IN range(n)] ELSE w END AS w
  FROM planned
), grams AS (
  SELECT r, i, array_to_string(w[i + 1 : i + 16], ' ') AS gram
  FROM (SELECT r, w, unnest(range(n - 15)) AS i FROM words WHERE n > 16) t
), pairs AS (
  SELECT a.r, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.gram = b.gram AND a.i < b.i
), islands AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + 15 + q AS length FROM islands GROUP BY r, q, island
), long_ones AS (
  SELECT * FROM stretches WHERE length >= greatest(24, 3 * q)
), runs AS (
  SELECT r, start, length, q AS period FROM long_ones x
  WHERE NOT EXISTS (SELECT 1 FROM long_ones y WHERE y.r = x.r AND y.q < x.q AND y.start <= x.start AND y.start + y.length >= x.start + x.length)
), told AS (
  SELECT r, count(*) AS n_runs,
         arg_max(struct_pack(start := start, length := length, period := period), struct_pack(e := length / CAST(period AS DOUBLE), s := -start, p := -period)) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY r
), dropped AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), gone AS (
  SELECT r, list(i) AS gone FROM dropped GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length,
       CAST(best.period AS BIGINT) AS period, CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string([w[i + 1] FOR i IN range(n) IF NOT list_contains(gone, i)], ' ') END) AS collapsed_sha256
FROM words LEFT JOIN told USING (r) LEFT JOIN gone USING (r)
"""
