"""Line dedup with two Bloom filters: hashes seen once, and hashes seen twice.

Lines are hashed where they are read, and only the hashes travel: in packed blocks, dealt by
their leading bits into cells, and sorted by cell. The task that has a cell sets each hash in
the cell's filter of once-seen hashes; one that was there already is set in the filter of
twice-seen hashes and reported. The filter of twice-seen hashes tells which can't have been
reported yet; one that it may hold is looked up among the reported ones, so that none is missed
because others have set its bits. The filters never leave their task and go when their cell
ends; their size follows from a count of all lines, so they are no fuller on a large input than
on a small one. A line in two documents is reported for certain, so only lines whose hash is
among the reported suspects are shuffled as texts, to be counted exactly and to find the
document that keeps each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, LOWER, SPACES, UPPER, raw_texts, two_columns
from tessella.plans.session import cut, table, written

#: Lines that a cell is made for, and the most cells: beyond 10^10 lines cells grow instead.
CELL_LINES, MOST_CELLS = 1 << 20, 1 << 14
#: Bits of each filter for a line, and how many of them a hash sets: one line in 400 that
#: stands once is taken for a suspect.
LINE_BITS, PROBES = 16, 4
#: Hashes and keys up to which lists are broadcast to the tasks that read texts.
BROADCAST_HASHES = BROADCAST_BYTES // 8
MIN_CHARS, MIN_DOCS = 20, 3


def line_keys(text: bytes, min_chars: int) -> set[bytes]:
    """Keys of the lines of a text that are long enough: stripped, A-Z in lower case."""
    if len(text) < min_chars:
        return set()
    keys = {k for line in text.lower().split(b"\n") if len(k := line.strip()) >= min_chars}
    return {k for k in keys if len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars}


def hashed(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


class Filters:
    """The filters of one cell, and the hashes that were reported."""

    def __init__(self, lines: int) -> None:
        bits = 1 << max(10, int(lines * LINE_BITS - 1).bit_length())
        self.once, self.twice, self.mask = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8), np.uint64(bits - 1)
        self.said, self.lately = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # both sorted

    def _at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = (hashes >> np.uint64(20)) | np.uint64(1)
        bits = np.stack([(hashes + step * np.uint64(i)) & self.mask for i in range(PROBES)], axis=1).astype(np.int64)
        return bits >> 3, np.left_shift(1, bits & 7).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Sets hashes; returns those that are now seen twice and weren't reported before."""
        values, counts = np.unique(hashes, return_counts=True)
        at, bit = self._at(values)
        again = np.flatnonzero((self.once[at] & bit).astype(bool).all(axis=1) | (counts > 1))
        maybe = (self.twice[at[again]] & bit[again]).astype(bool).all(axis=1)
        known = np.zeros(len(again), bool)
        known[maybe] = among(self.said, values[again[maybe]]) | among(self.lately, values[again[maybe]])
        new = again[~known]
        np.bitwise_or.at(self.once, at, bit)
        np.bitwise_or.at(self.twice, at[new], bit[new])
        self.lately = np.union1d(self.lately, values[new])
        if len(self.lately) > max(1024, len(self.said) >> 2):
            self.said, self.lately = np.union1d(self.said, self.lately), self.lately[:0]
        return values[new]


def among(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a sorted array holds."""
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def _dealt(cells: int, min_chars: int):
    """Packed hashes by cell. A hash that stands twice in a batch is sent twice, not more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.array([hashed(k) for t in raw_texts(batch.column("text")) for k in line_keys(t, min_chars)], np.uint64)
            values, counts = np.unique(hashes, return_counts=True)
            values = np.sort(np.concatenate([values, values[counts > 1]]))
            cell = (values >> np.uint64(64 - MOST_CELLS.bit_length() + 1)).astype(np.int64) * cells // MOST_CELLS
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else []
            ends = np.append(first, len(cell))[1:]
            if len(cell):
                blocks = [values[a:b].astype("<u8").tobytes() for a, b in zip(first, ends)]
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cell[first], pa.int32()), "hashes": pa.array(blocks, pa.binary())})

    return run


def _twice_seen(lines_of_cell: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, filters = None, None
        for batch in batches:
            found = []
            for cell, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if cell != at:
                    at, filters = cell, Filters(lines_of_cell)
                found.append(filters.add(np.frombuffer(block, "<u8")))
            if found:
                yield pa.RecordBatch.from_pydict({"hash": pa.array(np.concatenate(found).astype(np.int64), pa.int64())})

    return run


def suspect_hashes(rows: DataFrame, min_chars: int) -> DataFrame:
    """``hash`` of every line that two documents hold, and of a few others; each once."""
    text = F.coalesce("text", F.lit(""))
    lines = rows.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    cells = min(MOST_CELLS, max(1, -(-lines // CELL_LINES)))
    dealt = rows.mapInArrow(_dealt(cells, min_chars), "cell int, hashes binary")
    return cut(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_twice_seen(-(-lines // cells)), "hash long"))


def _suspects(listed: Callable[[], np.ndarray] | None, min_chars: int):
    """Lines whose hash is on the list: the broadcast one, or the document's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = listed() if listed else None
        for batch in batches:
            ids, keys, hashes, held = [], [], [], []
            own = None if listed else batch.column("hashes").to_pylist()
            for i, (doc, t) in enumerate(zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")))):
                found = list(line_keys(t, min_chars))
                these = [hashed(k) for k in found]
                if own:
                    mine = {h & 0xFFFFFFFFFFFFFFFF for h in own[i]}
                    held += [h in mine for h in these]
                ids += [doc] * len(found)
                keys += found
                hashes += these
            if listed and keys:
                values = np.array(hashes, np.uint64)
                held = among(everywhere, values)
            chosen = np.flatnonzero(held)
            if len(chosen):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[j] for j in chosen], pa.int64()), "key": pa.array([keys[j] for j in chosen], pa.binary()).cast(pa.string())})

    return run


def _hashes_of_documents(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, hashed(k)) for i, t in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text"))) for k in line_keys(t, min_chars)]
            if found:
                yield pa.RecordBatch.from_pydict({"at": pa.array([i for i, _ in found], pa.int64()), "hash": pa.array(np.array([h for _, h in found], np.uint64).astype(np.int64), pa.int64())})

    return run


def suspect_lines(rows: DataFrame, min_chars: int, most: int = BROADCAST_HASHES) -> DataFrame:
    """``doc_id, key`` of the lines whose hash is a suspect.

    Up to ``most`` suspects are broadcast; more meet the hashes of lines in a join, and texts
    are joined with the list of their own suspects.
    """
    spark = rows.sparkSession
    suspects = suspect_hashes(rows, min_chars)
    if suspects.count() <= most:
        list_of = spark.sparkContext.broadcast(np.sort(suspects.toPandas()["hash"].to_numpy(np.int64).view(np.uint64)))
        return rows.mapInArrow(_suspects(lambda: list_of.value, min_chars), "doc_id long, key string")
    of_lines = rows.mapInArrow(_hashes_of_documents(min_chars), "at long, hash long").join(suspects, "hash", "left_semi")
    lists = of_lines.groupBy("at").agg(F.collect_set("hash").alias("hashes"))
    met = rows.join(lists, rows["doc_id"].eqNullSafe(lists["at"])).select("doc_id", "text", "hashes")
    return met.mapInArrow(_suspects(None, min_chars), "doc_id long, key string")


def _kept(keepers_of, min_chars: int):
    """Texts without the lines whose key another document keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keepers = dict(keepers_of.value)
        for batch in batches:
            out, counts, gone = [], [], []
            for doc, t in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text"))):
                number = -(1 << 63) if doc is None else doc
                lines = t.split(b"\n")
                drop = {k for k in line_keys(t, min_chars) if number < keepers.get(k, number)}
                stay = [x for x in lines if x.lower().strip() not in drop] if drop else lines
                out.append(b"\n".join(stay) if drop else t)
                counts.append(len(lines))
                gone.append(len(lines) - len(stay))
            done = {"kept": pa.array(out, pa.binary()).cast(pa.string()), "n_lines": pa.array(counts, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | done)

    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: tuple[str, ...] = (), most_hashes: int = BROADCAST_HASHES, most_keys: int = BROADCAST_ROWS) -> DataFrame:
    """Every row without the lines that many documents share.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z in lower case. Keys of
    at least ``min_chars`` code points that ``min_docs`` documents hold lose all their lines
    except in the largest ``doc_id`` that holds them. Returns ``doc_id, text, kept, n_lines,
    n_dropped``: the whole text, and what stays of it; with ``carry``, also ``carried``, a struct
    of those columns.

    Texts are never shuffled while the keys that go are ``most_keys`` at most, and small enough
    to broadcast. With more, texts meet the list of their own keys that go in a join.

    A null or empty text is one empty line, and ``kept`` is then empty. Rows that repeat an id
    are one document when documents are counted, and all keep or lose a line alike. A null id
    counts as one document below all others. An empty table gives an empty result.
    """
    rows = two_columns(docs, id_col, text_col)
    spark = docs.sparkSession
    known = F.coalesce("doc_id", F.lit(-(1 << 63)))
    # One row of each document and key first, so that a line in many documents is counted in parts.
    held = written(suspect_lines(rows, min_chars, most_hashes)).groupBy("key", known.alias("at")).agg(F.count("*").alias("times"))
    counted = held.groupBy("key").agg(F.count("*").alias("n"), F.max("at").alias("keeper"))
    repeated = cut(counted.where(F.col("n") >= min_docs).select("key", "keeper"))
    number, size = repeated.agg(F.count("*"), F.sum(F.octet_length("key"))).first()
    rows = two_columns(docs, id_col, text_col, *carry)
    if number <= most_keys and (size or 0) <= BROADCAST_BYTES:
        keepers_of = spark.sparkContext.broadcast({r.key.encode(): r.keeper for r in repeated.toLocalIterator()})
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(_kept(keepers_of, min_chars), f"{fields}, kept string, n_lines long, n_dropped long")

    losers = held.join(repeated, "key").where(F.col("at") < F.col("keeper"))
    drops = losers.groupBy("at").agg(F.collect_set("key").alias("drop"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    stay = F.filter(lines, lambda x: ~F.array_contains("drop", F.btrim(F.translate(x, UPPER, LOWER), F.lit(SPACES))))
    met = rows.withColumn("at", known).join(drops, "at", "left")
    untouched = F.col("drop").isNull()
    kept = F.when(untouched, F.coalesce("text", F.lit(""))).otherwise(F.array_join(stay, "\n"))
    dropped = F.when(untouched, 0).otherwise(F.size(lines) - F.size(stay))
    return met.select(*rows.columns, kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when lines that three documents share are dropped."""
    done = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, u.line AS line, u.i AS i,
         trim(translate(u.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
       LATERAL (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS i) u
), bad AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT lines.*, bad.key IS NOT NULL AND doc_id <> keeper AS dropped
  FROM lines LEFT JOIN bad USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
