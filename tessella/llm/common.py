"""What the operators on documents share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.session import bounded_batches, cut, ship_package

#: White space that parts words and is stripped from lines: what bytes.split() takes.
SPACE_CLASS = r"[ \t-\r]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def two_columns(docs: DataFrame, id_col: str, text_col: str, *carry: str) -> DataFrame:
    """``doc_id, text`` only, whatever else the table holds and however it is named.

    Columns to ``carry`` come as one struct, ``carried``, so that no name clashes.
    """
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *([F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []))


def raw_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
    return [b or b"" for b in column.to_pylist()]


def per_batch(make) -> "callable":
    """A mapInArrow function from one that makes a dict of columns of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(make(batch))

    return run


def row_key() -> Column:
    """Tells rows of ``doc_id, text`` apart, repeated ids and nulls included."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 63))), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())


#: Rows and bytes of keys up to which a list is broadcast; more are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def _bytes_of(df: DataFrame) -> Column:
    """About how large a row is: eight bytes a column and item, and its texts."""
    size = F.lit(8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            size = size + F.coalesce(F.octet_length(df[f.name]), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 8 * F.coalesce(F.size(df[f.name]), F.lit(0))
    return size


def small(df: DataFrame) -> DataFrame:
    """``df``, checkpointed, and marked for broadcast if its counted rows and bytes allow that."""
    df = cut(df)
    rows, size = df.agg(F.count("*"), F.sum(_bytes_of(df))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def learnable(doc_id: Column, parts: int, held: int) -> Column:
    """True where crc32 of the id as text, modulo ``parts``, isn't ``held``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts != held


def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated arrays and where each begins, with the end last."""
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    return (np.concatenate(lists) if lists else np.zeros(0, np.int64)), ends
