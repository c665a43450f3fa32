"""SimHash near-duplicates, found by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most three bits are cut into two segments of 32:
one of the segments then differs in at most one bit. Every distinct fingerprint is indexed
under each segment with each single bit left out (64 variants), so that linked fingerprints
meet in an equality join, where the full distance is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import per_batch, raw_texts, row_key, two_columns
from tessella.plans.components import connected_components
from tessella.plans.session import cut, table

RADIUS = 3
#: Distinct fingerprints in one bucket beyond which it is indexed again by its other bits.
HOT_BUCKET = 20_000
#: Shingle hashes whose bits are unpacked at once.
STEP = 1 << 15


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of one text: bits set in over half of its shingles' hashes; no word gives 0."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    elif words == 3:
        shingles = [b"%b %b %b" % x for x in zip(w, w[1:], w[2:])]
    else:
        shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), STEP):
        part = b"".join([xxhash.xxh64_digest(s, 42) for s in shingles[at : at + STEP]])
        counts += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big", signed=True)


def _fingerprints(batch: pa.RecordBatch) -> dict:
    return {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "fp": pa.array([fingerprint(t) for t in raw_texts(batch.column("text"))], pa.int64())}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, fp`` of every row: its id, its key, and the 64 bits as a signed long. A
    null text counts as empty."""
    rows = two_columns(docs, id_col, text_col).withColumn("row", row_key())
    return rows.mapInArrow(per_batch(_fingerprints), "doc_id long, row long, fp long")


def _variants(values: Column, width: int, slot: Column) -> Column:
    """The slot-th variant of the low 2*width bits: one half with one bit left out, and which."""
    mask = (1 << width) - 1
    half = F.when(slot < width, F.shiftrightunsigned(values, width).bitwiseAND(F.lit(mask))).otherwise(values.bitwiseAND(F.lit(mask)))
    bit = F.expr(f"shiftleft(1L, cast(slot % {width} as int))")
    return half.bitwiseAND(F.bitwise_not(bit)).bitwiseOR(F.shiftleft(slot.cast("long"), width))


def _first_meeting(a: Column, b: Column, width: int, slot: Column) -> Column:
    """True in one only of the buckets in which two values meet that differ in up to three bits."""
    mask = F.lit((1 << width) - 1)
    high = F.bit_count(F.shiftrightunsigned(a, width).bitwiseXOR(F.shiftrightunsigned(b, width)).bitwiseAND(mask))
    low = F.bit_count(a.bitwiseXOR(b).bitwiseAND(mask))
    in_high = (slot < width) & (high <= 1) & ((high == 1) | (slot == 0))
    in_low = (slot >= width) & (high > 1) & ((low == 1) | (slot == width))
    return in_high | in_low


def links(distinct: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs ``src < dst`` of the distinct fingerprints ``fp`` that differ in 1 to 3 bits, each once.

    Buckets with one member end before the join. A bucket of over ``hot_bucket`` members is
    indexed a second time: there the other segment differs in at most three bits, so one of
    its halves differs in at most one, and the members meet under 32 finer keys.
    """
    slots = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot"))
    keyed = slots.select("fp", "slot", _variants(F.col("fp"), 32, F.col("slot")).alias("key"))
    shared = cut(keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"))
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= RADIUS
    first = _first_meeting(F.col("src"), F.col("dst"), 32, F.col("slot"))

    cool = shared.where(F.col("n") <= hot_bucket)
    pairs = cool.select(F.col("fp").alias("src"), "key", "slot").join(cool.select(F.col("fp").alias("dst"), "key"), "key").where((F.col("src") < F.col("dst")) & near & first)

    other = F.when(F.col("slot") < 32, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    hot = shared.where(F.col("n") > hot_bucket).select("fp", "key", F.col("slot").alias("outer"), other.alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("slot"))
    hot = hot.select("fp", "key", "outer", "slot", "rest", _variants(F.col("rest"), 16, F.col("slot")).alias("finer"))
    a = hot.select(F.col("fp").alias("src"), F.col("rest").alias("ra"), "key", "finer", "outer", "slot")
    b = hot.select(F.col("fp").alias("dst"), F.col("rest").alias("rb"), "key", "finer")
    again = _first_meeting(F.col("src"), F.col("dst"), 32, F.col("outer")) & _first_meeting(F.col("ra"), F.col("rb"), 16, F.col("slot"))
    finer = a.join(b, ["key", "finer"]).where((F.col("src") < F.col("dst")) & near & again)
    return pairs.select("src", "dst").unionByName(finer.select("src", "dst"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``doc_id, row, fp, component, component_id`` of every row: see :func:`near_duplicates`.

    ``component`` is the class's own fingerprint, which is never null.
    """
    marked = cut(fingerprints(docs, id_col, text_col))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = connected_components(links(classes.select("fp"), hot_bucket))
    members = classes.join(joined.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = members.join(roots, "component").select("fp", "component", "component_id")
    return marked.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Every document with its fingerprint and the class of near-duplicates that it is in.

    Returns ``doc_id, fingerprint`` (16 lowercase hex digits) and ``component_id``, the
    smallest id of all documents that links reach. Only distinct fingerprints are linked, so
    copies meet once, however many there are.

    Null and empty texts share fingerprint zero and are linked as any other. Rows that repeat
    an id stay separate rows. Ids that are null are skipped in the minimum; a class of nothing
    but nulls has a null id. An empty table gives an empty result.
    """
    classed = near_duplicate_classes(docs, id_col, text_col, hot_bucket)
    return classed.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates over all of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
