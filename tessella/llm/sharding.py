"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seeded hash within their source and ranked; a row's fractional rank is
its rank plus its source's own offset, between 0 and 1, over the size of the source. Sorted by
fractional rank, every stretch of rows holds each source in its share, so cutting the order
into equal stretches gives shards that match the mixture, with row counts at most one apart.
The offsets spread sources of a few rows evenly instead of putting all of them in the middle.

Ranks are never taken over a whole source: each source is cut into buckets by leading digits
of the hash, buckets are counted, and a row's rank is its place in its bucket plus what stands
before the bucket. The same is done for the order of all rows by their fractional rank. Rows
that are equal in id, size and crc are counted first and told apart by a running number, which
enters the hash, so that many copies of a row spread over buckets too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans.session import cut, table

SHARDS, SEED = 40, "shard-seed-1"
#: Rows that a bucket is made for: the most that one window sorts, about.
BUCKET_ROWS = 4_000
#: Buckets whose counts are summed together before sums of those are taken.
GROUPED_BUCKETS = 4_096
#: Copies of one row that one task numbers.
COPIES_AT_ONCE = 10_000
#: Hex digits of the shuffle key that choose a bucket, and of a source's that are its offset.
DIGITS, OFFSET_DIGITS = 7, 5
#: Fractional ranks are whole parts of 2^60, so that the order is exact arithmetic.
WHOLE = 1 << 60


def fractional_rank(rank: str, of: str, offset: str) -> Column:
    """``(rank + offset / 2^20) / of`` in parts of 2^60, rounded down; exact for any 63-bit count."""
    return F.expr(f"((cast({rank} as decimal(19, 0)) * 1048576 + {offset}) * cast({WHOLE >> 20} as decimal(13, 0))) div cast({of} as decimal(19, 0))")


def _placed(rows: DataFrame, by: list[str], order: list[Column], into: str) -> DataFrame:
    """``into``: the place (from 0) of each row by (``bucket``, ``order``) within ``by``."""
    keys = [*by, "bucket"]
    sizes = cut(rows.groupBy(*keys).agg(F.count("*").alias("here")).withColumn("many", F.expr(f"bucket div {GROUPED_BUCKETS}")))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy(*by, "many").agg(F.sum("here").alias("n"))
    groups = groups.select(*by, "many", F.coalesce(F.sum("n").over(before(by, "many")), F.lit(0)).alias("first"))
    within = sizes.select(*keys, "many", F.coalesce(F.sum("here").over(before([*by, "many"], "bucket")), F.lit(0)).alias("next"))
    starts = within.join(groups, [*by, "many"]).select(*keys, (F.col("first") + F.col("next")).alias("start"))
    ranked = rows.withColumn("in_bucket", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return ranked.join(starts, keys).withColumn(into, F.col("start") + F.col("in_bucket")).drop("start", "in_bucket", "bucket")


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows again, those that are equal in all columns told apart by ``copy``, from 0."""
    counted = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")))
    few = counted.where(F.col("copies") <= COPIES_AT_ONCE).select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    last = F.expr(f"(copies - 1) div {COPIES_AT_ONCE}")
    many = counted.where(F.col("copies") > COPIES_AT_ONCE).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part")).repartition("doc_id", "part")
    end = F.least((F.col("part") + 1) * COPIES_AT_ONCE, F.col("copies")) - 1
    return few.unionByName(many.select(*rows.columns, F.explode(F.sequence(F.col("part") * COPIES_AT_ONCE, end)).alias("copy")))


def interleaved_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``doc_id, size, text_crc32, source, shard, slot`` of every row.

    ``slot`` counts gaplessly from 0 in each shard, in the interleaved order. Row counts of any
    two shards differ by one at most, and so do a source's rows from its share, about.

    A null source is a source of its own; a null text has size 16 and the crc of nothing. Rows
    that repeat an id are dealt one by one; ties in the shuffle are settled by id, crc and size,
    and rows equal in those too are alike in the result. An empty table gives an empty result.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("")).alias("stratum"),
    )
    told = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size", "copy"]
    rows = cut(_numbered(rows).withColumn("mixed", F.md5(F.concat_ws(":", F.lit(seed), *told).cast("binary"))))
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("of"))
    total = rows.count()
    spread = -(-max(total, 1) // bucket_rows)
    leading = F.conv(F.substring("mixed", 1, DIGITS), 16, 10).cast("decimal(10, 0)")
    by_hash = rows.withColumn("leading", leading).withColumn("bucket", F.expr(f"(leading * cast({spread} as decimal(19, 0))) div cast({16**DIGITS} as decimal(10, 0))")).drop("leading")
    ties = [F.col("mixed"), F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("copy")]
    ranked = _placed(by_hash, ["stratum"], ties, "rank").join(F.broadcast(sizes) if sizes.count() <= 50_000 else sizes, "stratum")

    tied = F.md5(F.concat_ws(":", F.lit(seed), F.col("stratum")).cast("binary"))
    offset = F.conv(F.substring("tied", 1, OFFSET_DIGITS), 16, 10).cast("decimal(10, 0)")
    ordered = ranked.withColumn("tied", tied).withColumn("offset", offset)
    ordered = ordered.select("doc_id", "size", "text_crc32", "stratum", fractional_rank("rank", "of", "offset").alias("share"), "rank", "tied")
    ordered = ordered.withColumn("bucket", F.expr(f"(cast(share as decimal(19, 0)) * cast({spread} as decimal(19, 0))) div cast({WHOLE} as decimal(19, 0))")).withColumn("whole", F.lit(1))
    placed = _placed(ordered, ["whole"], [F.col("share"), F.col("tied"), F.col("rank")], "place")
    shard = F.expr(f"(place * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards} - 1) div {shards}")
    out = placed.withColumn("shard", shard).withColumn("slot", F.col("place") - first)
    source = F.when(F.col("stratum") != "", F.substring("stratum", 2, 1 << 20))
    return out.select("doc_id", "size", "text_crc32", source.alias("source"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in shards 0 to 39 of equal row counts."""
    dealt = interleaved_shards(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The crc goes nibble by nibble through the 16 entries of the reflected polynomial's table
#: (fixed values).
OP9_SQL = """
WITH nibbles AS (
  SELECT doc_id, source, 16 + strlen(coalesce(text, '')) AS size,
         [instr('0123456789ABCDEF', c) - 1 FOR c IN string_split(hex(encode(coalesce(text, ''))), '')] AS n
  FROM documents
), rows AS (
  SELECT doc_id, size, coalesce('=' || source, '') AS stratum,
         CASE WHEN size = 16 THEN 0 ELSE xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), [CAST(n[(i - 1) // 2 * 2 + 2 - (i - 1) % 2] AS BIGINT) FOR i IN range(1, len(n) + 1)]),
           lambda c, x: xor([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
                       3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108
                      ][CAST((xor(c, x) & 15) + 1 AS BIGINT)], c >> 4)), 4294967295) END AS text_crc32
  FROM nibbles
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, size, text_crc32, stratum) - 1 AS copy FROM rows
), mixed AS (
  SELECT *, md5('shard-seed-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_crc32 || ':' || size || ':' || copy) AS mixed,
         md5('shard-seed-1:' || stratum) AS tied FROM numbered
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY mixed, doc_id NULLS FIRST, text_crc32, size, copy) - 1 AS rank,
         count(*) OVER (PARTITION BY stratum) AS of FROM mixed
), shares AS (
  SELECT *, ((CAST(rank AS HUGEINT) * 1048576 + CAST('0x' || substr(tied, 1, 5) AS BIGINT)) * 1099511627776) // of AS share FROM ranked
), placed AS (
  SELECT *, row_number() OVER (ORDER BY share, tied, rank) - 1 AS place, count(*) OVER () AS total FROM shares
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(place * 40 // total AS INTEGER) AS shard,
       CAST(place - ((place * 40 // total) * total + 39) // 40 AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
