"""Benchmark decontamination, in DataFrame functions only.

Windows of a document that are as long as a benchmark item are compared with the items:

1. Documents and items become rows of hashed 5-word shingles. Positions of a document whose
   shingle some item has are found by a join with the items' shingles.
2. A window of n shingles that is at least s = ``SIMILARITY`` like an item of m shares at
   least s(m+n)/(1+s) of them with it, so only windows that hold so many such positions are
   made. n is m, or all of a document that is shorter. No window that could pass is lost.
3. Each window gets a 64-bit SimHash of its shingles, and meets the items' fingerprints in a
   multi-index: both are cut into RADIUS + 1 blocks, and two fingerprints within RADIUS bits
   agree in at least one block, so the equality join on blocks finds all of them. Blocks have
   8 bits, so 3 in 100 unrelated fingerprints share one. Only ids and fingerprints are joined.
4. Pairs whose fingerprints are further apart than that are found by an equality join too: of
   an item's m shingles a like window lacks m - s*m at most, so it holds one of any
   m - s*m + 1 of them. Those that the fewest items hold are taken.
5. The weighted Jaccard similarity of the shingles, counted as often as they stand, is taken
   of every pair of 3 and 4, and decides. No pair that could pass is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import SPACE_CLASS, SPACES, row_key, small, two_columns
from tessella.plans.session import cut, table

WORDS = 5
SIMILARITY = 0.8
#: Fingerprints of windows at the least similarity differ in 10 of 64 bits on average; pairs
#: that differ in more than this are found by shingles.
RADIUS = 7
#: Blocks of the multi-index, by pigeonhole one more than the radius, and their bits.
BLOCKS = RADIUS + 1
BLOCK_BITS = 64 // BLOCKS


def shingles(text: Column) -> Column:
    """Hashes of the 5-word shingles of a text, in order; of fewer words, of all of them.

    The words stand in an array of one list, so that the inner lambda reads a list that is
    split once and not again for every shingle.
    """
    clean = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(1)))
    hashed = F.transform(F.array(F.split(clean, SPACE_CLASS + "+")), lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.slice(w, i, WORDS))))
    return F.when(clean == "", F.array().cast("array<long>")).otherwise(hashed[0])


def simhash(hashes: Column) -> Column:
    """Bits that over half of the hashes have, as a signed long.

    Four bits are counted at once, in lanes of 16 bits of one sum; lists of over 65,535 hashes,
    which a lane can't count, are read bit by bit.
    """
    lane = lambda i: F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(0x0001000100010001)))
    lanes = [lane(i) for i in range(16)]
    counted = F.transform(F.array(F.array(*lanes)), lambda n: _majority(lambda b: F.shiftrightunsigned(n[b % 16], b - b % 16).bitwiseAND(F.lit(0xFFFF)), F.size(hashes)))[0]
    one_by_one = _majority(lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, F.lit(b)).cast("int")), F.size(hashes))
    return F.when(F.size(hashes) < 1 << 16, counted).otherwise(one_by_one)


def _majority(held: Callable[[int], Column], of: Column) -> Column:
    bits = [F.when(2 * held(b) > of, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def _blocks(fp: Column) -> Column:
    """The numbered blocks of a fingerprint."""
    mask = F.lit((1 << BLOCK_BITS) - 1)
    return F.array(*[F.shiftrightunsigned(fp, i * BLOCK_BITS).bitwiseAND(mask).bitwiseOR(F.lit(i << BLOCK_BITS)) for i in range(BLOCKS)])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard: shared shingles, as often as both have them, over all.

    Where either list holds no shingle twice, each shared one counts once; only where both
    repeat some are occurrences counted, one pass for each shared shingle.
    """
    times = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    once = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    common = F.array_intersect(a, b)
    shared = F.when(once, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda n, h: n + F.least(times(a, h), times(b, h))))
    return shared / (F.size(a) + F.size(b) - shared).cast("double")


def window_starts(at: Column, m: Column, least: Column, last: Column) -> Column:
    """Starts, up to ``last``, of windows of ``m`` that hold ``least`` of the sorted positions ``at``.

    A window holds that many if it holds some position and the one ``least`` - 1 places on, so
    each such two give a stretch of starts.
    """
    firsts = F.sequence(F.lit(1), F.size(at) - least + 1)
    ends = F.transform(firsts, lambda j: F.struct(F.greatest(F.get(at, j + least - 2) - m + 1, F.lit(0)).alias("a"), F.least(F.get(at, j - 1), last).alias("b")))
    return F.array_distinct(F.flatten(F.transform(F.filter(ends, lambda e: e["a"] <= e["b"]), lambda e: F.sequence(e["a"], e["b"]))))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of a document and a benchmark item that a window of it is like.

    Returns ``doc_id, item_id, similarity`` (the best of any window) and ``start``, the word at
    which the first such window begins.

    Words are what white space parts, in lower case. A text of fewer than five words is one
    shingle, so such an item matches a document of the same words only. Null and empty texts
    and items match nothing. Rows that repeat an id are searched one by one and reported
    once; so are repeated items. Null ids are reported as null. Empty tables give an empty
    result.
    """
    rows = two_columns(docs, id_col, text_col).withColumn("row", row_key()).withColumn("known", F.coalesce("doc_id", F.lit(-(1 << 63))))
    bench = items.select(items[item_col].cast("long").alias("item_id"), shingles(items[item_text_col].cast("string")).alias("item"))
    bench = bench.where(F.size("item") > 0).withColumn("m", F.size("item")).distinct()
    bench = cut(bench.withColumns({"item_fp": simhash(F.col("item")), "item_row": F.monotonically_increasing_id()}))
    marks = bench.select("m", F.explode(F.array_distinct("item")).alias("h")).groupBy("h").agg(F.collect_set("m").alias("sizes"))

    listed = rows.select("known", "row", shingles(F.col("text")).alias("all")).select("known", "row", F.size("all").alias("n"), "all")
    grams = listed.select("known", "row", "n", F.posexplode("all").alias("p", "h"))
    found = grams.join(small(marks), "h").select("known", "row", "n", "p", F.explode("sizes").alias("m"))
    hits = cut(found.groupBy("known", "row", "n", "m").agg(F.array_sort(F.collect_set("p")).alias("at")))

    # Starts (from 0) of windows of m shingles, or of all n, that hold enough of the positions.
    least = F.ceil((F.col("m") + F.least("m", "n")) * (similarity / (1 + similarity)) - 1e-9).cast("int")
    starts = window_starts(F.col("at"), F.col("m"), least, F.greatest(F.col("n") - F.col("m"), F.lit(0)))
    enough = hits.where(F.size("at") >= least).select("known", "row", "m", starts.alias("starts")).where(F.size("starts") > 0)
    full = rows.join(small(enough), ["known", "row"]).withColumn("all", shingles(F.col("text")))
    windows = full.select("row", "doc_id", "m", "all", F.explode("starts").alias("start")).select("row", "doc_id", "m", "start", F.slice("all", F.col("start") + 1, F.col("m")).alias("window"))
    windows = cut(windows.withColumn("fp", simhash(F.col("window"))))

    places, marked = windows.select("row", "m", "start", "fp"), bench.select("item_row", "m", "item_fp")
    apart, pair = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))), ["row", "m", "start", "item_row"]
    keyed = places.withColumn("block", F.explode(_blocks(F.col("fp"))))
    keyed_items = marked.withColumn("block", F.explode(_blocks(F.col("item_fp"))))
    close = keyed.join(small(keyed_items), ["m", "block"]).where(apart <= RADIUS).select(*pair)
    spelled = windows.select("row", "m", "start", "fp", F.explode(F.array_distinct("window")).alias("h"))
    far = spelled.join(small(_rare_shingles(bench, similarity)), ["m", "h"]).where(apart > RADIUS).select(*pair)
    # A pair meets in every block that agrees, and in every rare shingle that the window holds.
    pairs = close.unionByName(far).distinct()
    met = windows.join(small(pairs), ["row", "m", "start"]).join(small(bench.select("item_row", "item_id", "item")), "item_row")
    verified = met.withColumn("similarity", weighted_similarity(F.col("window"), F.col("item"))).where(F.col("similarity") >= similarity)
    best = verified.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("long").alias("start"))


def _rare_shingles(bench: DataFrame, similarity: float) -> DataFrame:
    """``item_row, m, item_fp, h``: shingles of which any window like the item holds one.

    If a window holds none of an item's first k shingles, in whatever order, it shares m - k of
    them at most; a like one shares s*m at least.
    """
    held = bench.select("m", F.explode(F.array_distinct("item")).alias("h")).groupBy("m", "h").agg(F.count("*").alias("holders"))
    each = bench.select("item_row", "m", "item_fp", F.explode("item").alias("h")).join(held, ["m", "h"])
    ordered = each.groupBy("item_row", "m", "item_fp").agg(F.array_sort(F.collect_list(F.struct("holders", "h"))).alias("order"))
    enough = (F.col("m") - F.ceil(F.col("m") * similarity - 1e-9) + 1).cast("int")
    return ordered.select("item_row", "m", "item_fp", F.explode(F.array_distinct(F.slice("order.h", 1, enough))).alias("h"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id AS id, 0 AS kind, row_number() OVER () AS r, trim(lower(coalesce(text, '')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM documents
  UNION ALL
  SELECT item_id, 1, -row_number() OVER (), trim(lower(coalesce(text, '')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FROM benchmark
), w AS (
  SELECT id, kind, r, regexp_split_to_array(text, '[\x20\x09-\x0D]+') AS w FROM t WHERE text <> ''
), s AS (
  SELECT id, kind, r, p, array_to_string(w[p + 1 : p + 5], ' ') AS h, greatest(len(w) - 4, 1) AS m
  FROM w, LATERAL (SELECT unnest(range(0, greatest(len(w) - 4, 1))) AS p) u
), item_counts AS (
  SELECT id AS item_id, r AS item_row, m, h, count(*) AS c FROM s WHERE kind = 1 GROUP BY ALL
), hits AS (
  SELECT DISTINCT d.r, d.id, d.p, i.item_id, i.item_row, i.m, d.m AS doc_m
  FROM s d JOIN item_counts i ON d.kind = 0 AND d.h = i.h
), windows AS (
  SELECT DISTINCT r, id, item_id, item_row, m, doc_m, u.start AS start
  FROM hits, LATERAL (SELECT unnest(range(greatest(p - m + 1, 0), greatest(least(p, doc_m - m), 0) + 1)) AS start) u
), window_counts AS (
  SELECT x.r, x.id, x.item_id, x.item_row, x.m, x.doc_m, x.start, d.h, count(*) AS c
  FROM windows x JOIN s d ON d.kind = 0 AND d.r = x.r AND d.p >= x.start AND d.p < x.start + x.m GROUP BY ALL
), shared AS (
  SELECT x.r, x.id, x.item_id, x.item_row, x.start, any_value(x.m) AS m, any_value(least(x.m, x.doc_m)) AS n,
         sum(least(x.c, coalesce(i.c, 0))) AS common
  FROM window_counts x LEFT JOIN item_counts i ON i.item_row = x.item_row AND i.h = x.h GROUP BY x.r, x.id, x.item_id, x.item_row, x.start
), scored AS (
  SELECT id AS doc_id, item_id, start, common / CAST(m + n - common AS DOUBLE) AS similarity FROM shared
)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_max(start, struct_pack(s := similarity, b := -start)) AS BIGINT) AS start
FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
