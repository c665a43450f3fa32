"""Documents to tokens: language ID, line dedup, near-dedup, decontamination, BPE.

Every stage takes all that its predecessor kept, and is written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import encode_and_decode, vocabulary_file
from tessella.llm.common import row_key, small
from tessella.llm.decontaminate import contaminated
from tessella.llm.language_id import UNDETERMINED, identify_languages
from tessella.llm.line_dedup import drop_repeated_lines
from tessella.llm.near_dedup import near_duplicate_classes
from tessella.plans.session import cut, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """With ``at`` and ``row``: the id, null as the least number, and a hash of id and text."""
    return docs.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("row", row_key())


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` whose id and row key aren't among the ``at, row`` of ``keys``."""
    return _keyed(docs).join(small(keys.select("at", "row").distinct()), ["at", "row"], "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that no language can be told of; the others get the language that was told.

    Those without a text or any letter go, and those that score less than half of what sets the
    least of the learned documents of their language and length apart from a text that shares
    nothing with any. Rows that repeat an id, and null ids and sources, are judged by their text
    alone. An empty table, or one without any language to learn from, gives an empty result.
    """
    told = identify_languages(docs, carry=("source", "n_chars"))
    kept = told.where((F.col("lang_pred") != UNDETERMINED) & ~F.col("foreign"))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "carried.source", "carried.n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that three documents share, except in the document of the largest id.

    Every document stays, if with an empty text; ``n_chars`` is counted again. Rows that repeat
    an id count as one document, a null id as the least. An empty table gives an empty result.
    """
    done = drop_repeated_lines(docs, carry=("lang", "source"))
    return done.select("doc_id", F.col("kept").alias("text"), "carried.lang", "carried.source", F.length("kept").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id stays.

    Null ids come last, ties are settled by a hash of the text, and of equal rows one stays.
    Texts without a word are one class. An empty table gives an empty result.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "at", "row").alias("rank")
    classed = near_duplicate_classes(docs).withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)))).groupBy("component", "doc_id", "at", "row").agg(F.count("*").alias("n"))
    classed = cut(classed.select("component", "at", "row", "n", rank))
    winners = classed.groupBy("component").agg(F.min("rank").alias("first"))
    marked = cut(classed.join(winners, "component").select("at", "row", "n", (F.col("rank") == F.col("first")).alias("stays")))
    kept = _without(docs, marked.where("not stays"))
    twice = cut(marked.where("stays and n > 1").select("at", "row"))
    if twice.isEmpty():
        return kept
    once = _without(kept, twice)
    copies = _keyed(kept).join(small(twice), ["at", "row"], "left_semi").dropDuplicates(["at", "row"])
    return once.unionByName(copies.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a benchmark item.

    An id goes with all its rows if one of them holds an item; so do null ids, together. Texts
    without words stay. Empty documents give an empty result, an empty benchmark keeps all.
    """
    docs = docs.select(*COLUMNS)
    leaks = small(contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak")).distinct())
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak"]), "left_anti")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, and the digest of the text that they decode to.

    A null or empty text has no tokens. Repeated and null ids pass through. An empty table
    gives an empty result.
    """
    coded = encode_and_decode(docs, vocabulary_file())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: Kernel scores, fingerprints and tokens have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
