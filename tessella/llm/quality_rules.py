"""Quality rules whose thresholds come from quantile sketches by language and source.

A sketch counts the values of a metric by their three leading digits, so a quantile read from
it is at most one hundredth below the exact one, of whatever size values are, and its rank is
exact up to that digit. Such sketches merge by adding counts: that of a language is the sum of
those of its sources, and none depends on the order of rows or on lost tasks.

No cutoff is fixed. A group's fence stands SPREAD quartile distances beyond its quartiles, and
a document fails if its count is beyond what the fence allows for so many words or lines by
more than chance explains: by SPREAD standard deviations of a Poisson count. Where quartiles
coincide, chance alone is what is allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import per_batch, raw_texts
from tessella.plans.session import bounded_batches, cut, ship_package, table

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Documents that a sketch needs; with fewer, that of the language holds, then that of all.
MIN_SKETCH = 30
#: Quartile distances beyond the quartiles where a fence stands, and standard deviations that
#: a document may be beyond it.
SPREAD = 3
#: Of each metric: what is counted, in what, and how many come at a time (a sentence of ten
#: words that stands twice is twenty repeated words).
METRICS = {"symbols": ("n_symbols", "n_words", 1), "repeats": ("n_repeat_words", "n_words", 20), "dup_lines": ("n_dup_lines", "n_lines", 1), "word_length": ("word_chars", "n_words", 1)}
#: Metrics that can be too low as well.
BOTH_WAYS = {"word_length"}
#: Bytes that aren't the first of a code point, and white space between words.
NOT_CHARS = bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"


def measures(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word)."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = 0
    if n >= 3:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
        if len(numbers) < 1 << 21:
            windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        else:
            triples = np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1)
            windows = np.unique(triples, axis=0, return_inverse=True)[1].ravel()
        _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[which] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : shift + n - 2] |= twice
        repeats = int(covered.sum())
    return n, len(text.translate(None, NOT_CHARS)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines)


def _measured(batch: pa.RecordBatch) -> dict:
    rows = [measures(t) for t in raw_texts(batch.column("text"))]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    return {c: batch.column(c) for c in ("doc_id", "lang", "source")} | {c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(names)}


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts on every whole text; a null or empty text has no word, symbol or line."""
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    key = lambda c: F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), key(lang_col).alias("lang"), key(source_col).alias("source"), docs[text_col].cast("string").alias("text"))
    kinds = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"))
    return rows.mapInArrow(per_batch(_measured), f"doc_id long, lang string, source string, {kinds}")


def _bin(value: Column) -> Column:
    """A whole number with all but its three leading digits zero."""
    step = F.pow(F.lit(10), F.greatest(F.length(value.cast("string")) - 3, F.lit(0))).cast("long")
    return value - value % step


def _rates() -> dict[str, Column]:
    """What is sketched: counts in a thousand."""
    return {metric: F.expr(f"1000 * {count} div {of}") for metric, (count, of, _) in METRICS.items()}


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """``n``, ``low`` and ``high`` quartile of every sketch: its first bins that reach a quarter
    and three quarters of its rows."""
    merged = sketch.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))
    within = Window.partitionBy(*by, "metric")
    summed = merged.withColumn("upto", F.sum("n").over(within.orderBy("bin"))).withColumn("all", F.sum("n").over(within))
    return summed.groupBy(*by, "metric").agg(
        F.max("all").alias("n"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bin"))).alias("low"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bin"))).alias("high"),
    )


def adaptive_fences(measured: DataFrame, spread: int = SPREAD, min_sketch: int = MIN_SKETCH) -> DataFrame:
    """The lowest and highest value that passes, of each metric by language and source."""
    rates = _rates()
    valued = measured.where((F.col("n_words") > 0) & ~F.col("base_failed")).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), _bin(v).alias("bin")) for k, v in rates.items()])).alias("x"))
    sketch = cut(valued.groupBy("lang", "source", F.col("x.metric").alias("metric"), F.col("x.bin").alias("bin")).agg(F.count("*").alias("n")))
    levels = [_quartiles(sketch, by) for by in (["lang", "source"], ["lang"], [])]
    named = [level.withColumnsRenamed({c: f"{c}{i}" for c in ("n", "low", "high")}) for i, level in enumerate(levels)]
    groups = measured.select("lang", "source").distinct()
    metrics = F.explode(F.array(*[F.lit(m) for m in rates])).alias("metric")
    joined = groups.select("lang", "source", metrics).join(named[0], ["lang", "source", "metric"], "left").join(named[1], ["lang", "metric"], "left").join(named[2], ["metric"], "left")
    pick = lambda c: F.when(F.col("n0") >= min_sketch, F.col(f"{c}0")).when(F.col("n1") >= min_sketch, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    wide = spread * (pick("high") - pick("low"))
    fences = joined.select("lang", "source", "metric", (pick("low") - wide).alias("floor"), (pick("high") + wide).alias("ceiling"))
    return fences.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in rates for c in ("floor", "ceiling")])


def _within(metric: str, spread: int) -> Column:
    """Whether a document's count of a metric is one that the fences and chance allow."""
    count, of, grain = METRICS[metric]
    chance = lambda fence: float(spread) * F.sqrt(F.lit(1000.0 * grain) * (F.greatest(F.col(fence), F.lit(0)) * F.col(of) + 1000 * grain))
    inside = F.coalesce(1000 * F.col(count) - F.col(f"{metric}_ceiling") * F.col(of) <= chance(f"{metric}_ceiling"), F.lit(True))
    if metric in BOTH_WAYS:
        inside = inside & F.coalesce(F.col(f"{metric}_floor") * F.col(of) - 1000 * F.col(count) <= chance(f"{metric}_floor"), F.lit(True))
    return inside


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spread: int = SPREAD, min_sketch: int = MIN_SKETCH) -> DataFrame:
    """Counts of every document, whether it fails the base rule, and whether it is kept.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated 3-word windows.
    Of the others, those stay that lie within what the fences of their language and source
    allow for symbols per word, repeated words, repeated lines and word length (both ways).

    Null languages and sources are groups of their own. Null and empty texts fail the base
    rule. Repeated ids stay separate rows. An empty table gives an empty result.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = cut(text_measures(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", failed))
    fences = cut(adaptive_fences(measured, spread, min_sketch))
    joined = measured.join(F.broadcast(fences) if fences.count() <= 50_000 else fences, ["lang", "source"], "left")
    inside = F.lit(True)
    for metric in METRICS:
        inside = inside & _within(metric, spread)
    kept = F.when(F.col("base_failed"), False).otherwise(inside)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return judge_quality(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source,
         coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM cut, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) u
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1
), repeats AS (
  SELECT r, count(DISTINCT i + s) AS n FROM twice, (VALUES (0), (1), (2)) v(s) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM cut) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY r
), base AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM cut LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)
), flagged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), rates AS (
  SELECT *, v.metric AS metric, v.count AS c, v.of AS e, v.grain AS g,
         v.rate - v.rate % CAST(power(10, greatest(length(CAST(v.rate AS VARCHAR)) - 3, 0)) AS BIGINT) AS bin
  FROM (SELECT *, row_number() OVER () AS id FROM flagged) f, LATERAL (SELECT unnest(
    [{metric: 'symbols', count: n_symbols, of: n_words, grain: 1, rate: 1000 * n_symbols // nullif(n_words, 0)},
     {metric: 'repeats', count: n_repeat_words, of: n_words, grain: 20, rate: 1000 * n_repeat_words // nullif(n_words, 0)},
     {metric: 'dup_lines', count: n_dup_lines, of: n_lines, grain: 1, rate: 1000 * n_dup_lines // nullif(n_lines, 0)},
     {metric: 'word_length', count: word_chars, of: n_words, grain: 1, rate: 1000 * word_chars // nullif(n_words, 0)}]) AS v) x
), sketch AS (
  SELECT lang, source, metric, bin, count(*) AS n FROM rates WHERE n_words > 0 AND NOT base_failed GROUP BY ALL
), levels AS (
  SELECT lang, source, metric, bin, n, 0 AS level FROM sketch
  UNION ALL SELECT lang, NULL, metric, bin, sum(n), 1 FROM sketch GROUP BY lang, metric, bin
  UNION ALL SELECT NULL, NULL, metric, bin, sum(n), 2 FROM sketch GROUP BY metric, bin
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bin) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM levels
), quartiles AS (
  SELECT level, lang, source, metric, max(total) AS n, min(bin) FILTER (WHERE 4 * upto >= total) AS low,
         min(bin) FILTER (WHERE 4 * upto >= 3 * total) AS high FROM summed GROUP BY level, lang, source, metric
), judged AS (
  SELECT r.id, bool_and(coalesce(1000 * c - q.high * e <= 3.0 * sqrt(1000.0 * g * (greatest(q.high, 0) * e + 1000 * g)), true)
                    AND (r.metric <> 'word_length' OR coalesce(q.low * e - 1000 * c <= 3.0 * sqrt(1000.0 * g * (greatest(q.low, 0) * e + 1000 * g)), true))) AS inside
  FROM rates r
  LEFT JOIN quartiles a ON a.level = 0 AND a.lang = r.lang AND a.source = r.source AND a.metric = r.metric
  LEFT JOIN quartiles b ON b.level = 1 AND b.lang = r.lang AND b.metric = r.metric
  LEFT JOIN quartiles c ON c.level = 2 AND c.metric = r.metric,
  LATERAL (SELECT CASE WHEN a.n >= 30 THEN a.low WHEN b.n >= 30 THEN b.low ELSE c.low END AS l,
                  CASE WHEN a.n >= 30 THEN a.high WHEN b.n >= 30 THEN b.high ELSE c.high END AS h) p,
  LATERAL (SELECT p.l - 3 * (p.h - p.l) AS low, p.h + 3 * (p.h - p.l) AS high) q
  GROUP BY r.id
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       base_failed, NOT base_failed AND inside AS kept
FROM (SELECT DISTINCT id, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed FROM rates) JOIN judged USING (id)
"""
