from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import line_dedup, quality_rules, sharding
from tests.llm import data
from tests.oracle import rows as plain

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain_lines(rows):
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[key_of(line)].add(-(1 << 63) if i is None else i)
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        me = -(1 << 63) if i is None else i
        kept = [x for x in lines if not (len(key_of(x)) >= 20 and len(holders[key_of(x)]) >= 3 and me != max(holders[key_of(x)]))]
        yield i, "\n".join(kept), len(lines), len(lines) - len(kept)


@pytest.mark.parametrize("most", [{}, {"most_hashes": 0}, {"most_keys": 0}, {"most_hashes": 0, "most_keys": 0}])
def test_line_dedup_equals_brute_force(spark, most):
    """Whether suspects and repeated keys are broadcast or joined."""
    expected = list(plain_lines(data.rows()))
    got = line_dedup.drop_repeated_lines(data.frame(spark), carry=("lang", "source"), **most)
    assert sorted(((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == sorted(expected, key=str)
    assert sum(e[3] for e in expected) > 20
    assert line_dedup.drop_repeated_lines(data.empty(spark), **most).count() == 0


def test_filters_report_what_is_seen_twice():
    rng = np.random.default_rng(0)
    values = rng.integers(1, 1 << 63, 40_000).astype(np.uint64)
    parts = [values[:20_000], values[15_000:30_000], values[29_000:], values[:1000]]
    cell = line_dedup.Filters(sum(map(len, parts)))
    found = np.concatenate([cell.add(p) for p in parts])
    seen, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert len(set(found.tolist())) == len(found)
    assert set(seen[counts > 1].tolist()) <= set(found.tolist())
    assert len(found) - (counts > 1).sum() < 0.01 * len(seen)


def test_filters_miss_no_repeat_when_half_the_lines_repeat():
    """Filters made for 2^20 lines, of which 500,000 repeat: others have set their bits."""
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 500_000).astype(np.uint64) * np.uint64(2)
    cell = line_dedup.Filters(1 << 20)
    parts = [*np.array_split(values, 40), *np.array_split(rng.permutation(values), 40), *np.array_split(rng.permutation(values), 7)]
    found = np.concatenate([cell.add(p) for p in parts])
    assert len(set(found.tolist())) == len(found) and set(values.tolist()) == set(found.tolist())


def test_every_repeated_line_goes(spark):
    """Each of many lines stands in three documents: all but the last copies go."""
    lines = [f"this is the line with number {i} of many" for i in range(60_000)]
    docs = spark.createDataFrame([(c * 60 + k, "\n".join(lines[k * 1000 : (k + 1) * 1000])) for c in range(3) for k in range(60)], "doc_id long, text string").repartition(6)
    got = line_dedup.drop_repeated_lines(docs).agg({"n_lines": "sum", "n_dropped": "sum"}).first()
    assert tuple(sorted(got)) == (120_000, 180_000)


def test_filters_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CELL_LINES", 40)
    expected = list(plain_lines(data.rows()))
    got = line_dedup.drop_repeated_lines(data.frame(spark))
    assert sorted(((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == sorted(expected, key=str)


def test_measures_equal_brute_force():
    for _, t, *_ in data.rows():
        t = t or ""
        words = t.encode().split()
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + s for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for s in range(3)}
        lines = [x for x in t.split("\n") if x.strip(SPACE)]
        expected = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines))
        assert quality_rules.measures(t.encode()) == expected


def test_verdicts_cover_every_row(spark):
    frame = data.frame(spark)
    got = quality_rules.judge_quality(frame).collect()
    assert len(got) == len(data.rows())
    assert all(r.kept is not None and not (r.kept and r.base_failed) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[300].base_failed and by[301].base_failed and not by[303].kept and by[7].kept
    assert quality_rules.judge_quality(data.empty(spark)).count() == 0


def test_symbols_are_rejected_against_their_group(spark):
    clean = [(i, data.text(i), "en", "s") for i in range(60)]
    junk = [(100, data.text(7).replace(" ", " ### "), "en", "s")]
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[100] and all(got[i] for i in range(60))
    symbolic = [(200 + i, data.text(i).replace(" ", " | "), "en", "tables") for i in range(60)]
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(spark.createDataFrame(clean + symbolic, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got.values())  # what is usual in a source passes there


def test_sharding_laws(spark):
    got = sharding.interleaved_shards(data.frame(spark), shards=7, bucket_rows=9).collect()
    n = len(data.rows())
    assert len(got) == n
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for source, total in Counter(r.source for r in got).items():
        for s in sizes:
            here = sum(r.shard == s and r.source == source for r in got)
            assert abs(here - total * sizes[s] / n) <= 2
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 16) for i, t, *_ in data.rows())
    again = sharding.interleaved_shards(data.frame(spark).repartition(2), shards=7, bucket_rows=1000)
    assert plain(again.toPandas(), ["doc_id", "shard", "slot"]) == plain(sharding.interleaved_shards(data.frame(spark), shards=7, bucket_rows=9).toPandas(), ["doc_id", "shard", "slot"])
    assert sharding.interleaved_shards(data.empty(spark)).count() == 0


def test_fractional_ranks_of_huge_sources(spark):
    rows = [(0, 1, 7), (10**11 - 1, 10**11, (1 << 20) - 1), (9 * 10**17, 10**18, 3)]
    got = spark.createDataFrame(rows, "rank long, of long, offset int").select(sharding.fractional_rank("rank", "of", "offset")).collect()
    assert [r[0] for r in got] == [(((rank << 20) + offset) << 40) // of for rank, of, offset in rows]


def test_many_copies_of_a_row_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES_AT_ONCE", 70)
    rows = [(1, "the same", "s")] * 500 + [(i, "other", f"t{i}") for i in range(500)]
    got = sharding.interleaved_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=10, bucket_rows=50).collect()
    assert len(got) == 1000 and Counter(r.shard for r in got) == {s: 100 for s in range(10)}
    assert all(38 <= n <= 62 for n in Counter(r.shard for r in got if r.source == "s").values())
    assert all(30 <= n <= 70 for n in Counter(r.shard for r in got if r.source != "s").values())


def test_fences_follow_each_group(spark):
    """Other distributions give other fences, for every metric, by quantiles of the exact rates."""
    rows = []
    for i in range(80):
        plain_text = data.text(i, 100 + i)
        rows.append((i, plain_text, "en", "prose"))
        words = plain_text.split()
        doubled = " ".join(w + "longer" for w in words + words[: i // 3]) + " |" * (i % 9)
        rows.append((1000 + i, doubled + "\nrow\nrow" * (1 + i % 5), "en", "tables"))
    measured = quality_rules.text_measures(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).selectExpr("*", "false as base_failed")
    fences = {r.source: r.asDict() for r in quality_rules.adaptive_fences(measured).collect()}
    got = measured.collect()
    for metric, (count, of, _) in quality_rules.METRICS.items():
        assert fences["=prose"][f"{metric}_ceiling"] != fences["=tables"][f"{metric}_ceiling"], metric
        for source in fences:
            exact = sorted(1000 * r[count] // r[of] for r in got if r.source == source)
            low, high = exact[-(-len(exact) // 4) - 1], exact[-(-3 * len(exact) // 4) - 1]
            ceiling = high + 3 * (high - low)
            assert abs(fences[source][f"{metric}_ceiling"] - ceiling) <= 0.01 * (4 * high + 3 * low), (metric, source)


def test_sketch_bins_have_three_digits(spark):
    df = spark.createDataFrame([(v,) for v in (0, 7, 999, 1000, 1009, 123_456, 98_765_432_101)], "v long")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(quality_rules._bin(F.col("v"))).collect()] == [0, 7, 999, 1000, 1000, 123_000, 98_700_000_000]
