from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import decontaminate
from tests.llm import data

ITEMS = [(1, data.PASSAGE), (2, "an item that no document holds at all in any of its many words"), (3, None), (4, ""), (5, "A b"), (6, data.PASSAGE.replace("enough", "plenty")), (1, data.PASSAGE)]


def shingles(t):
    w = (t or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute_force(rows, items):
    out = {}
    for i, t, *_ in rows:
        have = shingles(t)
        for j, u in items:
            want = shingles(u)
            if not want or not have:
                continue
            need = Counter(want)
            for s in range(max(1, len(have) - len(want) + 1)):
                part = Counter(have[s : s + len(want)])
                shared = sum((part & need).values())
                like = shared / (sum(part.values()) + len(want) - shared)
                if like >= 0.8:
                    out[i, j] = max(out.get((i, j), (0, 0)), (round(like, 9), -s))
    return {k: (v[0], -v[1]) for k, v in out.items()}


def test_equals_brute_force(spark):
    rows = data.rows() + [(800, data.PASSAGE, "en", "s"), (801, data.PASSAGE.upper() + " " + data.PASSAGE, "en", "s"), (802, "start " + data.PASSAGE.replace("item here", "thing there") + " end of it", "en", "s")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, *_ in rows], "doc_id long, text string, similarity string, start string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == brute_force(rows, ITEMS)
    assert {k[0] for k in got if k[1] == 1} >= {600, 601, 602, 800, 801} and {k[0] for k in got if k[1] == 5} == {700, 701}


def test_documents_shorter_than_the_item(spark):
    """Texts that are nothing but the first or last words of an item have fewer shingles than it."""
    words = data.PASSAGE.split()
    rows = [(n, " ".join(words[:n])) for n in range(15, 24)] + [(100 + n, " ".join(words[-n:])) for n in range(15, 24)]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in got.collect()}
    assert found == brute_force(rows, ITEMS)
    assert found[20, 1] == (round(16 / 19, 9), 0)


def test_pairs_beyond_the_radius(spark):
    """Items with one word changed in the middle are 0.80 alike; some fingerprints are too far apart for the index."""
    items = [(i, data.text(5000 + i, 50)) for i in range(400)]
    rows = [(i, " ".join(w if k != 25 else "changed" for k, w in enumerate(t.split()))) for i, t in items]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    apart = F.bit_count(decontaminate.simhash(decontaminate.shingles(F.col("d.text"))).bitwiseXOR(decontaminate.simhash(decontaminate.shingles(F.col("i.text")))))
    far = docs.alias("d").join(bench.alias("i"), F.expr("doc_id = item_id")).where(apart > decontaminate.RADIUS).count()
    assert far > 0
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.start) for r in got) == [(i, i, round(41 / 51, 9), 0) for i in range(400)]


def test_within_radius_all_meet(spark):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(40)]
    pairs = [(b, b ^ sum(1 << k for k in rng.sample(range(63), rng.randrange(decontaminate.RADIUS + 1)))) for b in base]
    df = spark.createDataFrame(pairs, "a long, b long")
    shared = F.size(F.array_intersect(decontaminate._blocks(F.col("a")), decontaminate._blocks(F.col("b"))))
    assert df.select(shared.alias("n")).where("n = 0").count() == 0


def test_few_unrelated_fingerprints_meet(spark):
    """Joined rows a (window, item) of random fingerprints."""
    import random

    rng = random.Random(4)
    many, few = ([(rng.getrandbits(64) - (1 << 63),) for _ in range(n)] for n in (4000, 100))
    keyed = [spark.createDataFrame(rows, "fp long").select(F.explode(decontaminate._blocks(F.col("fp"))).alias("block")) for rows in (many, few)]
    assert 0 < keyed[0].join(keyed[1], "block").count() < 0.05 * 4000 * 100


def test_short_and_random_texts_equal_brute_force(spark):
    """Items and texts of few words from a small vocabulary: repeats, and texts shorter than items."""
    import random

    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, text(rng.randrange(4, 30))) for i in range(25)]
    rows = [(i, text(rng.randrange(1, 60))) for i in range(60)]
    rows += [(100 + i, " ".join(t.split()[: max(1, len(t.split()) - i % 5)])) for i, (_, t) in enumerate(items * 2)]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in got.collect()} == brute_force(rows, items)


@pytest.mark.parametrize("at, m, least, last", [([0, 1, 2, 7, 8, 9, 30], 5, 3, 40), ([3], 4, 1, 3), ([1, 2, 3], 2, 2, 0), ([0, 5], 3, 2, 9), (list(range(0, 4000, 2)), 50, 24, 3900)])
def test_window_starts(spark, at, m, least, last):
    held = {s for s in range(last + 1) if sum(s <= p < s + m for p in at) >= least}
    got = spark.createDataFrame([(at, m, least, last)], "at array<int>, m int, least int, last int").select(decontaminate.window_starts(*map(F.col, ("at", "m", "least", "last")))).first()[0]
    assert set(got) == held and len(got) == len(held)


def test_simhash_counts_every_bit(spark):
    import random

    rng = random.Random(5)
    lists = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 51, 300)] + [[7] * 40_000 + [-2] * 30_000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lists], "x array<long>").select(decontaminate.simhash(F.col("x"))).collect()]
    for x, fp in zip(lists, got):
        assert fp & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x) > len(x))


def test_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contaminated(data.empty(spark), items).count() == 0
    assert decontaminate.contaminated(data.frame(spark), items.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6])
def test_shingle_counts(spark, n):
    df = spark.createDataFrame([(" ".join("abcdefgh"[:n]),)], "t string")
    assert df.select(F.size(decontaminate.shingles(F.col("t")))).first()[0] == (0 if n == 0 else max(1, n - 4))
