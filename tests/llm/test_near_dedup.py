import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import near_dedup
from tessella.plans.components import connected_components
from tests.llm import data


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_force(rows):
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], format(prints[i], "016x"), least.get(find(i))) for i, r in enumerate(rows)), key=str)


def test_equals_brute_force(spark):
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(data.frame(spark)).collect()), key=str)
    assert got == brute_force(data.rows())
    assert len({r[2] for r in got}) < len(got) - 25


@pytest.mark.parametrize("hot_bucket", [1, 5, 10**6])
def test_links_equal_all_pairs(spark, hot_bucket):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centre for _ in range(25)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    got = [(r.src, r.dst) for r in near_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long"), hot_bucket).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    labels = {r.vertex: r.component for r in connected_components(near_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long"), hot_bucket)).collect()}
    assert all(labels[a] == labels[b] for a, b in expected)


def test_empty(spark):
    out = near_dedup.near_duplicates(data.empty(spark))
    assert out.count() == 0 and out.columns == ["doc_id", "fingerprint", "component_id"]


def test_hash_is_that_of_sql(spark):
    assert spark.range(1).select(F.hex(F.xxhash64(F.lit("one two three")))).first()[0].lower() == xxhash.xxh64_hexdigest(b"one two three", 42)
