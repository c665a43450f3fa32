import hashlib
import random
import zlib

import numpy as np
import pytest

from tessella.llm import runs
from tests.llm import data


def plain_runs(w):
    """Every stretch of a smallest period, by looking at all lags and places."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                s = w[i : i + length]
                if not any(s[p:] == s[: length - p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out)


def random_words(rng, size):
    letters, w = rng.choice([1, 2, 2, 3, 5, 50]), []
    while len(w) < size:
        block = [rng.randrange(letters) for _ in range(rng.randrange(1, rng.choice([3, 12, 60])))]
        w += (block * rng.randrange(1, 8))[: rng.randrange(1, 200)]
        if rng.random() < 0.3:
            w += w[rng.randrange(len(w)) :]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        w = random_words(rng, rng.choice([10, 30, 100, 300]))
        expected = plain_runs(w)
        assert runs.runs_of(np.array(w)) == expected
        assert not expected or len(runs.repeating(np.array(w), np.zeros(len(w), int)))


def test_periods_made_of_parts_that_repeat():
    """Within a period of many blocks every short sequence stands twice: nearer repeats don't hide the run."""
    a, b = list(range(16)), list(range(100, 116))
    period = [*a, *a, *a, *b, *b, *b, *a, *b]
    w = period * 4 + [7]
    assert (0, len(period) * 4, len(period)) in runs.runs_of(np.array(w)) and runs.runs_of(np.array(w)) == plain_runs(w)


@pytest.mark.parametrize("made", [lambda n: [1] * n, lambda n: [i % 7 for i in range(n)], lambda n: [i // 20 for i in range(n)], lambda n: [i % (n // 4) for i in range(n)]])
def test_long_texts_take_no_squares(made):
    w = np.array(made(300_000))
    found = runs.runs_of(w)
    assert len(found) <= 1


def test_shortest_runs():
    assert runs.runs_of(np.array([1] * 23)) == [] and runs.runs_of(np.array([1] * 24)) == [(0, 24, 1)]
    assert runs.runs_of(np.array(list(range(9)) * 3)) == [(0, 27, 9)] and runs.runs_of(np.array((list(range(9)) * 3)[:-1])) == []
    assert runs.runs_of(np.zeros(0, np.int64)) == []


def plain_row(i, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines.encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone))


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t, *_ in data.rows()]
    rows += [(800, "spam " * 500), (801, "a b c " * 30 + "x " + "a b c " * 30), (802, " \x0b\x0cq\tr\n" * 40), (803, "ñandú día " * 13)]
    rows += [(900 + i, data.text(i, 60)) for i in range(80)]  # some of these ids plant a repeat
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((plain_row(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 10


def test_frame(spark):
    got = runs.periodic_runs(data.frame(spark)).collect()
    assert len(got) == len(data.rows()) and runs.periodic_runs(data.empty(spark)).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[300].n_words == 0 and by[300].runs == [] and by[300].collapsed == ""
