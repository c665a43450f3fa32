import itertools
import random

import pytest

from tessella.operators import communities

EDGE = "slide_id long, src long, dst long, w double"


def quality(edges, label):
    """Modularity, plainly."""
    degree, inside = {}, 0.0
    for u, v, w in edges:
        for e in (u, v):
            degree[e] = degree.get(e, 0) + w
        inside += 2 * w * (label[u] == label[v])
    m2, total = sum(degree.values()), {}
    for v, k in degree.items():
        total[label[v]] = total.get(label[v], 0) + k
    return inside / m2 - sum((t / m2) ** 2 for t in total.values())


def plain(edges):
    """Vertices in turn move to the best neighbouring community, then single communities merge."""
    near = {}
    for u, v, _ in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    label, moved = {v: v for v in near}, True
    while moved:
        moved = False
        for group in [[v] for v in sorted(near)] + [[v for v in near if label[v] == c] for c in sorted(set(label.values()))]:
            if not group:
                continue
            now = quality(edges, label)
            for c in sorted({label[u] for v in group for u in near[v]}):
                tried = {**label, **dict.fromkeys(group, c)}
                if quality(edges, tried) > now + 1e-9:
                    label, now, moved = tried, quality(edges, tried), True
    return label


def planted(rng, groups, size, close, far):
    member = {v: v // size for v in range(groups * size)}
    return [(u, v, 1.0) for u, v in itertools.combinations(member, 2) if rng.random() < (close if member[u] == member[v] else far)], member


def test_planted_communities_of_two_slides(spark):
    """The second slide is cliques on a ring, with the same ids."""
    rng = random.Random(3)
    first, member = planted(rng, 4, 10, 0.7, 0.04)
    ring = [(u, v, 1.0) for g in range(6) for u, v in itertools.combinations(range(g * 5, g * 5 + 5), 2)] + [(g * 5, (g * 5 + 9) % 30, 1.0) for g in range(6)]
    rows = [(s, *e) for s, edges in ((0, first), (1, ring)) for e in edges] + [(0, None, 3, 1.0), (0, 100, 101, 0.0)]
    got = {}
    for r in communities.communities(spark.createDataFrame(rows, EDGE)).collect():
        got.setdefault(r.slide_id, {})[r.id] = r.community
    assert got[0] == {v: g * 10 for v, g in member.items()}
    assert got[1] == {v: v // 5 * 5 for v in range(30)}
    assert quality(first, got[0]) >= quality(first, plain(first)) - 1e-9
    matrix = spark.createDataFrame([(0, *e) for u, v, w in first for e in ((u, v, w), (v, u, w))], "slide_id long, u long, v long, a double")
    labels = spark.createDataFrame([(0, v, c) for v, c in got[0].items()], "slide_id long, u long, c long")
    assert communities.modularity(matrix, labels).first().q == pytest.approx(quality(first, got[0]))


def test_no_edges(spark):
    assert communities.communities(spark.createDataFrame([], EDGE)).count() == 0


def test_small_slides_take_one_call_and_large_ones_rounds(spark, monkeypatch):
    """Both ways find the same cliques; small slides make no rounds, so their number doesn't tell how many jobs there are."""
    ring = [(s, g * 5 + u, g * 5 + v, 1.0) for s in range(2) for g in range(6) for u, v in itertools.combinations(range(5), 2)]
    ring += [(s, g * 5, (g * 5 + 9) % 30, 1.0) for s in range(2) for g in range(6)] + [(1, 7, 7, 2.0), (None, 1, 2, 1.0)]
    edges = spark.createDataFrame(ring, EDGE)
    rounds = []
    moved = communities._moved
    monkeypatch.setattr(communities, "_moved", lambda *a: rounds.append(1) or moved(*a))
    expected = sorted((s, v, v // 5 * 5) for s in range(2) for v in range(30))
    assert sorted(tuple(r) for r in communities.communities(edges).collect()) == expected
    assert not rounds
    monkeypatch.setattr("tessella.plans.components.WHOLE", 132)
    assert sorted(tuple(r) for r in communities.communities(edges).collect()) == expected
    assert rounds
