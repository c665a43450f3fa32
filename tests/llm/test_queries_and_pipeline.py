import pytest

import corpus_pipeline
from tessella.llm import queries
from tests.llm import data
from tests.llm.test_decontaminate import brute_force as leaks
from tests.llm.test_near_dedup import plain_fingerprint
from tests.oracle import same

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(name, spark):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, SF)


def plain_pipeline(rows, items):
    """What every stage but the last keeps, by brute force: ``(doc_id, text)`` and the rest."""
    from tests.llm.test_lines_and_rules import key_of

    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    holders = {}
    number = lambda i: -(1 << 63) if i is None else i
    for i, t, *_ in rows:
        for line in t.split("\n"):
            holders.setdefault(key_of(line), set()).add(number(i))
    bad = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    rows = [(i, "\n".join(x for x in t.split("\n") if bad.get(key_of(x), number(i)) == number(i)), g, s) for i, t, g, s in rows]
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    first = {}
    for a, r in enumerate(rows):
        rank = (r[0] is None, r[0] or 0)
        if find(a) not in first or rank < first[find(a)][0]:
            first[find(a)] = (rank, r)
    rows = [r for _, r in first.values()]
    found = {i for i, _ in leaks(rows, items)}
    return [r for r in rows if r[0] not in found]


def test_pipeline_equals_brute_force(spark, tmp_path):
    items = [(1, data.PASSAGE)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = data.rows()
    spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        docs = out
    expected = plain_pipeline(rows, items)
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(((i, t) for i, t, *_ in expected), key=str)
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in last) == sorted(str(r[0]) for r in expected)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_decides_by_score(spark):
    """Foreign scripts and noise go, short texts stay, and the language told is carried on."""
    import random

    rng = random.Random(3)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    noise = ["".join(chr(0x4E00 + rng.randrange(500)) for _ in range(300)), " ".join("".join(rng.choice("qxzwkjvbp0123456789") for _ in range(7)) for _ in range(60))]
    more = spark.createDataFrame([(90_000 + i, t, None, None, len(t or "")) for i, t in enumerate([*noise, "ok", None])], docs.schema)
    kept = {r.doc_id: r for r in corpus_pipeline.language_id(spark, docs.unionByName(more), LARGER).collect()}
    assert not {90_000, 90_001, 90_003} & set(kept) and 90_002 in kept
    before = docs.where(r"text rlike '\\p{L}'").collect()
    assert all(r.doc_id in kept for r in before)
    told = [kept[r.doc_id].lang == r.lang for r in before if r.lang]
    assert sum(told) / len(told) > 0.98 and all(r.lang for r in kept.values())


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]
