"""Small documents with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, fp long, drop string, key string"
WORDS = "the of and to in river stone garden window market winter summer teacher letter bridge forest silver copper yellow purple".split()
PASSAGE = "shared passage of a benchmark that stands in several documents word for word and is long enough to count as one item here"


def text(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def rows():
    base = [text(i) for i in range(30)]
    out = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}") for i, t in enumerate(base)]
    out += [(100 + i, base[0], "en", "hot") for i in range(25)]  # copies
    out += [(200 + i, base[1].replace(" ", "  ", 1) + " tail" * (i % 2), "en", "hot") for i in range(6)]
    out += [(300, None, "en", None), (301, "", None, "s1"), (302, " \n\t ", "fr", "s1"), (303, "12 34 !!", "en", "s2"), (None, base[2], None, None), (None, None, None, None)]
    out += [(5, base[5], "fr", "s2"), (5, base[6], "fr", "s2")]  # a repeated row, and a repeated id
    out += [(400, " ".join(base) * 12, "en", "s0"), (401, "x" * 30_000, "en", "s0")]  # very long
    line = "This line is shared by MANY documents here"
    out += [(500 + i, f"{text(900 + i, 60)}\n  {line if i % 2 else line.upper()}\t\nshort\n\n{line}", "en", "s1") for i in range(5)]
    out += [(600 + i, f"{text(950 + i, 40)} {PASSAGE} {text(970 + i, 40)}", "en", "s1") for i in range(3)]
    out += [(700, "a b", "en", "s0"), (701, "A  B", "en", "s0"), (702, "ünïcødé straße ñandú ЖИВОТ 漢字 " * 20, "de", "s0")]
    return out


def frame(spark):
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 0.5, "r", 1, "d", "k") for i, t, g, s in rows()], SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
