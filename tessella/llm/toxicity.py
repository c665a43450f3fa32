"""Toxicity classifier that is regularised by counterfactuals.

Logistic regression on which words, and which beginnings of words, a text holds. Labelled
texts are paired with copies in which the name of a group is swapped for that of another one;
the squared change of the margin is part of the loss, so that no group's name counts for or
against a text. Texts that name no group are used as well: every few of them get a name put
in, which keeps the label, and are paired with the text that has another name, and none.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import learnable, two_columns
from tessella.llm.linear import Sparse, fitted, labelled_sample, scored, train
from tessella.plans.session import table

DIMENSIONS = 1 << 22
#: Labelled rows that the classifier is fitted on: the first this many by hashed id.
MOST_LABELLED = 8_000
EPOCHS = 10
FLAG_AT = 0.7
#: Swapped copies of each labelled text that names a group, and the weight of their change.
SWAPS, PENALTY = 3, 1.0
#: One in so many labelled texts that name no group is learned with a name put in as well.
PUT_IN_EVERY = 4
WORDS = re.compile(r"\w+")
#: Lengths of the stems of longer words.
STEMS = (4, 6, 8)
#: A high L1 weight leaves the few hundred words that tell; a high rate lets those grow.
L1, RATE = 4.0, 3.0
#: Names of groups that may stand for one another, by kind (fixed values).
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "old", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("behinderte", "blinde", "gehörlose", "alte", "junge"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("handicapés", "aveugles", "sourds", "vieux", "jeunes"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("gais", "lesbianas", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "autóctonos"),
    ("discapacitados", "ciegos", "sordos", "viejos", "jóvenes"),
)


def slot(word: str) -> int:
    """The hashed dimension of a word; 0 is the bias."""
    return 1 + xxhash.xxh3_64_intdigest(word) % (DIMENSIONS - 1)


def vocabulary(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def with_stems(words: set[str]) -> set[str]:
    """The words and, of longer ones, their first letters, so that inflected forms count too."""
    return words.union(*({f"^{w[:n]}" for w in words if len(w) > n} for n in STEMS))


def row_of(words: set[str]) -> Sparse:
    at = np.unique(np.array([0, *map(slot, with_stems(words))], np.int64))
    return at, np.ones(len(at))


def features(text: str) -> Sparse:
    """Presence of each word and stem of the whole text, and the bias."""
    return row_of(vocabulary(text))


def swapped(words: set[str], swaps: int = SWAPS) -> list[set[str]]:
    """Copies of a text's words in which each group's name gives way to the next of its kind."""
    named = [(kind, term) for kind in IDENTITY_TERMS for term in kind if term in words]
    out = []
    for shift in range(1, swaps + 1 if named else 1):
        other = {term: kind[(kind.index(term) + shift) % len(kind)] for kind, term in named}
        copy = {other.get(w, w) for w in words}
        if copy != words:
            out.append(copy)
    return out


def counterfactuals(words: list[set[str]], every: int = PUT_IN_EVERY) -> list[tuple[int, set[str], list[set[str]]]]:
    """Texts to learn from, by the row that they come from, each with its copies."""
    out = []
    plain = 0
    for row, own in enumerate(words):
        copies = swapped(own)
        out.append((row, own, copies))
        if copies:
            continue
        plain += 1
        if plain % every == 0:
            turn, kind = divmod(plain // every, len(IDENTITY_TERMS))
            named = own | {IDENTITY_TERMS[kind][turn % len(IDENTITY_TERMS[kind])]}
            out.append((row, named, [*swapped(named, 1), own]))
    return out


def fit(rows: list[tuple[str, int]], penalty: float = PENALTY, epochs: int = EPOCHS) -> Sparse:
    """Weights learned with ``penalty``, or without counterfactuals if it is zero."""
    words = [vocabulary(t) for t, _ in rows]
    learned = counterfactuals(words) if penalty else [(i, w, []) for i, w in enumerate(words)]
    examples = [(row_of(w), rows[i][1]) for i, w, _ in learned]
    twins = [[row_of(c) for c in copies] for _, _, copies in learned]
    return train(examples, twins, DIMENSIONS, epochs, penalty=penalty, alpha=RATE, l1=L1, l2=0.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Learns from labelled rows whose crc32 of the id isn't 1 modulo 3, at most
    ``MOST_LABELLED`` of them; only the text is an input of a score. Empty and null texts get
    the score of a text without words. Labels that are null or not 0 or 1 are skipped, and of
    an id's several labels the highest holds. Without labels every score is one half. Repeated
    ids are scored row by row. An empty table gives an empty result.
    """
    rows = two_columns(docs, id_col, text_col)
    weights = fitted(labelled_sample(rows, labels, "toxic", 3, 1, MOST_LABELLED), fit)
    out = scored(rows, weights, features)
    return out.select("doc_id", (~learnable(F.col("doc_id"), 3, 1)).alias("held_out"), "score", (F.col("score") >= FLAG_AT).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
