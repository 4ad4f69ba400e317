"""Small fixtures of documents with every awkward case, shared by the operator tests."""

import random

import pytest

COLUMNS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score double, label double, "
           "component_id string, kept string, band int, span string, host string")
EN = "the cat sat on the mat and looked at the dog with some interest while rain fell".split()
FR = "le chat est assis sur le tapis et regarde le chien pendant que la pluie tombe très fort".split()


def prose(words, n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice(words) + str(draw.randint(0, 1) or "") for _ in range(n))


def plain(words, n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice(words) for _ in range(n))


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = plain(EN, 60_000, 1)
    rows = [(i, plain(EN if i % 2 else FR, 30 + i, i), "en" if i % 2 else "fr", "s", None) for i in range(1, 41)]
    rows += [(50, None, "en", None, None), (51, "", "en", "s", 0), (52, " \t\n ", "fr", "s", 3), (53, "12 34 !!", "en", "s", 8),
             (None, None, None, None, None), (None, "the cat sat on the mat today", None, None, None),
             (54, long_text, "en", "s", None), (55, long_text, "en", "s", None), (56, long_text + " more", "en", "s", None),
             (57, "one two", "en", "s", 7), (57, "one two", "en", "s", 7), (58, "ONE two", "en", "s", 7),
             (59, rows[0][1], "en", "s", None), (60, "日本語のテキスト 🎉 naïve", None, "s", None)]
    return [(*r, 0.5, 1.0, "x", None, 3, "y", None) for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
