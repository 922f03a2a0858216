from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, syllables=("the", "on", "er", "tion", "an", "ing")) -> str:
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with a null in every column, empty and very long texts, ties, repeated rows and repeated ids."""
    rng = random.Random(1)
    long_ = prose(rng, 9000)
    text = prose(rng, 60)
    data = [
        (1, text, "en", "a"),
        (1, text, "en", "a"),
        (2, text, "en", None),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, " \n\t ", "fr", "b"),
        (6, long_, "en", "b"),
        (7, "12345 !!! 678", "en", None),
        (8, "Übergröße \U0001f600 naïve", "de", "c"),
        (None, text, None, None),
        (None, prose(rng, 30), "en", "a"),
        (9, prose(rng, 25), "en", "a"),
        (9, prose(rng, 40), "en", "c"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in data], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    """No rows."""
    return odd.where("false")


@pytest.fixture(scope="session")
def clash(odd):
    """Further columns that are named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("fp", "th", "score", "lang_pred", "key", "k", "text_", "size", "s", "place", "stratum", "taken", "length", "kept", "_gone", "_gone_id", "_gone_tie", "_own", "_lines", "_lines_", "_dropped", "_id", "_th", "_spans", "_whole", "_same", "_s", "_key", "block", "shard", "pass", "at", "line", "tie", "h1", "n", "root", "u")
    return odd.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def labels(spark):
    data = [(i, int(i % 3 > 0), 0) for i in range(1, 10)] + [(1, 1, 0), (None, 1, 0), (2, None, None)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def none_labels(labels):
    return labels.where("false")
