import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fingerprint string, score int"


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '', '.', ','])}" for _ in range(words))


def row(doc, text, lang="en"):
    """A document with columns whose names some operators use themselves."""
    return (doc, text, lang, "s", None if text is None else len(text), 7, "x", None)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, lines and white space of all kinds."""
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [None, "", " \n\t", "one", "Two Words", base, base, base.replace("w1", "v1"), prose(rng, 60000), "é ü\x0bß\x1fx", "a" * 50000]
    texts += ["shared line of text\n" + prose(rng, 20) for _ in range(6)] + [prose(rng, rng.randint(1, 300)) for _ in range(25)]
    rows = [row(i, t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (5, "another text under the same id", None, None, None, None, None, None), (None,) * 8, row(None, base), row(None, base)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
