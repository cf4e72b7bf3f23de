"""Small document tables with the awkward rows every operator must take."""

import random

import pytest

WORDS = [f"w{k}" for k in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(12)]
    passage = prose(rng, 90)
    near = []
    for b in base[:4]:
        for _ in range(3):
            w = b.split()
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = "edit"
            near.append(" ".join(w))
    shared = [f"{prose(rng, 40)} {passage} {prose(rng, 40)}" for _ in range(5)]
    short = ["one two", "One  TWO", "a b c d e f", "a b c d e f g", "", "   ", "x" * 900, "ab" * 500, "é" * 450, base[0], base[0]]
    return [*base, *near, *shared, *short, None, prose(rng, 30_000)]


@pytest.fixture(scope="session")
def documents(spark, texts):
    """Rows with a null id, a repeated row, and extra columns whose names clash with the operators' own."""
    rows = [(k, t, "en", None if k % 7 == 3 else f"s{k % 3}", 0, "x", k, k) for k, t in enumerate(texts)]
    rows += [rows[2], (None, texts[1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, key long, id long"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
