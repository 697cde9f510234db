"""Helpers of the training-data tests; the session comes from the tests' own conftest."""

from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


@pytest.fixture(scope="session")
def prose():
    """Seeded invented texts with exact and near copies, short, empty, null and long ones."""
    rng = random.Random(5)
    sentence = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "x", "ed"]) for _ in range(n))
    rows: list[tuple[int | None, str | None]] = []
    for i in range(60):
        rows.append((i, "\n".join(sentence(rng.randint(3, 25)) for _ in range(rng.randint(1, 8)))))
    for i in range(60, 100):
        words = rows[i % 20][1].split(" ")
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "One"), (104, "one"), (105, "é" * 300), (106, sentence(4000))]
    rows += [(107, rows[3][1].upper()), (103, "One"), (None, sentence(30)), (108, "x" * 700)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, prose):
    """The texts as a table whose other columns carry names that operators use inside."""
    rows = [(i, t, "en", float(k), k) for k, (i, t) in enumerate(prose)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, th string, key double, id long")
    return frame.repartition(3)
