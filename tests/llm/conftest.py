import random

import pytest

from hearsay.llm.common import ready

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = "an the ing er on re st ti nd ha ea ou es le ver sch ung keit pa de la ción ör".split()


@pytest.fixture(scope="session")
def session(spark):
    return ready(spark)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(session):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns of clashing names."""
    rng = random.Random(4)
    long = words(rng, 30_000)
    rows = [
        (1, "The cat sat on the mat", "en", "a", 22), (1, "The cat sat on the mat", "en", "a", 22),
        (2, "the CAT\tsat on\nthe mat", "en", "a", 22), (3, None, None, None, None), (4, "", "en", "b", 0),
        (None, "the cat sat on the mat", "en", None, 22), (None, None, None, "a", None), (5, long, "en", "b", len(long)),
        (6, " \n ", "en", "c", 3), (7, "x", "en", "c", 1), ((1 << 60) + 1, "mail me@a.example 1.2.3.4", "en", "a", 25),
        (8, "Ünï \U0001f600 ñandú " * 7, "es", "é", 98), (1, "another text of one id", "en", "a", 22),
    ]
    table = session.createDataFrame(rows, COLUMNS)
    for name in ("_id", "_text", "_row", "_key", "_chunk", "_copy", "_place", "_hash", "score", "fp", "size", "key", "copies", "rate"):
        table = table.selectExpr("*", f"'own' as {name}")
    return table


@pytest.fixture(scope="session")
def no_docs(session):
    return session.createDataFrame([], COLUMNS)
