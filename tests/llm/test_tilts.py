import math
import random
from collections import defaultdict

import pytest

from hearsay.llm import mixing
from hearsay.llm.queries import QUERIES

from .conftest import COLUMNS


def mixed_rows(seed=4):
    rng = random.Random(seed)
    rows = [(i, "wort " * rng.choice([0, 3, 20, 90, 400]), "en", rng.choice("abcd"), 0) for i in range(600)]
    return rows + [(900 + i, "", "en", "e", 0) for i in range(3)]


def test_op10_tilts_documents_by_their_words(session, tmp_path):
    """Each source has one tilt a word: the logarithms of rates below the cap lie on a line through 0, and targets are met."""
    session.createDataFrame(mixed_rows(), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    per_source = defaultdict(list)
    for r in QUERIES["op10_mixing"](session, str(tmp_path)).collect():
        per_source[r.source].append(r)
    steps = 0
    for source, rows in per_source.items():
        if source == "e":
            assert all(r.rate == 0 for r in rows)
            continue
        total = sum(r.rate * r.size for r in rows)
        assert math.isclose(total, rows[0].target, rel_tol=1e-6)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 0.01 * rows[0].target + 400
        free = {r.size: math.log(r.rate) for r in rows if 0 < r.rate < 2}
        if len(free) > 1:
            slope = free[max(free)] / max(free)
            assert slope != 0 and all(abs(x - slope * n) < 1e-9 for n, x in free.items())
            steps += 1
    assert steps >= 2


@pytest.mark.parametrize("target", [50.0, 700.0, 1_500.0])
def test_newton_finds_the_tilt_a_word(session, target):
    rows = [("s", 1.0, 100, 0.1), ("s", 1.0, 300, 1.0), ("s", 1.0, 400, 5.0)]
    sums = session.createDataFrame(rows, "_source_key string, base double, words bigint, pull double")
    goals = session.createDataFrame([("s", target)], "_source_key string, target double")
    tilt = mixing.solve_tilts(sums, goals).first()["tilt"]
    assert math.isclose(sum(w * min(2.0, b * math.exp(tilt * p)) for _, b, w, p in rows), target, rel_tol=1e-8)
