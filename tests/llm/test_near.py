import random

import corpus_pipeline
from hearsay.llm import shingles

from .conftest import COLUMNS, words


def plain_sets(text):
    found = tuple(text.lower().split())
    return {found[i:i + 5] for i in range(len(found) - 4)} if len(found) > 4 else {found} - {()}


def test_stage_leaves_no_near_copies(session):
    """By brute force over all pairs; edited copies are beyond three bits but above 0.8."""
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        base = words(rng, rng.randint(60, 200)).split()
        texts.append(" ".join(base))
        for edits in range(1, 5):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(len(other))] = f"edit{rng.random()}"
            texts.append(" ".join(other))
    texts += ["a b c d e f g h i j", "A b  c d e f g h i j", "one two", "One\ttwo"]
    docs = session.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], COLUMNS)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(session, docs, "").collect())
    sets = [plain_sets(t) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert not [(i, j) for i in kept for j in kept if i < j and alike(i, j)]
    assert all(5 * i in kept for i in range(60)) and {300, 302} <= set(kept)


def test_chains_and_hot_keys_are_linked(session):
    """A chain of texts, each above 0.8 only to its neighbours, is one group; its ends are not alike."""
    rng = random.Random(3)
    run = [f"w{i}" for i in range(400)]
    texts = [" ".join(run[i * 8:i * 8 + 120]) for i in range(12)]
    order = list(range(12))
    rng.shuffle(order)
    docs = session.createDataFrame([(i, texts[k], "en", "a", 1) for i, k in enumerate(order)], COLUMNS)
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(session, docs, "").collect()] == [0]


def test_least_values_of_long_sets_come_in_pieces():
    import numpy as np

    hashes = shingles.shingle_set(shingles.words_of(words(random.Random(1), 2_000)))
    whole = (hashes[None, :] * shingles._TIMES[:, None] + shingles._PLUS[:, None]).min(axis=1)
    first = shingles.xxhash.xxh64_intdigest(whole[:shingles.ROWS].tobytes(), 0)
    assert np.frombuffer(shingles.band_keys(hashes), dtype=np.uint64)[0] == first
