"""Classifiers on their held-out labels, and the registered queries on the small tables."""

import numpy as np
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.01"
HELD_OUT = {"op1_quality": ("quality", 0.95), "op6_toxicity": ("toxic", 0.95)}


def area(labels, scores):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    ones = labels == 1
    return (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize("name", list(HELD_OUT))
def test_held_out_labels(session, name):
    label, least = HELD_OUT[name]
    labels = session.read.parquet(f"{FOLDER}/labels.parquet")
    rows = contract.queries()[name](session, FOLDER).join(labels, "doc_id").where("held_out").collect()
    y, score = np.array([r[label] for r in rows]), np.array([r["score"] for r in rows])
    assert area(y, score) >= least
    assert np.mean(np.array([r["predicted"] for r in rows]) == y) >= 0.9


def test_every_operator_is_registered():
    names = contract.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
