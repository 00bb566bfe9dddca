"""The Merkle manifest against a tree made in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hearsay.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """(root, [[(before, after)]]) of nodes, level by level."""
    proofs, at, f = [[] for _ in nodes], list(range(len(nodes))), merkle.FANOUT
    while len(nodes) > 1:
        for i, p in enumerate(at):
            start = p // f * f
            proofs[i].append(("".join(nodes[start:p]), "".join(nodes[p + 1:start + f])))
            at[i] = p // f
        nodes = [digest(*nodes[i:i + f]) for i in range(0, len(nodes), f)]
    return nodes[0], proofs


def expected(rows):
    """Every row's (id, leaf, subroot, root, proof digest, folded root), sorted."""
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append((row[0], digest(*map(field, row)), row))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: tree([r[1] for r in by[s]]) for s in order}
    root, above = tree([trees[s][0] for s in order])
    out = []
    for s, upper in zip(order, above):
        for (id, leaf, row), lower in zip(by[s], trees[s][1]):
            node = leaf
            if id is not None and id % 5 == 0 and row[4] is not None:
                node = digest(*map(field, (*row[:4], row[4].replace("A", "a"))))
            for before, after in lower + upper:
                node = digest(before, node, after)
            out.append((id, leaf, trees[s][0], root, digest(*[b + a for b, a in lower + upper]), node))
    return sorted(map(str, out))


def found(docs):
    tampered = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    leaves = merkle.tampered_leaves(docs, tampered, F.replace("text", F.lit("A"), F.lit("a")))
    rows = merkle.verify(merkle.manifest(leaves)).collect()
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in rows)
    return sorted(str(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"))) for r in rows)


COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("height", [1, 2])
def test_sources_of_many_sizes(session, monkeypatch, height):
    """One source with over a third of the rows; others at the edges of runs and blocks; repeated rows and nulls."""
    monkeypatch.setattr(merkle, "FANOUT", 3)
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rng, rows = random.Random(height), []
    for s, n in enumerate([1, 2, 3, 4, 9, 10, 27, 28, 82, 1]):
        rows += [(rng.randint(0, 10_000), f"s{s}é", "en", i, f"A text {i}") for i in range(n)]
    rows += [(i, None, None, None, None) for i in range(5)] + [(None, "s5é", "en", 1, "A"), (None, None, "de", 1, "")]
    rows += [(i, "hot", "en", 4, "An A") for i in range(200)] + [(7, "hot", "en", 4, "again A")] * 20
    rng.shuffle(rows)
    docs = session.createDataFrame(rows, COLUMNS).selectExpr("*", "'own' as leaf", "'own' as _id", "'own' as root", "'own' as _rank").repartition(6)
    assert found(docs) == expected(rows)


def test_odd_documents(odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert found(odd_docs) == expected(rows)


def test_one_row_and_none(session, no_docs):
    one = session.createDataFrame([(4, "a", "en", 2, "Hi")], COLUMNS)
    leaf = digest(*map(field, (4, "a", "en", 2, "Hi")))
    assert found(one) == [str((4, leaf, leaf, leaf, digest(), leaf))]
    assert found(no_docs) == []


def test_tampering_is_seen_in_its_row_only(session):
    rows = [(i, f"s{i % 3}", "en", 1, "A" if i % 2 else "b") for i in range(100)]
    leaves = merkle.tampered_leaves(session.createDataFrame(rows, COLUMNS), F.col("doc_id") % 10 == 5, F.lower("text"))
    seen = {r["doc_id"] for r in merkle.verify(merkle.manifest(leaves)).where("not verified").collect()}
    assert seen == {i for i in range(100) if i % 10 == 5}


def test_each_node_sends_a_bounded_number_of_rows(session):
    """However the last part falls short, a round sends at most twice as many rows as there are nodes."""
    for n in (1, 2, 16, 17, 33, 256, 257, 300, 4_097):
        nodes = session.range(n).select(F.lit("g").alias("g"), F.col("id").alias("place"), F.lit(n).cast("bigint").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
        rows = merkle.exchange(nodes, "g").collect()
        top, proofs = tree([digest(str(i)) for i in range(n)])
        assert {(r["place"], r["top"], tuple((s["before"], s["after"]) for s in r["siblings"])) for r in rows} == {
            (i, top, tuple(p)) for i, p in enumerate(proofs)}
