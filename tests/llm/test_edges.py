"""Every operator and stage on odd and on empty tables."""

import pytest

import corpus_pipeline
from hearsay.llm import decontaminate, licenses, lm_scoring, mixing, packing, pii, quality, simhash, toxicity, winnowing

ITEMS = "item_id bigint, text string"


@pytest.fixture(scope="module")
def labels(session):
    rows = [(1, 1, 0), (2, 0, 1), (4, 0, 1), (7, 1, 0), (None, 1, 1), (5, None, None), (6, 3, 3), (1, 1, 0)]
    return session.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(session):
    return session.createDataFrame([(1, "ab"), (2, None), (None, "x" * 60), (3, ""), (4, "no such passage anywhere " * 3), (4, "no such passage anywhere " * 3)], ITEMS)


def per_row(docs, labels, items):
    return {
        "quality": quality.score_quality(docs, quality.train_quality(docs, labels)),
        "winnowing": winnowing.fingerprint_documents(docs),
        "lm": lm_scoring.score_documents(docs),
        "simhash": simhash.near_groups(docs),
        "packing": packing.packed_tokens(docs),
        "toxicity": toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)),
        "pii": pii.find_personal_data(docs, pii.train_tagger(docs, steps=3)),
        "licenses": licenses.scan_licenses(docs, id="doc_id", path="source", text="text").withColumnRenamed("id", "doc_id"),
    }


def test_one_row_per_row(odd_docs, labels, items):
    ids = sorted(str(r[0]) for r in odd_docs.select("doc_id").collect())
    for name, result in per_row(odd_docs, labels, items).items():
        assert sorted(str(r["doc_id"]) for r in result.collect()) == ids, name


def test_empty_tables(no_docs, labels, items, session):
    none = session.createDataFrame([], labels.schema)
    for name, result in per_row(no_docs, none, items).items():
        assert result.count() == 0, name
    assert decontaminate.find_passages(no_docs, items).count() == 0
    assert decontaminate.find_passages(no_docs, session.createDataFrame([], ITEMS)).count() == 0
    assert mixing.mix_copies(no_docs).count() == 0


def test_without_labels_the_score_is_the_base_rate(odd_docs, labels):
    none = labels.where("doc_id < 0")
    assert {r[1] for r in quality.score_quality(odd_docs, quality.train_quality(odd_docs, none)).collect()} == {0.5}
    assert {r[1] for r in toxicity.score_toxicity(odd_docs, toxicity.train_toxicity(odd_docs, none)).collect()} == {0.5}


def test_stages_keep_the_columns(odd_docs, no_docs, labels, items, tmp_path, session):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_docs, no_docs):
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        stored = session.read.parquet(str(tmp_path / "documents.parquet"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(session, stored, str(tmp_path))
            assert out.columns == stored.columns, name
            assert out.exceptAll(stored.unionAll(stored)).count() == 0, name
        last = corpus_pipeline.STAGES[-1][1](session, stored, str(tmp_path))
        assert last.count() == stored.count()
    assert corpus_pipeline.run(session, str(tmp_path)).count() == 0


def test_repeated_and_nameless_rows(odd_docs):
    kept = simhash.first_of_groups(odd_docs).collect()
    ids = [r["doc_id"] for r in kept]
    # 1 and 2 say the same; 3, 4 and 6 have no words; null ids are met by others.
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 7, 8, (1 << 60) + 1] and None not in ids
    assert [r["text"] for r in kept if r["doc_id"] == 1] == ["The cat sat on the mat"]


def test_equal_rows_are_mixed_alike(odd_docs):
    rows = {(r["_id"], r["size"]): r for r in mixing.mix_copies(odd_docs).collect()}
    assert rows[(1, 6)]["_same"] == 2 and rows[(3, 0)]["size"] == 0 and rows[(None, 6)]["_source"] is None
    assert all(0 <= r["copies"] <= 2 for r in rows.values())
