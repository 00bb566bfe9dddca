from hearsay.llm import mixing

from .conftest import COLUMNS


def test_a_repeated_row_meets_its_target(session):
    """One row repeated 3,000 times is a third and more of its source; its copies are counted, not all alike."""
    rows = [(7, "ten words of one text " * 2, "en", "a", 40)] * 3_000
    rows += [(100 + i, f"text number {i} of the same source", "en", "a", 30) for i in range(1_500)]
    rows += [(9_000 + i, f"other source {i}", "en", "b", 15) for i in range(4_000)]
    docs = session.createDataFrame(rows, COLUMNS).repartition(7)
    got = [r for r in mixing.mix_copies(docs).collect() if r["_source"] == "a"]
    taken = sum((r["copies"] * r["_same"] + r["_more"]) * r["size"] for r in got)
    assert abs(taken - got[0]["target"]) <= 10
    hot = next(r for r in got if r["_id"] == 7)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.where("doc_id = 7").count() == hot["copies"] * 3_000 + hot["_more"] and 0 < hot["_more"] < 3_000
    assert mixed.where("source = 'a'").count() == sum(r["copies"] * r["_same"] + r["_more"] for r in got)
