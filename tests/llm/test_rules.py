"""The rule ledger against plain Python."""

import random
import re
from collections import Counter

import pyarrow as pa

from hearsay.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letters = re.findall("[A-Za-z]", text)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(lines), len(letters), sum(x.isupper() for x in letters), text.count("!"),
        sum(any(x.isascii() and x.isalpha() or not x.isascii() for x in w) for w in words),
    )


def test_measurements():
    rng = random.Random(2)
    parts = ["a", "b", "A ", "é", "\n", " ", "\x0b", " ", "!", "#", "😀", "a b a b a b ", "\n\n", "x y z\n", " ", "\x85"]
    for _ in range(150):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(rng.randint(0, 8))]
        sliced = pa.array(["zz", *texts, "q q"], pa.string())[1:1 + len(texts)]
        found = rules.measure(sliced)
        assert list(found) == list(rules.MEASURES)
        assert [tuple(map(int, r)) for r in zip(*found.values())] == [plain(t) for t in texts]


def test_ledger_of_odd_rows(odd_docs):
    ledger = rules.write_ledger(odd_docs)
    assert ledger.columns == ["doc_id", *rules.MEASURES, "fails"]
    got = sorted((r[0] is not None, r[0] or 0, tuple(r)[1:-1]) for r in ledger.collect())
    assert got == sorted((r[0] is not None, r[0] or 0, plain(r[1])) for r in odd_docs.select("doc_id", "text").collect())
    null = ledger.where("doc_id = 3").first()
    assert null["fails"] == rules.BIT["few_words"] and null["n_words"] == 0


def test_empty_ledger(no_docs):
    ledger = rules.write_ledger(no_docs)
    assert ledger.count() == 0 and rules.masks(ledger).count() == 0 and rules.ablations(ledger).count() == 0
    assert rules.keep(no_docs, ledger).count() == 0


def test_each_rule_fails_where_it_should(session):
    good = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(40)) + "."
    texts = {
        None: good, "few_words": "only five words are here", "repeated_words": "one two three four five " * 4, "symbols": good + " # * $ % &",
        "repeated_lines": "\n".join(["this is the very same line of words"] * 1 + ["so it is"] * 5 + [good]),
        "word_length": " ".join(f"{chr(97 + i)}{i}" for i in range(20)), "no_letters": " ".join(str(1000 + i) for i in range(30)),
        "shouting": good.upper(), "exclamations": " ".join(f"word{i}!" for i in range(20)),
    }
    docs = session.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id bigint, text string")
    fails = {r["doc_id"]: r["fails"] for r in rules.evaluate(docs).collect()}
    for i, name in enumerate(texts):
        if name is None:
            assert fails[i] == 0
        else:
            assert fails[i] & rules.BIT[name], name
    ledger = rules.write_ledger(docs)
    assert {r[0] for r in rules.keep(docs, ledger, 2).select("doc_id").collect()} == {0}
    kept = {r[0] for r in rules.keep(docs, ledger, 1).select("doc_id").collect()}
    assert kept == {i for i, f in fails.items() if not f & rules.mask_of(rules.POLICIES[1])}


def test_ablations_count_what_leaving_a_rule_out_would_keep(session):
    rng = random.Random(5)
    fails = [0 if rng.random() < 0.3 else rng.getrandbits(len(rules.RULES)) & rng.getrandbits(len(rules.RULES)) for _ in range(3_000)]
    ledger = session.createDataFrame([(i, f) for i, f in enumerate(fails)], "doc_id bigint, fails int")
    for version, names in rules.POLICIES.items():
        policy = rules.mask_of(names)
        got = {r["rule"]: tuple(r)[1:] for r in rules.ablations(ledger, version).collect()}
        assert set(got) == set(names)
        for name in names:
            bit = rules.BIT[name]
            assert got[name] == (
                sum(bool(f & bit) for f in fails), sum(f & policy == bit for f in fails),
                sum(not f & policy for f in fails), sum(not f & (policy & ~bit) for f in fails))
    one = rules.summary(ledger).first()
    assert one["n_fails"] == sum(f.bit_count() for f in fails) and one["all_fails"] == 0


def test_bits_are_not_given_twice():
    assert len(set(rules.BIT.values())) == len(rules.RULES) and all(set(p) <= set(rules.BIT) for p in rules.POLICIES.values())
