"""Operators on single texts and small corpora against plain versions of the same rule."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hearsay.llm import decontaminate, licenses, lm_scoring, mixing, packing, pii, simhash, winnowing
from hearsay.llm.common import ready

from .conftest import COLUMNS, words


def corpus(rng, n, least=0, most=60):
    return [(i, words(rng, rng.randint(least, most)), "en", f"s{i % 3}", 0) for i in range(n)]


# --- winnowing -----------------------------------------------------------------------------

def plain_winnow(text, k=winnowing.K, window=winnowing.WINDOW):
    hashes = [int(h) for h in winnowing.gram_hashes(winnowing.code_points(text), k)]
    if not hashes:
        return []
    kept = []
    for a in range(max(1, len(hashes) - window + 1)):
        run = hashes[a:a + window]
        least = max(i for i, h in enumerate(run) if h == min(run)) + a
        if not kept or kept[-1][1] != least:
            kept.append((hashes[least], least))
    return kept


def test_winnowing_rule_and_guarantee():
    rng = random.Random(1)
    for text in ["", "a", "ab" * 40, "a" * 100, words(rng, 3), words(rng, 200), "é\U0001f600" * 50]:
        hashes, positions = winnowing.winnow(winnowing.code_points(text))
        assert list(zip(hashes.tolist(), positions.tolist())) == plain_winnow(text)
        again = winnowing.from_text(winnowing.to_text(hashes, positions))
        assert (again[0] == hashes).all() and (again[1] == positions).all()
    shared = words(rng, 30)[:winnowing.K + winnowing.WINDOW - 1]
    for _ in range(50):
        a, b = (words(rng, 20) + " " + shared + " " + words(rng, 20) for _ in range(2))
        one, two = (set(winnowing.winnow(winnowing.code_points(t))[0].tolist()) for t in (a, b))
        assert one & two


def test_winnowing_documents(session, monkeypatch):
    rng = random.Random(2)
    rows = [(i * 7 % 101, words(rng, rng.randint(0, 40)), "en", "s", 0) for i in range(101)]
    docs = session.createDataFrame(rows, COLUMNS).repartition(5)
    monkeypatch.setattr(winnowing, "ordered_chunks", lambda r: winnowing_chunks(r, 10))
    got = {r["doc_id"]: r for r in winnowing.fingerprint_documents(docs).collect()}
    assert len(got) == 101
    texts = [t for _, t, *_ in sorted(rows)]
    prints = [{h for h, _ in plain_winnow(t)} for t in texts]
    for i, text in enumerate(texts):
        half, following = len(text) // 2, (i + 1) % 101
        edited = text[:len(text) - half] + texts[following][:half]
        row = got[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        changed = {h for h, _ in plain_winnow(edited)}
        jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert math.isclose(row["near_edited"], jaccard(prints[i], changed))
        assert math.isclose(row["near_next"], jaccard(prints[i], prints[following]))


winnowing_chunks = winnowing.ordered_chunks


# --- language model ------------------------------------------------------------------------

def plain_scores(texts, order, leave_out, backoff=lm_scoring.BACKOFF):
    split = [lm_scoring.words_of(t) for t in texts]
    grams = [Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in split]
    total, size, out = sum(grams, Counter()), sum(map(len, split)), []
    for w, own in zip(split, grams):
        own = own if leave_out else Counter()
        rest, score = size - (len(w) if leave_out else 0), 0.0
        for k in range(len(w)):
            factor = 1.0
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(w[k - n + 1:k + 1])
                if total[gram] > own[gram]:
                    under = total[gram[:-1]] - own[gram[:-1]] if n > 1 else max(rest, 1)
                    score += math.log(factor * (total[gram] - own[gram]) / under)
                    break
                factor *= backoff if n > 1 else 1.0
            else:
                score += math.log(factor / (rest + 1))
        out.append(score)
    return out


def test_stupid_backoff(session, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BUCKET_ENTRIES", 100)  # many buckets
    rng = random.Random(3)
    rows = corpus(rng, 60, most=40) + [(60, "a b a b", "en", "s", 0), (61, "", "en", "s", 0), (62, "A B", "en", "s", 0)]
    docs = session.createDataFrame(rows, COLUMNS).repartition(6)
    for order in (1, 2, 3):
        for leave_out in (True, False):
            got = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, order, leave_out=leave_out).collect()}
            for (i, *_), score in zip(rows, plain_scores([r[1] for r in rows], order, leave_out)):
                assert math.isclose(got[i]["log_score"], score, abs_tol=1e-6), (order, leave_out, i)


def test_blocks_do_not_follow_arrow_batches(session):
    rng = random.Random(12)
    rows = corpus(rng, 200, most=40)
    docs = session.createDataFrame(rows, COLUMNS).repartition(2).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        blocks, small = (
            docs.mapInArrow(lm_scoring._blocks(most), lm_scoring._BLOCKS).collect() for most in (lm_scoring.BLOCK_BYTES, 5_000))
    finally:
        ready(session)
    assert len(blocks) == 2 and len(small) > 4 and len({r["block"] for r in small}) == len(small)
    for found in (blocks, small):
        assert sorted(d for r in found for d in r["doc_ids"]) == sorted(r[0] for r in rows)


def test_keys_and_numbers_travel_whole():
    rng = np.random.default_rng(2)
    hashes = np.sort(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    for buckets in (1, 3, 97, 70_000):
        of = lm_scoring.bucket_of(hashes, buckets)
        keys = lm_scoring.keys_in(hashes, of, buckets)
        assert len(set(zip(of.tolist(), keys.tolist()))) == len(hashes)
        assert int(keys.max()) < 1 << 49 and (np.diff(keys.astype(np.int64))[np.diff(of) == 0] > 0).all()
    first = lm_scoring.keys_in(hashes, np.zeros(20_000, np.int64), 1)
    assert (np.cumsum(lm_scoring.unsqueeze(lm_scoring.squeeze(np.diff(first, prepend=np.uint64(0)))), dtype=np.uint64) == first).all()
    assert len(lm_scoring.squeeze(np.diff(first, prepend=np.uint64(0)))) < 5.5 * len(first)
    for numbers in (np.zeros(0, np.int64), np.arange(9), np.array([0, 1, 1 << 40])):
        assert (lm_scoring.unsqueeze(lm_scoring.squeeze(numbers)) == numbers).all()


# --- simhash -------------------------------------------------------------------------------

def plain_simhash(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(found[i:i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_simhash_prints():
    rng = random.Random(5)
    for text in ["", " \n", "One", "one TWO", "a b c", "É\xa0x\x1cy z", words(rng, 50), words(rng, 5) + "\t" + words(rng, 70)]:
        assert simhash.simhash(text) == plain_simhash(text)
    assert simhash.simhash(None) == 0


def test_simhash_links_find_every_component(session):
    rng, values = random.Random(6), set()
    for _ in range(120):
        centre = rng.getrandbits(64)
        values.add(centre)
        for _ in range(rng.choice([0, 1, 5, 40])):
            flips = rng.sample(range(64), rng.randint(1, 4)) if rng.random() < 0.5 else [b + 16 * rng.randrange(4) for b in [*rng.sample(range(16), 3)]]
            values.add(centre ^ sum(1 << b for b in set(flips)))
        block = rng.randrange(4) * 16  # three bits of one block
        values.add(centre ^ sum(1 << (block + b) for b in rng.sample(range(16), 3)))
    values = sorted(values)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    links = simhash.near_links(session.createDataFrame([(v,) for v in signed], "fp bigint")).collect()
    got, place = list(range(len(values))), {v: i for i, v in enumerate(signed)}

    def head(i):
        while got[i] != i:
            i = got[i]
        return i

    for r in links:
        assert ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 3
        a, b = head(place[r["a"]]), head(place[r["b"]])
        got[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(values))] == [head(i) for i in range(len(values))]


def test_simhash_groups(session):
    rng = random.Random(7)
    base = words(rng, 400).replace("ö", "o").replace("ó", "o")
    rows = [(10, base), (3, base.upper()), (7, base + " end"), (4, words(rng, 300)), (5, None), (2, ""), (9, words(rng, 100))]
    docs = session.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert got[10] == got[3] == 3 and got[5] == got[2] == 2 and got[4] == 4 and got[9] == 9
    near = (plain_simhash(base) ^ plain_simhash(base + " end")).bit_count() <= 3
    assert (got[7] == 3) == near


# --- packing -------------------------------------------------------------------------------

def test_bits_round_trip():
    source = np.random.default_rng(1)
    for width in (1, 3, 9, 16, 17, 32):
        ids = source.integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
        packed = packing.pack(ids, width)
        assert len(packed) == -(-1001 * width // 8)
        assert (packing.unpack(packed, width, 0, 1001) == ids).all()
        assert (packing.unpack(packed, width, 77, 500) == ids[77:577]).all()
    assert packing.width_of(49_408) == 16 and packing.width_of(1) == 1 and packing.width_of(65_537) == 17


def test_packed_documents(session, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_IDS", 300)
    monkeypatch.setattr(packing, "PIECE_STORE", 20)
    monkeypatch.setattr(packing, "SLICE_BYTES", 500)
    rng = random.Random(8)
    odd = ["a\x1cb c\xa0d e's İSTANBUL ΑΣ <|endoftext|>x", "x́ ́y a​b 你好 12 3", "a\x01b \x01 c", "don't THEY'RE"]
    texts = [words(rng, rng.randint(0, 90)) for _ in range(90)] + odd + ["", None]
    rows = [(i * 11 % 97, t) for i, t in enumerate(texts)]
    docs = session.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    monkeypatch.setattr(packing, "ordered_chunks", lambda r: winnowing_chunks(r, 9))
    path = packing.write_packed(docs, packing.fresh_path(session, "packed"))
    blocks = packing.read_blocks(session, path)
    assert blocks.count() > 10
    encoder = packing.WordEncoder(packing.tokenizer_file()).tokenizer
    start = 0
    got = {r["doc_id"]: r for r in packing.read_documents(blocks).collect()}
    for i, text in sorted(rows):
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [1]
        row = got[i]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_blocks_are_not_shuffled_to_find_their_place(session):
    before = session.conf.get("spark.sql.autoBroadcastJoinThreshold")
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = session.createDataFrame([(i, "the cat sat") for i in range(50)], "doc_id bigint, text string")
        blocks = packing.read_blocks(session, packing.write_packed(docs, packing.fresh_path(session, "packed")))
        assert "SortMergeJoin [chunk" not in blocks._jdf.queryExecution().executedPlan().toString()
    finally:
        session.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_plain_words_go_to_the_model_alone():
    content = packing.tokenizer_file()
    encoder = packing.WordEncoder(content)
    library = encoder.tokenizer
    assert packing.WordEncoder(content).tokenizer is library  # loaded once per worker
    rng = random.Random(13)
    plain = [" ".join("".join(rng.choices(packing.LOWER[:most], k=rng.randint(1, 9))) for _ in range(3_000)) for most in (26, None)]
    asked, batch = [], encoder._batch
    encoder._batch = lambda text, kind="": (asked.append((kind, text)), batch(text, kind))[1]
    for text, ids in zip(plain, encoder.encode(plain)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    alone = sum(len(t) for kind, t in asked if kind in ("ascii", "latin"))
    assert sum(len(t) for kind, t in asked) - alone < alone / 2 and alone > 20_000
    letters = packing.LOWER + packing.UPPER + " " * 20 + ".,!?;:'" * 3 + "×÷\u0301\u0300İſŒł09-#ªºµ"
    odd = ["".join(rng.choices(letters, k=80)) for _ in range(300)]
    for text, ids in zip(odd, encoder.encode(odd)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_holds_little_of_a_long_batch():
    texts = [" ".join(f"w{i % 500} and,so" for i in range(9_000))] * 32
    encoder = packing.WordEncoder(packing.tokenizer_file())
    tracemalloc.start()
    try:
        assert len({ids.tobytes() for ids in encoder.encode(texts)}) == 1
        assert tracemalloc.get_traced_memory()[1] < 12 * len(texts) * len(texts[0])
    finally:
        tracemalloc.stop()


# --- decontamination -----------------------------------------------------------------------

def test_edit_distance():
    rng = random.Random(9)
    for _ in range(150):
        pattern = "".join(rng.choices("abc", k=rng.randint(1, 70)))
        text = "".join(rng.choices("abc", k=rng.randint(0, 90)))
        row = [0] * (len(text) + 1)
        for i, c in enumerate(pattern, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        assert decontaminate.best_end(pattern, text)[0] == min(row)


def test_planted_passages(session):
    rng = random.Random(10)
    items = [(i, words(rng, rng.randint(10, 60))) for i in range(40)]
    rows, planted = [], set()
    for i in range(240):
        text = words(rng, rng.randint(30, 200))
        if i % 2:
            of, item = items[rng.randrange(40)]
            passage = list(item)
            for _ in range(rng.randint(0, decontaminate.edits_allowed(len(item)))):
                place = rng.randrange(len(passage))
                kind = rng.randrange(3)
                passage[place:place + (kind != 1)] = [] if kind == 2 else [rng.choice("aeiou xyz")]
            at = rng.randrange(len(text))
            text = text[:at] + " ".join("".join(passage).split(" ")) + text[at:]
            planted.add((i, of))
        rows.append((i, text.upper() if i % 6 == 1 else text))
    docs = session.createDataFrame(rows, "doc_id bigint, text string")
    bench = session.createDataFrame(items, "item_id bigint, text string")
    hits = decontaminate.find_passages(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in hits}
    assert found <= planted and len(found) >= 0.98 * len(planted)
    by_id, of = dict(rows), dict(items)
    for r in hits:
        item, part = of[r["item_id"]].lower(), by_id[r["doc_id"]].lower()[r["start"]:r["end"]]
        assert r["edits"] <= decontaminate.edits_allowed(len(item))
        assert decontaminate.best_end(item, part)[0] == r["edits"]
    clean = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert clean == set(by_id) - {d for d, _ in found}


# --- personal data -------------------------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_follow_the_patterns():
    rng = random.Random(11)
    texts = ["".join(rng.choices("a@.1 9-+(0)b", k=rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choices("4539578763621486 -", k=24)) for _ in range(2000)]
    texts += ["x 4539 5787 6362 1486 y", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "300.1.1.1", "0001.2.3.4 é m.x@h-1.example.org.", "+1 (619) 555-0053"]
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts)
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_base_spans_are_linear():
    for long in ("a" * 300_000, "1" * 100_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000, "+1 " * 60_000):
        pii.base_spans(long)


def test_tagger_learns_and_adds(session):
    rng = random.Random(12)

    def phone():
        return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"

    rows = [(i, f"{words(rng, 30)} {phone()} {words(rng, 20)} {rng.randint(1, 99)}.{rng.randint(1, 99)}.7.1 {words(rng, 10)}", "en", "s", 0) for i in range(150)]
    docs = session.createDataFrame(rows, COLUMNS)
    model = pii.train_tagger(docs, steps=150)
    texts = [r[1] for r in rows]
    decoded = pii.decode(model, texts)
    base = [pii.base_spans(t) for t in texts]
    same = sum(len(set(a) & set(b)) for a, b in zip(base, decoded))
    assert same >= 0.9 * sum(map(len, base))
    for row in pii.find_personal_data(docs, model).collect():
        own = pii.base_spans(rows[row["doc_id"]][1])
        assert row["base_sha256"] == hashlib.sha256(pii.to_text(own).encode()).hexdigest()
        assert set(filter(None, pii.to_text(own).split(","))) <= set(row["spans"].split(","))
        assert row["n_ip"] == 1 and row["n_phone"] == 1
    clean = [words(rng, 60) for _ in range(50)]
    assert not any(pii.decode(model, clean))
    assert [s for t in clean for s in pii.base_spans(t)] == []


# --- licenses ------------------------------------------------------------------------------

def test_license_inheritance(session):
    mit, gpl = licenses.TEMPLATES[5][1], licenses.TEMPLATES[4][1]
    rows = [
        (1, "h/a/LICENSE", mit), (2, "h/a/x.c", "code"), (3, "h/a/b/y.c", "more code"), (4, "h/a/b/", f"index\n{gpl}\nrest"),
        (5, "h/z.c", "none"), (6, "h/a/b/c/w.c", f"text <b>{licenses.TEMPLATES[0][1]}</b> text"), (7, None, mit), (8, "h/ab/x.c", "no prefix of a"),
        (9, "h/a/b/c/v.c", None), (10, "g/q", "lines of the license the work under this version"),
    ]
    got = {r["doc_id"]: (r["license"], r["basis"], r["license_dir"]) for r in licenses.scan_licenses(
        session.createDataFrame(rows, "doc_id bigint, path string, text string"), id="doc_id").collect()}
    assert got[1] == ("MIT", "own", None) and got[2] == ("MIT", "inherited", "h/a")
    assert got[3] == ("GPL-3.0", "inherited", "h/a/b") and got[4] == ("GPL-3.0", "own", None)
    assert got[5] == got[8] == (None, None, None) and got[6][:2] == ("Apache-2.0", "own") and got[7] == ("MIT", "own", None)
    assert got[9] == ("GPL-3.0", "inherited", "h/a/b") and got[10][0] is None


# --- mixing --------------------------------------------------------------------------------

def plain_targets(sizes, weights, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_:
        all_ = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / all_ > cap * sizes[s]}
        for s in over or open_:
            target[s] = cap * sizes[s] if over else weight[s] * left / all_
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing_meets_targets(session):
    rng = random.Random(13)
    names = ["b", "a", "é", "\U0001f600", "z", None, "aa"]
    rows = [(i, words(rng, rng.choice([0, 5, 40, 200])), "en", rng.choice(names[:2] + names), 0) for i in range(900)] + [(900, None, "en", "z", 0)]
    docs = session.createDataFrame(rows, COLUMNS)
    got = mixing.mix_copies(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(re.findall(mixing.WORD, text or ""))
    target = plain_targets(sizes, mixing.WEIGHTS)
    for r in got:
        assert r["source_size"] == sizes[r["_source"]] and math.isclose(r["target"], target[r["_source"]], rel_tol=1e-9)
        assert 0 <= r["copies"] <= 2
        taken[r["_source"]] += r["copies"] * r["size"]
    assert len(got) == 901 and all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 50 for s in sizes)
    again = {r["_id"]: r["copies"] for r in mixing.mix_copies(docs.repartition(5)).collect()}
    assert again == {r["_id"]: r["copies"] for r in got}
    assert mixing.mix_documents(docs).count() == sum(r["copies"] for r in got)


def test_newton_with_base_rates(session):
    rows = [("s", 0.1, 100), ("s", 1.0, 50), ("s", 5.0, 30), ("t", 1.0, 10), ("u", 1.0, 10)]
    sums = session.createDataFrame(rows, "_source_key string, base double, words bigint")
    goals = session.createDataFrame([("s", 200.0), ("t", 20.0), ("u", 0.0)], "_source_key string, target double")
    tilt = {r[0]: r[1] for r in mixing.solve_tilts(sums, goals).collect()}
    got = sum(w * min(2.0, b * math.exp(tilt["s"])) for k, b, w in rows if k == "s")
    assert math.isclose(got, 200.0, rel_tol=1e-8) and tilt["t"] == math.inf and tilt["u"] == -math.inf
