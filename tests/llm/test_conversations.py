"""Repair of conversations against an exhaustive search."""

import hashlib
import heapq
import random
import re

import pytest

from hearsay.llm import conversations as c

WHOLE = re.compile(r"(s?(ua)+)?\Z")


def search(rows):
    """(cost, audit, messages) of rows (role, text, deleted, truncated): cheapest first over all edits, all ties kept."""
    heap, best, found = [(0, "", 0, "", ())], {}, None
    while heap:
        cost, audit, i, out, said = heapq.heappop(heap)
        if found and cost > found[0]:
            break
        if i == len(rows) and WHOLE.match(out) and (found is None or (cost, audit) < found[:2]):
            found = (cost, audit, said)
        if best.setdefault((i, out[-1:]), cost) < cost:
            continue
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[out[-1:]]
        roles = [r for r in ("user", "assistant") if r[0] in allowed]
        for r in roles:
            heapq.heappush(heap, (cost + 5, audit + "I", i, out + r[0], said + ((r, ""),)))
        if i < len(rows):
            role, text, deleted, truncated = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, out, said))
            if not deleted:
                more = 5 if truncated else 0
                if role and role[0] in allowed:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + role[0], said + ((role, text),)))
                for r in roles:
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, out + r[0], said + ((r, text),)))
    return found


def walked(rows):
    audit, said = [], []

    def emit(letter, edit):
        audit.append(letter)
        if edit[0] is not None:
            said.append((edit[0], edit[1] or ""))

    repair = c.Repair(emit)
    for role, text, deleted, truncated in rows:
        repair.step(text, role[:1], role, deleted, truncated)
    return (repair.finish(), "".join(audit), tuple(said)), repair


def test_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice(["user", "assistant", "system", "user", "assistant", "admin", " ", ""]), f"t{i}",
                 rng.random() < 0.2, rng.random() < 0.2) for i in range(rng.randint(0, 9))]
        assert walked(rows)[0] == search(rows), rows


def test_little_is_held_of_a_long_conversation():
    rng = random.Random(2)
    rows = [(rng.choice(["system", "user", "assistant"]) if rng.random() < 0.1 else ("user", "assistant")[i % 2], "t",
             rng.random() < 0.1, rng.random() < 0.1) for i in range(30_000)]
    (_, audit, said), repair = walked(rows)
    assert repair.most < 500 and WHOLE.match("".join(role[0] for role, _ in said)) and len(audit) >= 30_000


def expected(rows):
    """The audit of rows (turn, role, text) by plain Python."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for turn, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit, said = search(judged)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest(),
    )


@pytest.fixture(scope="module")
def odd(session):
    rng = random.Random(3)
    texts = ["Yes.", "No", "why?", "", " \t", None, "é ü!", "x" * 200_000 + ".", "same.", "same."]
    rows = [(k % 40 if k % 37 else None, rng.choice([None, 0, 1, 2, 3, 4, 7, -2]), rng.choice(["user", "assistant", "system", None, "", "tool", "Üser"]),
             rng.choice(texts)) for k in range(260)]
    rows += rows[:30]
    # One conversation with a third of all rows, its messages said again many turns later.
    rows += [(99, i, ("user", "assistant")[i % 2], f"message {i % 60}.") for i in range(150)]
    table = session.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return rows, table.selectExpr("*", "'own' as _conv", "'own' as _turn", "'own' as _kind", "'own' as present", "1 as audit").repartition(5)


def test_audit_of_odd_conversations(odd):
    rows, table = odd
    want = {}
    for conv, *row in rows:
        want.setdefault(conv, []).append(row)
    got = {r["conv_id"]: tuple(r)[1:] for r in c.audit_conversations(table).collect()}
    assert got == {conv: expected(of) for conv, of in want.items()}


def test_repaired_messages_match_their_digest(odd):
    _, table = odd
    audits = {r["conv_id"]: r for r in c.audit_conversations(table).collect()}
    said = {}
    for r in c.repair_conversations(table).orderBy("conv_id", "place").collect():
        assert r["place"] == len(said.setdefault(r["conv_id"], []))
        assert (r["edit"] == "I") == (r["turn"] is None and r["text"] == "" and r["edit"] not in "KR")
        said[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, r in audits.items():
        assert hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest() == r["repaired_sha256"]


def test_dropped_conversations_and_no_rows(session):
    ddl = "conv_id bigint, turn bigint, role string, text string, present boolean"
    rows = [(1, 0, "user", "Hi.", False), (1, 1, "assistant", "Ho.", None), (2, 5, "user", "Hi.", True), (None, 0, "user", "Hi.", False)]
    got = {r["conv_id"]: tuple(r)[1:] for r in c.audit_conversations(session.createDataFrame(rows, ddl), present="present").collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {1: nothing, None: nothing, 2: (0, 0, 0, 0, 0, 2, "D", nothing[-1])}
    none = session.createDataFrame([], ddl)
    assert c.audit_conversations(none).count() == 0 and c.repair_conversations(none).count() == 0
    assert c.damage(none).count() == 0


def test_damage_by_case(session):
    import zlib

    ddl = "conv_id bigint, turn bigint, role string, text string"
    rows = [(i, None if i % 7 == 0 else i % 3, "assistant", "A. b! c?") for i in range(200)] + [(None, 1, None, None)]
    got = {}
    for r in c.damage(session.createDataFrame(rows, ddl)).collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["present"]))
    for conv, turn, role, text in rows:
        role, text = role or " ", text or " "
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        want = {0: [(role, text, False)], 1: [(role, "", True)], 2: [(role, re.sub("[.!?]", "", text), True)],
                3: [(role, text, True)] * 2, 4: [("user", text, True)]}.get(case, [(role, text, True)])
        assert got[conv] == want, conv
