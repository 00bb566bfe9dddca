"""Repair of conversations to whole exchanges: an optional system turn, then user and assistant in turn.

The cheapest edits are found by a Viterbi walk over the rows of a conversation. What the
repaired roles may be is a machine of four states; each state keeps its best edits so far.
The edits of all states form a tree. Its segments count who uses them: a segment that
no state needs any more goes, one that all states share is emitted at once and forgotten.
So a task holds only the part on which the states still differ, of however long a
conversation, and the texts that this part keeps. Of equal cost the edits whose initials
are least in ASCII win; two such strings differ where their branches part, which is the
first letter of either branch below their last common segment.

Rows are ordered by turn (null first), then role, then text. One task walks through a
conversation in that order, as its digest is one sequence; it reads it as a stream and
holds no conversation. Which messages were said before is found apart, spread by message,
so that nothing grows there with a conversation either.

Null roles and texts count as one space, so such a row is blank. A null conversation is
one conversation. An empty text is blank; rows repeated in full are duplicates. Roles
other than user, assistant and system are judged by their initial. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import partitions

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
# Fixed values of the contract.
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5

# States: nothing said, system said, user last, assistant last. A conversation may end in ENDS.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
# Where the initial of a role leads, by state; what is missing is not allowed.
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
# The role that may be said next whatever the row says, and where it leads.
NEXT = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
LEGAL = {"su", "ua", "au"}

_WORD = re.compile(r"[^\x20\x09-\x0D]")


class Segment:
    """A run of edits on the way of one or more states; `users` counts its branches and the states that stand at its end."""

    __slots__ = ("parent", "letters", "edits", "branches", "users", "depth")

    def __init__(self, parent: Segment | None):
        self.parent, self.letters, self.edits, self.branches, self.users = parent, bytearray(), [], [], 0


class Repair:
    """Viterbi over the rows of one conversation; `emit(letter, edit)` gets each edit as soon as it is certain."""

    def __init__(self, emit: Callable[[str, object], None]):
        self.emit = emit
        self.root = Segment(None)
        self.root.users = 1
        self.tips: dict[int, tuple[int, Segment]] = {START: (0, self.root)}
        self.held = 0  # edits not certain yet, the most so far in `most`
        self.most = 0
        self._settle({START: (0, self.root, "", ())})

    def step(self, row, initial: str, role: str, deleted: bool, truncated: bool) -> None:
        """`row` is whatever stands for the row where it stays: (letter, (role, row)); (D, (None, None)) where not."""
        found: dict[int, tuple] = {}
        extra = TRUNCATED_COST if truncated else 0
        for state, (cost, node) in self.tips.items():
            self._offer(found, state, (cost + DELETE_COST, node, DELETE, ((None, None),)))
            if not deleted:
                to = FOLLOWS[state].get(initial)
                if to is not None:
                    self._offer(found, to, (cost + extra, node, KEEP, ((role, row),)))
                name, to = NEXT[state]
                if name != role:
                    self._offer(found, to, (cost + extra + REROLE_COST, node, REROLE, ((name, row),)))
        self._settle(found)

    def finish(self) -> int:
        """Emit what is left and give the cost."""
        best = None
        for state in ENDS:
            if state in self.tips:
                cost, node = self.tips[state]
                way = (cost, node, "", ())
                if best is None or self._less(way, best):
                    best = way
        way, node = [], best[1]
        while node is not None:
            way.append(node)
            node = node.parent
        for node in reversed(way):
            self._say(node)
        return best[0]

    def _offer(self, found: dict, state: int, way: tuple) -> None:
        held = found.get(state)
        if held is None or self._less(way, held):
            found[state] = way

    def _less(self, a: tuple, b: tuple) -> bool:
        """Cheaper, or of equal cost and least in ASCII."""
        if a[0] != b[0]:
            return a[0] < b[0]
        above = {}
        node, branch = a[1], None
        while node is not None:
            above[id(node)] = branch
            node, branch = node.parent, node
        node, branch = b[1], None
        while id(node) not in above:
            node, branch = node.parent, node
        left = above[id(node)]
        tail_a = a[2] if left is None else chr(left.letters[0])
        tail_b = b[2] if branch is None else chr(branch.letters[0])
        # Of one length of rows and one cost neither way is the beginning of the other.
        return tail_a < tail_b

    def _settle(self, found: dict[int, tuple]) -> None:
        changed = True
        while changed:  # inserted turns, one after another
            changed = False
            for state in list(found):
                cost, node, letters, edits = found[state]
                name, to = NEXT[state]
                way = (cost + INSERT_COST, node, letters + INSERT, edits + ((name, None),))
                if to not in found or self._less(way, found[to]):
                    found[to] = way
                    changed = True
        # Whatever follows, it costs after an assistant no more than after a system turn, and at most the
        # deletion of a system turn more than at the start: dearer states are on no cheapest way.
        best = found[ASSISTANT][0]
        for state, ahead in ((SYSTEM, 0), (START, DELETE_COST)):
            if state in found and found[state][0] > best + ahead:
                del found[state]
        before = self.tips
        groups: dict[int, tuple[Segment, list]] = {}
        for state, (cost, node, letters, edits) in found.items():
            groups.setdefault(id(node), (node, []))[1].append((letters, edits, state, cost))
        self.tips = {}
        for node, ways in groups.values():
            node.users += len(ways)  # held while they are put on
        for _, node in before.values():
            node.users -= 1
        for _, node in before.values():
            if node.users == 0:
                self._drop(node)
        for node, ways in groups.values():
            node.users -= len(ways)
            self._extend(node, ways)
        for node, _ in groups.values():
            self._join(node)
        while self.root.letters or (len(self.root.branches) == 1 and self.root.users == 1):
            self._say(self.root)
            if len(self.root.branches) == 1 and self.root.users == 1:
                self.root = self.root.branches[0]
                self.root.parent = None
        if self.held > self.most:
            self.most = self.held

    def _extend(self, node: Segment, ways: list) -> None:
        """Put ways of different letters on a node; those that begin alike share a branch."""
        if len(ways) == 1 and not node.branches and node.users == 0:
            letters, edits, state, cost = ways[0]
            node.letters += letters.encode()
            node.edits += edits
            self.held += len(edits)
            node.users = 1
            self.tips[state] = (cost, node)
            return
        firsts: dict[str, list] = {}
        for way in ways:
            if way[0]:
                firsts.setdefault(way[0][0], []).append(way)
            else:
                node.users += 1
                self.tips[way[2]] = (way[3], node)
        for first, group in firsts.items():
            branch = Segment(node)
            node.branches.append(branch)
            node.users += 1
            if len(group) > 1:
                branch.letters += first.encode()
                branch.edits.append(group[0][1][0])
                self.held += 1
                group = [(letters[1:], edits[1:], state, cost) for letters, edits, state, cost in group]
            self._extend(branch, group)

    def _drop(self, node: Segment) -> None:
        """Remove a segment that nobody uses, and those above it that nobody else uses."""
        while node.parent is not None and node.users == 0:
            self.held -= len(node.edits)
            above = node.parent
            above.branches.remove(node)
            above.users -= 1
            node = above
        self._join(node)

    def _join(self, node: Segment) -> None:
        """A segment with one branch and no state at its end is one with that branch, so few segments stand above each other."""
        while node is not None and node.parent is not None and node.users == 1 and len(node.branches) == 1:
            below = node.branches[0]
            node.letters += below.letters
            node.edits += below.edits
            below.letters, below.edits, below.parent = node.letters, node.edits, node.parent
            node.parent.branches[node.parent.branches.index(node)] = below
            node = below.parent

    def _say(self, node: Segment) -> None:
        for letter, edit in zip(node.letters.decode(), node.edits):
            self.emit(letter, edit)
        self.held -= len(node.edits)
        node.letters, node.edits = bytearray(), []


def _message(role: Column, text: Column) -> Column:
    return F.concat(F.length(role).cast("string"), F.lit(":"), role, text)


def _stream(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """Rows of each conversation in order, those that say what an earlier turn said under the digests that stand before them.

    (_conv, _turn, _kind, _role, _text, _digest). Kind 2 is a row. Kind 1 names a message
    of this turn that an earlier turn has: few short rows, which travel with the others,
    so texts are dealt once. Kind 0 only names the conversation.
    """
    there = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    plain = rows.select(
        F.col(conv).alias("_conv"), F.col(turn).cast("bigint").alias("_turn"), there.alias("_there"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("_text"),
    )
    message = _message(F.col("_role"), F.col("_text"))
    whose = F.coalesce(F.concat(F.lit("="), F.col("_conv").cast("string")), F.lit("-"))
    place = F.struct(F.col("_turn").isNotNull(), F.col("_turn"))
    said = plain.where("_there").select(
        "_conv", "_turn", F.unhex(F.sha2(message.cast("binary"), 256)).alias("_digest"),
        F.sha2(F.concat(F.length(whose).cast("string"), F.lit(":"), whose, message).cast("binary"), 256).alias("_key"))
    firsts = said.groupBy("_key").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_last > _first")
    again = said.join(firsts.select("_key", "_first"), "_key").where(place > F.col("_first")).select("_conv", "_turn", "_digest").distinct()
    marks = again.select(
        "_conv", "_turn", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_role"),
        F.lit(None).cast("string").alias("_text"), "_digest")
    real = plain.select(
        "_conv", "_turn", F.when(F.col("_there"), 2).otherwise(0).alias("_kind"),
        F.when(F.col("_there"), F.col("_role")).alias("_role"), F.when(F.col("_there"), F.col("_text")).alias("_text"),
        F.lit(None).cast("binary").alias("_digest"))
    if present:  # a conversation is named once
        names = real.where("_kind = 0").select("_conv", F.lit(None).cast("bigint").alias("_turn"), "_kind", "_role", "_text", "_digest")
        real = real.where("_kind = 2").unionByName(names.dropDuplicates(["_conv"]))
    return (
        real.unionByName(marks).repartition(partitions(rows.sparkSession), "_conv")
        .sortWithinPartitions("_conv", "_turn", "_kind", "_role", "_text")
    )


class Audit:
    """What is known of one conversation while its rows pass."""

    def __init__(self, conv, emit):
        self.conv, self.repair = conv, Repair(emit)
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.turn = None
        self.turns, self.rows, self.last, self.said = 0, 0, None, None
        self.marks: set[bytes] = set()
        self.at = ()

    def mark(self, turn, digest) -> None:
        if self.at != (turn,):
            self.at, self.marks = (turn,), set()
        self.marks.add(digest)

    def row(self, turn, role: str, text: str) -> None:
        if self.at != (turn,):
            self.at, self.marks = (turn,), set()
        if turn is not None and (self.least is None or turn != self.most):
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += 1
        initial = role[:1]
        if self.rows and self.last + initial not in LEGAL:
            self.illegal += 1
        blank = _WORD.search(text) is None
        # Equal messages of one turn follow each other.
        duplicate = self.said == (turn, role, text) or bool(self.marks) and _digest(role, text) in self.marks
        truncated = not blank and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate and not blank
        truncated = truncated and not duplicate
        self.truncated += truncated
        self.repair.step((turn, text), initial, role, blank or duplicate, truncated)
        self.rows, self.last, self.said = self.rows + 1, initial, (turn, role, text)

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def _digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


def _walk(batches: Iterator[pa.RecordBatch], start: Callable[[object], Audit], close: Callable[[Audit], None], flush) -> Iterator[pa.RecordBatch]:
    open_ = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("_conv", "_turn", "_kind", "_role", "_text", "_digest")]
        for conv, turn, kind, role, text, digest in zip(*columns):
            if open_ is None or conv != open_.conv:
                if open_ is not None:
                    close(open_)
                open_ = start(conv)
            if kind == 2:
                open_.row(turn, role, text)
            elif kind == 1:
                open_.mark(turn, digest)
        yield from flush(False)
    if open_ is not None:
        close(open_)
    yield from flush(True)


AUDIT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
         "audit string, repaired_sha256 string")


def audit_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None,
) -> DataFrame:
    """One row per conversation: gaps in its turns, faults, illegal neighbours, and cost, initials and digest of its repair.

    Rows whose `present` is not true only name their conversation. A row's first
    fault counts. The digest is that of the repaired `role:text`, joined by new lines.
    """
    names = AUDIT.replace(" bigint", "").replace(" string", "").split(", ")
    kind = rows.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def start(key) -> Audit:
            letters, sha = bytearray(), hashlib.sha256()
            lead = [b""]

            def emit(letter, edit):
                letters.extend(letter.encode())
                said, row = edit
                if said is not None:
                    sha.update(lead[0] + f"{said}:{row[1] if row else ''}".encode("utf-8", "surrogatepass"))
                    lead[0] = b"\n"

            one = Audit(key, emit)
            one.letters, one.sha = letters, sha
            return one

        def close(one: Audit) -> None:
            cost = one.repair.finish()
            out.append((one.conv, one.gaps(), one.blank, one.duplicate, one.truncated, one.illegal, cost,
                        one.letters.decode(), one.sha.hexdigest()))

        def flush(_) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(["_conv", *names], r)) for r in out], schema=schema)
                out.clear()

        yield from _walk(batches, start, close, flush)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"_conv {kind}, {AUDIT}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    found = _stream(rows, conv, turn, role, text, present).mapInArrow(run, ddl)
    return found.select(F.col("_conv").alias(conv), *names)


def repair_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv, place, turn, role, text, edit) of the repaired messages: kept, of another role, or inserted with an empty text and no turn."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = rows.schema[conv].dataType.simpleString()
    ddl = f"_conv {kind}, place bigint, _turn bigint, _role string, _text string, edit string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def start(key) -> Audit:
            place = [0]

            def emit(letter, edit):
                said, row = edit
                if said is not None:
                    out.append((key, place[0], row[0] if row else None, said, row[1] if row else "", letter))
                    place[0] += 1

            return Audit(key, emit)

        def flush(_) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
                out.clear()

        yield from _walk(batches, start, lambda one: one.repair.finish(), flush)

    found = _stream(rows, conv, turn, role, text, None).mapInArrow(run, ddl)
    return found.select(
        F.col("_conv").alias(conv), "place", F.col("_turn").alias(turn), F.col("_role").alias(role), F.col("_text").alias(text), "edit")


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damage some rows by the crc32 of `conv:turn`, modulo 20; dropped ones stay with `present` false.

    0 drops a row, 1 empties its text, 2 takes its `.`, `!` and `?`, 3 repeats it, 4 makes
    its role user. Nulls count as one space there and in role and text.
    """
    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn))) % 20
    cased = rows.select(conv, turn, plain(role).alias(role), plain(text).alias(text), case.alias("_case"))
    return cased.select(
        conv, turn, F.when(F.col("_case") == 4, "user").otherwise(F.col(role)).alias(role),
        F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)).alias(text),
        (F.col("_case") != 0).alias("present"),
        F.explode(F.when(F.col("_case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")
