"""A Merkle manifest of a table: a root per source, one above them, and a proof for every row.

A leaf is the digest of a row's fields. The leaves of a source ascend by id; every
`FANOUT` consecutive nodes become the digest of their digests until one is left,
the source's subroot. Subroots in source order give the root the same way.

Leaves are dealt into aligned blocks of FANOUT ** HEIGHT, whose small trees are made
where the block is. Above them the blocks swap digests like a butterfly: in round r
the blocks that differ in the r-th digit of their place alone meet, each takes the
digests of its siblings and hashes the ancestor itself. So after the last round every
block holds its own proof up to the root and nothing is handed down. No step gathers
more than a block or one run of siblings, however many leaves a source has.

Nulls in any field are marked and hashed. A null source is a source of its own, before
the others; rows of a null id come first in their source. Rows of one id and source are
ordered by their leaf, so repeated rows have well-defined places. A table of one row is
its own root with an empty proof; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .common import partitions

FANOUT = 16
# Levels of the tree inside a block: 256 leaves.
HEIGHT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_POSITION_BITS = 33  # of monotonically_increasing_id: the place within the partition


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return digest(*[field(c) for c in columns])


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add `_rank` within the group, from 0, and `_total`, the rows of the group.

    Rows are dealt by ranges of (group, order) and counted per range, so a group that
    holds most rows lies in many ranges; equal rows are told apart by their place in
    the input. The counts, one row per range and group, carry the ranks on. `group`
    must not be null.
    """
    keys = [group, *order, "_salt"]
    dealt = (
        rows.withColumn("_salt", F.monotonically_increasing_id())
        .repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
        .drop("_salt").withColumn("_at", F.monotonically_increasing_id())
    )
    placed = cut(dealt).withColumn("_range", F.shiftright("_at", _POSITION_BITS))
    runs = placed.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        group, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("_total"),
    )
    return placed.join(runs, [group, "_range"]).withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _level_up(nodes: Column) -> Column:
    """The digests of every FANOUT consecutive digests, the last run being what is left."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.concat_ws("", F.slice(nodes, i * FANOUT + 1, FANOUT)).cast("binary"), 256))


def _beside(nodes: Column, at: Column) -> Column:
    """What stands before and behind the digest of place `at` (from 0) in its run of siblings."""
    start = F.floor(at / FANOUT).cast("int") * FANOUT
    return F.struct(
        F.concat_ws("", F.slice(nodes, start + 1, at - start)).alias("before"),
        F.concat_ws("", F.slice(nodes, at + 2, start + (FANOUT - 1) - at)).alias("after"),
    )


_NO_SIBLINGS = "cast(array() as array<struct<before: string, after: string>>)"


def fold(start: Column, siblings: Column) -> Column:
    """The root that a digest leads to with its siblings, level by level."""
    return F.aggregate(siblings, start, lambda node, s: digest(s["before"], node, s["after"]))


def exchange(nodes: DataFrame, group: str) -> DataFrame:
    """(group, place, top, siblings) of nodes (group, place, n, digest): each node's own proof up to its group's top.

    `place` counts from 0 to n - 1 within the group, n being the same on all its rows.
    Round r puts together the nodes that stand for the FANOUT parts of one ancestor
    and have the same place within their part; one not full sends its digest for the
    places it lacks too, at most as many rows as its siblings have. A group that has
    reached its top takes no further part.
    """
    open_ = nodes.select(
        group, "place", "n", F.col("digest").alias("top"), F.expr(_NO_SIBLINGS).alias("siblings"))
    done, step = [], 1
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        done.append(open_.where(F.col("n") <= step).select(group, "place", "top", "siblings"))
        if largest <= step:
            break
        open_ = _round(open_.where(F.col("n") > step), group, step)
        step *= FANOUT
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def _round(open_: DataFrame, group: str, step: int) -> DataFrame:
    part = F.floor(F.col("place") / step)
    held = F.least(F.lit(step).cast("bigint"), F.col("n") - part * step)  # nodes in this part
    alone = (part % FANOUT == 0) & ((part + 1) * step >= F.col("n"))
    offset = F.col("place") % step
    sent = open_.select(
        group, "n", "place", "top", "siblings", part.alias("_part"), offset.alias("_offset"),
        F.explode(F.when(alone | (held == step), F.array(offset)).otherwise(
            F.sequence(offset, F.lit(step - 1).cast("bigint"), held))).alias("_for"),
    )
    own = F.col("_for") == F.col("_offset")
    met = sent.groupBy(group, "n", F.floor(F.col("_part") / FANOUT).alias("_parent"), "_for").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("_part") % FANOUT).cast("int").alias("digit"), F.col("top").alias("node"),
        F.when(own, F.col("place")).alias("place"), F.when(own, F.col("siblings")).alias("siblings"),
    ))).alias("run"))
    every = F.transform("run", lambda m: m["node"])
    return (
        met.withColumn("_nodes", every).withColumn("_up", F.sha2(F.concat_ws("", "_nodes").cast("binary"), 256))
        .withColumn("own", F.explode(F.filter("run", lambda m: m["place"].isNotNull())))
        .select(
            group, "n", F.col("own.place").alias("place"), F.col("_up").alias("top"),
            F.concat("own.siblings", F.array(_beside(F.col("_nodes"), F.col("own.digit")))).alias("siblings"),
        )
    )


def manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id") -> DataFrame:
    """(order, group, leaf, other, subroot, root, siblings) of `leaves` (order, group, leaf, other).

    `siblings` is the row's proof, level by level from the leaf to the root: what stands
    before and behind its node in the run. `other` is any value carried along.
    """
    # Null first, then the sources bytewise.
    keyed = leaves.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("_group"),
        F.col(order).alias("_id"), "leaf", "other")
    block = FANOUT ** HEIGHT
    rows = ranked(cut(keyed), "_group", ["_id", "leaf", "other"])
    blocks = cut(
        rows.groupBy("_group", F.floor(F.col("_rank") / block).alias("place"), "_total")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "_id", "leaf", "other"))).alias("rows"))
    )
    levels = [F.transform("rows", lambda r: r["leaf"])]
    for depth in range(HEIGHT):
        levels.append(F.when(F.col("_total") > FANOUT ** depth, _level_up(F.col(f"_level{depth}"))).otherwise(F.col(f"_level{depth}")))
    for depth, nodes in enumerate(levels):
        blocks = blocks.withColumn(f"_level{depth}", nodes)

    tops = blocks.select(
        "_group", "place", F.ceil(F.col("_total") / block).alias("n"), F.element_at(f"_level{HEIGHT}", 1).alias("digest"))
    inner = cut(exchange(cut(tops), "_group"))
    subroots = inner.where("place = 0").select(F.lit(0).alias("_all"), "_group", F.col("top").alias("digest"))
    sources = ranked(subroots, "_all", ["_group"]).withColumnsRenamed({"_rank": "place", "_total": "n"})
    outer = exchange(sources.select("_all", "place", "n", "digest"), "_all").join(sources.select("place", "_group"), "place")
    outer = outer.select("_group", F.col("top").alias("root"), F.col("siblings").alias("_outer"))

    def local(at: Column) -> Column:
        steps = [
            F.when(F.col("_total") > FANOUT ** depth, F.array(_beside(F.col(f"_level{depth}"), F.floor(at / FANOUT ** depth).cast("int"))))
            .otherwise(F.expr(_NO_SIBLINGS)) for depth in range(HEIGHT)
        ]
        return F.concat(*steps)

    joined = blocks.join(inner, ["_group", "place"]).join(cut(outer), "_group")
    each = joined.select(
        "_group", F.col("top").alias("subroot"), "root",
        F.inline(F.transform("rows", lambda r, i: F.struct(
            r["_id"].alias("_id"), r["leaf"].alias("leaf"), r["other"].alias("other"),
            F.concat(local(i), F.col("siblings"), F.col("_outer")).alias("siblings")))),
    )
    return each.select(
        F.col("_id").alias(order), F.when(F.col("_group") != "", F.substr("_group", F.lit(2))).alias(group),
        "leaf", "other", "subroot", "root", "siblings")


def verify(rows: DataFrame) -> DataFrame:
    """Add `proof_sha256`, the digest of all siblings, `folded_root` from `other` where given, else from the leaf, and `verified`."""
    beside = F.concat_ws("", F.transform("siblings", lambda s: F.concat(s["before"], s["after"])))
    return (
        rows.withColumn("proof_sha256", F.sha2(beside.cast("binary"), 256))
        .withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("siblings")))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


def tampered_leaves(docs: DataFrame, tampered: Column, changed: Column, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, source, leaf, other) of documents: `other` is the leaf with `changed` for the text where `tampered` holds."""
    columns = [F.col(c) for c in fields]
    other = [changed if c == "text" else F.col(c) for c in fields]
    return docs.select("doc_id", "source", leaf(columns).alias("leaf"), F.when(tampered, leaf(other)).alias("other"))
