"""Mixing sources to target weights by entropy balancing.

Every source has a token constraint: the words that the mix takes of it. Rates
are those nearest to the base rates in relative entropy over words: a document
of base rate q has the rate min(cap, q * exp(tilt of its source)). The tilts
solve the convex dual by Newton steps over sums per source, each step one
aggregation, and the rates are rounded into whole copies such that every source
still meets its target. Entropy is taken over words, so within a source long and short
documents are tilted alike, or, as in `op10_mixing`, over documents, which tilts each by its words.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.skew import spread_join
from ..session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
# Documents that are rounded together, what is owed being carried from one to the next.
ROUND_ROWS = 2_000
NEWTON_STEPS = 60
CLOSE = 1e-9


def words_in(text: Column) -> Column:
    """Number of words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _keyed(docs: DataFrame, id: str, text: str, source: str) -> list[Column]:
    """Non-null join keys of a row: id, content and source."""
    return [
        F.coalesce(F.col(id).cast("bigint").cast("string"), F.lit("")).alias("_id_key"),
        F.when(F.col(text).isNull(), F.lit(-1)).otherwise(F.xxhash64(F.col(text).cast("string"))).alias("_hash"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_source_key"),
    ]


def source_targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """`sources` (_source, _source_key, source_size) with `target`.

    Sources by code point (UTF-8 order is the same), null last, take the weights in
    turn. Together they get `share` of all sizes by weight; a target above cap x size
    stops there and the excess is shared again by weight among the others until none
    is above: a few aggregations of the source table.
    """
    spark = sources.sparkSession
    numbered = (
        sources.orderBy(F.col("_source").asc_nulls_last()).rdd.zipWithIndex()
        .map(lambda pair: (pair[0]["_source_key"], pair[1]))
    )
    turn = spark.createDataFrame(numbered, "_source_key string, _turn bigint")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_turn") % len(weights) + 1).cast("int"))
    weighed = cut(sources.join(turn, "_source_key").withColumn("_weight", weight).drop("_turn"))
    limit = F.col("source_size") * F.lit(float(cap))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # None is full at the start; after that those that the last level fills.
        filled = F.lit(False) if full < 0 else F.col("_weight") * level >= limit
        taken, weight_left, n = weighed.agg(
            F.sum(F.when(filled, limit).otherwise(0.0)), F.sum(F.when(filled, 0.0).otherwise(F.col("_weight"))),
            F.sum(F.when(filled, 1).otherwise(0)),
        ).first()
        if full >= 0 and n == full:
            break
        full, level = n or 0, (share * total - (taken or 0.0)) / weight_left if weight_left else float("inf")
        if not weight_left:
            break
    return weighed.withColumn("target", F.least(limit, F.col("_weight") * F.lit(level))).drop("_weight")


def solve_tilts(sums: DataFrame, targets: DataFrame, cap: float = CAP, steps: int = NEWTON_STEPS) -> DataFrame:
    """(_source_key, tilt): the dual solution, by Newton steps kept inside a bracket.

    `sums` has (_source_key, base, words): the words of a source at each base rate, and may have `pull`,
    by which the tilt of a source counts for them (1 without).
    A target of nothing has the tilt of minus infinity, one at or beyond the cap plus
    infinity. All sources step at once; it ends when each meets its target.
    """
    spark = sums.sparkSession
    sums = sums if "pull" in sums.columns else sums.withColumn("pull", F.lit(1.0))
    sums = cut(sums.where("base > 0 and words > 0"))
    plain = sums.groupBy("_source_key").agg(F.sum(F.col("base") * F.col("words")).alias("_mass"), F.sum("words").alias("_words"))
    infinite = F.lit(float("inf"))
    state = cut(
        targets.select("_source_key", "target").join(plain, "_source_key", "left").select(
            "_source_key", "target",
            F.when((F.col("target") <= 0) | F.col("_mass").isNull(), -infinite)
            .when(F.col("target") >= F.col("_words") * cap, infinite)
            .otherwise(F.log(F.col("target") / F.col("_mass"))).alias("tilt"),
            (-infinite).alias("low"), infinite.alias("high"),
        )
    )
    for _ in range(steps):
        rate = F.col("base") * F.exp(F.col("tilt") * F.col("pull"))
        now = sums.join(state, "_source_key").groupBy("_source_key").agg(
            F.sum(F.col("words") * F.least(F.lit(float(cap)), rate)).alias("got"),
            F.sum(F.when(rate < cap, F.col("words") * rate * F.col("pull")).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("target") - F.col("got")
        open_ = (F.abs("tilt") < infinite) & (F.abs(gap) > F.lit(CLOSE) * F.col("target"))
        low, high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("high")).otherwise(F.col("tilt"))
        newton = F.col("tilt") + F.try_divide(gap, F.col("slope"))
        inside = (newton > F.col("_low")) & (newton < F.col("_high"))
        middle = (
            F.when(F.col("_low") == -infinite, F.col("_high") - 1).when(F.col("_high") == infinite, F.col("_low") + 1)
            .otherwise((F.col("_low") + F.col("_high")) / 2)
        )
        state = cut(
            state.join(now, "_source_key", "left").withColumn("_open", F.coalesce(open_, F.lit(False)))
            .withColumn("_low", low).withColumn("_high", high)
            .select(
                "_source_key", "target",
                F.when(F.col("_open"), F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(middle))
                .otherwise(F.col("tilt")).alias("tilt"),
                F.when(F.col("_open"), F.col("_low")).otherwise(F.col("low")).alias("low"),
                F.when(F.col("_open"), F.col("_high")).otherwise(F.col("high")).alias("high"), "_open",
            )
        )
        if state.where("_open").isEmpty():
            break
        state = state.drop("_open")
    return state.select("_source_key", "tilt")


def _round(rows: pd.DataFrame, cap: int) -> pd.DataFrame:
    """Whole copies, longest documents first; what a document gets too much or too little is carried on."""
    rows = rows.sort_values(["size", "_order", "_id_key"], ascending=[False, True, True], kind="stable")
    owed, copies, more = 0.0, [], []
    for size, same, rate in zip(rows["size"], rows["_same"], rows["rate"]):
        if size == 0:
            copies.append(min(cap, int(rate + 0.5)))
            more.append(0)
            continue
        owed += rate * size * same
        n = min(cap * same, max(0, int(owed / size + 0.5)))
        owed -= n * size
        copies.append(n // same)
        more.append(n % same)
    rows = rows.assign(copies=copies, _more=more)
    return rows[["_id_key", "_hash", "_source_key", "_source", "size", "_same", "rate", "copies", "_more"]]


def mix_copies(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP,
    base: str | None = None, id: str = "doc_id", text: str = "text", source: str = "source", by_tokens: bool = False,
) -> DataFrame:
    """One row per distinct (id, text, source): its rows `_same`, size, source_size, target, rate, copies, `_more`.

    Of equal rows `_more` get one copy more than `copies`, the others just those, so
    what is owed is never more than one document, however often a row repeats. A null text has size 0, a null source is a source of
    its own, a null id stands for itself; a document of size 0 adds nothing and gets
    its rate rounded. `base` names a column of base rates (1 without; null counts as
    1, of equal rows the largest). With `by_tokens` entropy is taken over documents, so the tilt of a
    source counts for each document by its words: the rate is min(cap, base * exp(tilt * size / mean size)),
    and the tilts have no closed form. Rounding deals the documents of a source by hash
    into buckets of about ROUND_ROWS, so a hot source is many small tasks, and reruns
    agree: nothing depends on the order of rows.
    """
    keys = _keyed(docs, id, text, source)
    rate = F.lit(1.0) if base is None else F.coalesce(F.col(base).cast("double"), F.lit(1.0))
    units = cut(
        docs.select(
            *keys, F.col(source).cast("string").alias("_source"),
            words_in(F.col(text).cast("string")).alias("size"), rate.alias("base"),
        ).groupBy("_id_key", "_hash", "_source_key", "_source", "size")
        .agg(F.count(F.lit(1)).alias("_same"), F.max("base").alias("base"))
    )
    per_source = cut(units.groupBy("_source", "_source_key").agg(
        F.sum(F.col("size") * F.col("_same")).alias("source_size"), F.count(F.lit(1)).alias("n"),
    ))
    targets = cut(source_targets(per_source.drop("n"), weights, share, cap).drop("_source"))
    words = F.sum(F.col("size") * F.col("_same")).alias("words")
    mean = F.col("source_size") / F.col("n")
    if by_tokens:
        # As many rows as there are lengths of a source's texts.
        sums = units.groupBy("_source_key", "base", "size").agg(words).join(
            per_source.select("_source_key", mean.alias("_mean")), "_source_key").withColumn("pull", F.try_divide("size", "_mean"))
    else:
        sums = units.groupBy("_source_key", "base").agg(words)
    solved = cut(
        targets.join(solve_tilts(sums, targets, cap), "_source_key").join(per_source.select("_source_key", "n"), "_source_key")
    )
    counts = per_source.select("_source_key", "n")
    spread = F.xxhash64("_id_key", "_hash")
    rated = spread_join(
        units, solved.select("_source_key", "tilt", F.ceil(F.col("n") / ROUND_ROWS).alias("_buckets"), mean.alias("_mean")),
        "_source_key", spread, counts)
    tilt = F.col("tilt")
    if by_tokens:
        # An infinite tilt takes all or nothing of every document, also of empty ones.
        tilt = F.when(F.abs("tilt") < F.lit(float("inf")), tilt * F.try_divide("size", "_mean")).otherwise(tilt)
    dealt = rated.withColumn("rate", F.least(F.lit(float(cap)), F.col("base") * F.exp(tilt))).drop("_mean").withColumn(
        "_order", spread).withColumn("_bucket", F.pmod(F.xxhash64("_hash", "_id_key", F.lit(1)), F.col("_buckets")))
    whole = int(cap)
    rounded = dealt.groupBy("_source_key", "_bucket").applyInPandas(
        lambda rows: _round(rows, whole),
        "_id_key string, _hash bigint, _source_key string, _source string, size bigint, _same bigint, "
        "rate double, copies int, _more bigint",
    )
    whole_rows = spread_join(rounded, targets, "_source_key", F.xxhash64("_id_key", "_hash"), counts)
    return whole_rows.withColumn("_id", F.when(F.col("_id_key") != "", F.col("_id_key")).cast("bigint"))


def numbered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows` with `_number`, 1 to n among the rows of equal keys.

    Rows are numbered by their places in written files, slice by slice, so a key
    with most of the rows is many small tasks, and a retry gives the same numbers.
    """
    placed = cut(rows).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    placed = placed.withColumn("_slice", F.floor(F.col("_at") / ROUND_ROWS))
    slices = placed.groupBy(*keys, "_file", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_file", "_slice")) - F.col("_n")
    offsets = slices.withColumn("_ahead", ahead).drop("_n")
    place = F.row_number().over(Window.partitionBy(*keys, "_file", "_slice").orderBy("_at"))
    found = placed.withColumn("_place", place).join(offsets, [*keys, "_file", "_slice"])
    return found.withColumn("_number", F.col("_ahead") + F.col("_place")).drop("_file", "_at", "_slice", "_ahead", "_place")


def mix_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with their own columns only."""
    keys = ["_id_key", "_hash", "_source_key"]
    copies = cut(mix_copies(docs, id=id, text=text, source=source, **options).where("copies > 0 or _more > 0").select(
        *keys, "copies", "_more"))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *_keyed(docs, id, text, source))
    taken = keyed.join(copies.where("_more = 0"), keys).select("_row", "copies")
    uneven = copies.where("_more > 0")
    if not uneven.isEmpty():
        parted = numbered(keyed.join(uneven, keys), keys)
        one = F.when(F.col("_number") <= F.col("_more"), 1).otherwise(0)
        taken = taken.unionByName(parted.select("_row", (F.col("copies") + one).alias("copies")).where("copies > 0"))
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
