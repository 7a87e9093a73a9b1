"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within a source the documents stand in the order of their
keys, and the words of the mix are the first ones up to the source's exact budget; a budget over
the source's size repeats the source. Keys are uniform, so their leading bits cut a source into
even ranges without sampling: word totals per range give the prefix sums, and only the one range
of each source in which the budget ends is ordered row by row. No task holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
# Documents expected in one range of keys.
RANGE_ROWS = 500


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(*values: Column, seed: int) -> Column:
    """60 bits of an MD5 of the seed and the values; NULL counts as a value of its own."""
    parts = [F.lit(str(seed)), *[F.coalesce(v.cast("string"), F.lit("\0")) for v in values]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, KEY_BITS // 4), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``place``, the 0-based place by code point with NULL last, without a global window."""
    ordered = stored(
        sources.orderBy(F.asc_nulls_last("source")).withColumn("_id", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_id", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the sorted list of sources.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inner = F.col("_id") - F.shiftleft(part, 33)
    return (
        ordered.withColumn("_part", part).join(offsets, "_part")
        .withColumn("place", (F.col("_before") + inner).cast("long"))
        .drop("_id", "_part", "_before")
    )


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """Add ``target`` to one row per source with ``source`` and ``source_size``.

    Sources in code-point order have the weights in turn and share ``share`` times all words.
    No target is above ``limit`` times its source's size: the excess is shared again by weight
    among the others until none is above.
    """
    place = F.col("place") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(limit))
    rows = stored(_ranked(sources).withColumn("weight", weight).withColumn("cap", cap))
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0) * share

    rate, full_before = 0.0, -1
    while True:
        full = F.col("cap") < F.col("weight") * F.lit(rate)
        n, given, open_weight = rows.agg(
            F.count(F.when(full, 1)),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == full_before or not open_weight:
            break
        rate, full_before = (total - given) / open_weight, n
    return rows.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(rate)))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """Decide how much of every document a mix of sources takes.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; all its columns stay, and rows are not
    repeated here. Added: ``size`` (words of the text), ``source_size``, ``target``, ``taken``
    (words taken, repeats counted) and ``copies`` (``taken`` in whole documents, the one that the
    budget cuts rounded). Columns of ``docs`` with one of these names are replaced.

    A source's ``taken`` adds up to its target, rounded. NULL is a source of its own and comes
    last. NULL and empty texts have size 0 and nothing is taken from them. Equal rows are treated
    alike: the budget that ends among them is divided evenly and its remainder left. The same
    rows give the same mix in any order of rows or partitions. An empty table gives no rows.
    """
    added = ("size", "source_size", "target", "taken", "copies")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    size = word_count(F.col("text"))
    key = random_key(F.col("doc_id"), seed=seed)
    tie = random_key(F.col("text"), seed=seed)
    narrow = stored(docs.select("source", size.alias("size"), key.alias("key"), tie.alias("tie")))

    sums = narrow.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    plan = stored(targets(sums, weights, share, limit).withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("long"),
    }).withColumn(
        "rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    ))
    most = plan.agg(F.max("rows")).first()[0] or 1
    bits = max(0, min(20, math.ceil(math.log2(most / RANGE_ROWS)))) if most > RANGE_ROWS else 0
    bucket = F.shiftright("key", KEY_BITS - bits).alias("bucket")

    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    ranges = narrow.groupBy("source", bucket).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket")
    ranges = ranges.withColumn("upto", F.sum("words").over(upto))
    last = (
        ranges.alias("a").join(plan.alias("b"), same)
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
        .select("a.source", "bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    )
    inside = (
        narrow.withColumn("bucket", bucket).alias("a")
        .join(last.alias("b"), same & (F.col("a.bucket") == F.col("b.bucket")))
        .groupBy("a.source", "a.key", "a.tie", "left")
        .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    )
    within = Window.partitionBy("source").orderBy("key", "tie")
    ends = (
        inside.withColumn("end", F.sum("words").over(within))
        .where((F.col("end") > F.col("left")) & (F.col("end") - F.col("words") <= F.col("left")))
        .select(
            F.col("source").alias("s"), F.col("key").alias("end_key"), F.col("tie").alias("end_tie"),
            F.floor((F.col("left") - F.col("end") + F.col("words")) / F.col("n")).alias("part"),
        )
    )
    # Names that columns of the documents do not have.
    own = {c: f"_mix_{c}" for c in ("source", "epochs", "end_key", "end_tie", "part", "key", "tie")}
    cuts = stored(
        plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
        .select("source_size", "target", *[
            F.col(c).alias(own[c]) for c in ("source", "epochs", "end_key", "end_tie", "part")])
    )
    # The table of sources is joined by its measured size; NULL joins NULL.
    out = docs.withColumns({"size": size, own["key"]: key, own["tie"]: tie}).join(
        cuts, F.col("source").eqNullSafe(F.col(own["source"]))
    )
    epochs, part, key, tie, end_key, end_tie = (
        F.col(own[c]) for c in ("epochs", "part", "key", "tie", "end_key", "end_tie"))
    ahead = F.struct(key.alias("k"), tie.alias("t")) < F.struct(end_key.alias("k"), end_tie.alias("t"))
    at = (key == end_key) & (tie == end_tie)
    # Without an end the budget of the last round is the whole source or nothing of it; rounding
    # a target up to the whole source is the only way to reach the former.
    extra = F.when(at, F.least(part, "size")).when(ahead, F.col("size")).otherwise(F.lit(0))
    rest = F.round(F.col("target") - epochs * F.col("source_size"))
    extra = F.when(rest >= F.col("source_size"), F.col("size")).otherwise(extra)
    taken = (epochs * F.col("size") + extra).cast("long")
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)
    return out.withColumns({"taken": taken}).withColumn("copies", copies.cast("int")).select(
        *docs.columns, *added
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: whole rows of ``docs``, repeated as often as the mix takes them."""
    again = F.array_repeat(F.lit(0), F.col("copies"))
    return mix(docs, **settings).select(*docs.columns, F.explode(again).alias("_again")).drop("_again")
