"""Numbering, running totals and look-ups that survive one key holding most of the rows.

A plain window over ``key`` sorts all rows of the key in one task. Here the rows of a key are
first cut into buckets by a value that grows with their order, numbered or summed within each
bucket, and only the per-bucket totals, one small row each, meet in a window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key per bucket when the order is an integer position.
BUCKET = 4096


def bucket_of(position: str, size: int = BUCKET) -> Column:
    return F.floor(F.col(position) / size).cast("long")


def minute_of(timestamp: str) -> Column:
    """Bucket for rows ordered by time."""
    return F.date_trunc("minute", F.col(timestamp))


def _place(keys: list[str], bucket: Column) -> Column:
    """Key and bucket in one struct: never NULL itself, so rows without a key join as well."""
    return F.struct(*keys, bucket.alias("bucket"))


def _with_offsets(cut: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Add ``_before``, what the earlier buckets of the key sum up to."""
    totals = cut.groupBy("_place").agg(F.sum(amount).alias("_total"))
    earlier = (
        Window.partitionBy(*[f"_place.{key}" for key in keys]).orderBy("_place.bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("_total").over(earlier), F.lit(0))
    return cut.join(totals.select("_place", before.alias("_before")), "_place")


def number_rows(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, into: str
) -> DataFrame:
    """1-based position of every row within its key."""
    cut = df.withColumn("_place", _place(keys, bucket))
    within = Window.partitionBy("_place").orderBy(*order)
    # The window comes first: the join that follows needs the same distribution.
    numbered = cut.withColumn("_row", F.row_number().over(within))
    return (
        _with_offsets(numbered, keys, F.lit(1))
        .withColumn(into, (F.col("_row") + F.col("_before")).cast("long"))
        .drop("_place", "_row", "_before")
    )


def total_before(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, amount: Column, into: str
) -> DataFrame:
    """Sum of ``amount`` over the rows of the key that come earlier."""
    cut = df.withColumn("_place", _place(keys, bucket)).withColumn("_amount", amount.cast("long"))
    within = (
        Window.partitionBy("_place").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = cut.withColumn("_sum", F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    return (
        _with_offsets(summed, keys, F.col("_amount"))
        .withColumn(into, F.col("_sum") + F.col("_before"))
        .drop("_place", "_amount", "_sum", "_before")
    )


def first_rows(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, n: int, into: str
) -> DataFrame:
    """The first ``n`` rows of every key with their position.

    The rank filter lets Spark drop rows before the shuffle; taking it per bucket first bounds
    what a key sends to its last task by ``n`` rows per bucket.
    """
    cut = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        cut.withColumn(into, F.row_number().over(inner)).where(F.col(into) <= n)
        .withColumn(into, F.row_number().over(outer)).where(F.col(into) <= n)
        .drop("_bucket")
    )


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    spread: list[str] | None = None,
    hot_rows: int = 1_000_000,
    hot_keys: int = 1000,
) -> DataFrame:
    """Join to at most one right row per key when some left keys may be very frequent.

    The most frequent keys, at most ``hot_keys`` of them and only such with ``hot_rows`` or
    more, are broadcast with their right rows: a list of fixed maximal length. Left rows of
    those keys are served from it and, like rows without a key, go through the shuffle of the
    remaining join under a hash of the ``spread`` columns, so no task gets all of them. A key
    that is not on the list is either small or one of very many.
    """
    values = [c for c in right.columns if c not in keys]
    frequent = (
        left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows)
        .orderBy(F.desc("_n"), *keys).limit(hot_keys).select(*keys)
    )
    row = F.struct(F.lit(True).alias("found"), *values)
    served = right.join(F.broadcast(frequent), keys).select(*keys, row.alias("_near"))
    listed = frequent.join(F.broadcast(served), keys, "left").withColumn("_hot", F.lit(True))

    staged = left.join(F.broadcast(listed), keys, "left")
    elsewhere = F.col("_hot").isNotNull()
    for key in keys:
        elsewhere = elsewhere | F.col(key).isNull()
    far_keys = {f"_far_{key}": F.when(~elsewhere, F.col(key)) for key in keys}
    apart = F.when(elsewhere, F.xxhash64(*(spread or left.columns))).otherwise(F.lit(0))
    staged = staged.withColumns({**far_keys, "_salt": apart})
    far = right.select(
        *[F.col(key).alias(f"_far_{key}") for key in keys],
        F.lit(0).cast("long").alias("_salt"),
        row.alias("_row"),
    )
    joined = staged.join(far, [*far_keys, "_salt"], "left").withColumn(
        "_row", F.coalesce("_near", "_row")
    )
    if how == "inner":
        joined = joined.where("_row.found")
    return joined.select(*left.columns, *[F.col("_row")[v].alias(v) for v in values])
