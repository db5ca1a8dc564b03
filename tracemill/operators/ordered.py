"""Ordered and skew-safe building blocks.

A window over one hot key would sort that key in a single task. Every helper here
splits a key into bounded pieces (row-number segments, hash buckets or value
buckets), works inside the pieces, and carries one small summary row per piece.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.scalars import col_of, hash_hex
from tracemill.session import cut_lineage

SEGMENT_ROWS = 1 << 20      # rows of one key that a window may sort in one task
BUCKET_ROWS = 1 << 18       # distinct values of one group before it is split by value
PICK_ROWS = 1 << 14         # rows of a hash range where only the first rows of a key are wanted
FAN = 256                   # pieces that a large piece is split into by value at one level
SMALL_ROWS = 100_000        # rows of a per-key table that is broadcast
BLOCK_PAIRS = 1 << 22       # combinations that one block of a product makes


def _before(w: W) -> W:
    return w.rowsBetween(W.unboundedPreceding, -1)


def last_before(
    df: DataFrame, keys: list[str], order: list[str], value: str | Column, out: str, segment_rows: int | None = None
) -> DataFrame:
    """Latest earlier non-null `value` of the same key (an as-of lookup in row order).

    `order[0]` must be a BIGINT position; segments are ranges of it.
    """
    rows = segment_rows or SEGMENT_ROWS
    cut = df.withColumn("_v", col_of(value)).withColumn("_seg", F.floor(F.col(order[0]) / F.lit(rows)))
    inside = F.last("_v", ignorenulls=True).over(_before(W.partitionBy(*keys, "_seg").orderBy(*order)))
    closing = cut.groupBy(*keys, "_seg").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last")
    )
    carry = closing.select(
        *keys, "_seg",
        F.last("_last", ignorenulls=True).over(_before(W.partitionBy(*keys).orderBy("_seg"))).alias("_carry"),
    ).filter(F.col("_carry").isNotNull())
    return (
        cut.withColumn("_in", inside)
        .join(carry, [*keys, "_seg"], "left")
        .withColumn(out, F.coalesce("_in", "_carry"))
        .drop("_v", "_seg", "_in", "_carry")
    )


def _running(
    df: DataFrame, keys: list[str], order: list[str], value: str | Column, out: str, segment_rows: int | None,
    aggregate: Callable[[str], Column], combine: Callable[[Column, Column], Column],
) -> DataFrame:
    """Aggregate of all earlier rows in two levels: inside a segment, then over earlier segments."""
    rows = segment_rows or SEGMENT_ROWS
    cut = df.withColumn("_v", col_of(value)).withColumn("_seg", F.floor(F.col(order[0]) / F.lit(rows)))
    inside = aggregate("_v").over(_before(W.partitionBy(*keys, "_seg").orderBy(*order)))
    totals = cut.groupBy(*keys, "_seg").agg(aggregate("_v").alias("_t"))
    carry = totals.select(
        *keys, "_seg", aggregate("_t").over(_before(W.partitionBy(*keys).orderBy("_seg"))).alias("_carry")
    ).filter(F.col("_carry").isNotNull())
    return (
        cut.withColumn("_in", inside)
        .join(carry, [*keys, "_seg"], "left")
        .withColumn(out, combine(F.col("_in"), F.col("_carry")))
        .drop("_v", "_seg", "_in", "_carry")
    )


def prefix_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str | Column, out: str, segment_rows: int | None = None
) -> DataFrame:
    """Exclusive running sum in row order; 0 for the first row."""
    zero = F.lit(0)
    return _running(df, keys, order, value, out, segment_rows, F.sum, lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero))


def prefix_min(
    df: DataFrame, keys: list[str], order: list[str], value: str | Column, out: str, segment_rows: int | None = None
) -> DataFrame:
    """Exclusive running minimum in row order; NULL for the first row."""
    return _running(df, keys, order, value, out, segment_rows, F.min, lambda a, b: F.least(a, b))


def bucketed_rank(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str | Column], out: str, total: str | None = None
) -> DataFrame:
    """0-based position of each row inside its key, and optionally the key's row count.

    `bucket` must be monotone in `order`; only one bucket is sorted per task.
    """
    cut = df.withColumn("_b", bucket)
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)) - 1
    counts = cut.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *keys, "_b",
        F.coalesce(F.sum("_n").over(_before(W.partitionBy(*keys).orderBy("_b"))), F.lit(0)).alias("_off"),
        F.sum("_n").over(W.partitionBy(*keys)).alias("_all"),
    )
    ranked = cut.withColumn("_in", inside).join(offsets, [*keys, "_b"]).withColumn(out, F.col("_in") + F.col("_off"))
    if total:
        ranked = ranked.withColumn(total, F.col("_all"))
    return ranked.drop("_b", "_in", "_off", "_all")


def _hash_buckets(df: DataFrame, keys: list[str], row_key: list[str], seed: int | str, hashed: Column | None, rows: int, keep: Callable[[DataFrame], DataFrame] = lambda sizes: sizes) -> DataFrame:
    """Adds `_size` (rows of the key), `_h` (hex hash) and `_b` (range of the hash values, about `rows` rows each).

    `keep` may mark the sizes for broadcast, at the price of a scan at plan time.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    sized = df.join(keep(sizes), keys) if keys else df.withColumn("_size", sizes.scalar())
    with_hash = sized.withColumn("_h", hash_hex(row_key, seed) if hashed is None else hashed)
    pieces = F.ceil(F.col("_size") / F.lit(rows))
    return with_hash.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") * pieces / F.lit(float(1 << 32))))


def hash_rank(
    df: DataFrame, keys: list[str], row_key: list[str], seed: int | str, out: str,
    total: str | None = None, hashed: Column | None = None, bucket_rows: int | None = None,
) -> DataFrame:
    """Random but reproducible position inside each key: order of md5(row key, seed), or of another hex hash.

    Hash values are uniform, so equal ranges of them are balanced buckets even when one key
    holds most rows. A key of n rows gets n / bucket_rows of them. `row_key` must be unique.
    """
    cut = _hash_buckets(df, keys, row_key, seed, hashed, bucket_rows or BUCKET_ROWS)
    ranked = bucketed_rank(cut, keys, F.col("_b"), ["_h", *row_key], out).drop("_h")
    return ranked.withColumnRenamed("_size", total) if total else ranked.drop("_size")


def hash_first(df: DataFrame, keys: list[str], row_key: list[str], seed: int | str, wanted: Column, bucket_rows: int | None = None) -> DataFrame:
    """The rows of each key whose `hash_rank` is below `wanted`, an expression over the key's row count `_size`.

    Counts of the hash ranges tell which of them the wanted rows are in; the rows of the other ranges are dropped where they
    are read, so that what is shuffled and sorted follows `wanted` and not the table.
    """
    cut = _hash_buckets(df, keys, row_key, seed, None, bucket_rows or PICK_ROWS, small_broadcast)
    counts = cut.groupBy(*keys, "_size", "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(_before(W.partitionBy(*keys).orderBy("_b"))), F.lit(0))
    near = small_broadcast(counts.withColumn("_off", earlier).filter(F.col("_off") < wanted).select(*keys, "_b", "_off"))
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_h", *row_key)) - 1
    ranked = cut.join(near, [*keys, "_b"]).withColumn("_at", inside + F.col("_off"))
    return ranked.filter(F.col("_at") < wanted).select(*df.columns)


def small_broadcast(dim: DataFrame) -> DataFrame:
    """Keeps a per-key table once and marks it for broadcast if it is counted small: the large side of a join is then not shuffled."""
    kept = cut_lineage(dim)
    return F.broadcast(kept) if kept.count() <= SMALL_ROWS else kept


def prefix_length(length: int | Column, holds: Callable[[Column], Column], longest: int) -> Column:
    """Binary search: how many leading positions (0-based) satisfy a condition that holds on a prefix only."""
    steps = [1 << i for i in reversed(range(max(longest, 1).bit_length()))]
    size = F.lit(length) if isinstance(length, int) else length

    def step(pos: Column, width: Column) -> Column:
        more = (pos + width <= size) & holds(pos + width - 1)
        return F.when(F.coalesce(more, F.lit(False)), pos + width).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), step)


@functools.cache
def even_points(n: int) -> str:
    """SQL text of the array 1/n, 2/n ... (n-1)/n: one expression, as a call for each number is slow in the driver."""
    return "array(" + ", ".join(f"{i / n!r}D" for i in range(1, n)) + ")"


def bucket_number(cuts: str | Column, x: str | Column, longest: int) -> Column:
    """Number of sorted split points below `x`; equal values get the same number."""
    c = col_of(cuts)
    return F.coalesce(prefix_length(F.size(c), lambda i: F.get(c, i) < col_of(x), longest), F.lit(0))


def value_buckets(df: DataFrame, keys: list[str], x: str, out: str, limit: int | None = None, fan: int | None = None) -> DataFrame:
    """Bucket number (long) that is monotone in `x`: 0 for groups of up to `limit` rows, else pieces of about that size.

    A sample sort of several levels. Pieces above the limit are split at up to `fan` points of a mergeable quantile sketch
    and counted again, until every piece fits or holds one value: equal values share a bucket, no group is gathered whole,
    and a group of any size ends in pieces of bounded size. A split also takes the smallest value out, so each level makes
    every piece smaller. One count at plan time decides each level; where no group is large, nothing else is done. The rows
    are checkpointed before the first split and after each. Groups with a null key are left whole.
    """
    limit, fan = limit or BUCKET_ROWS, fan or FAN
    cut, pieces = df.withColumn(out, F.lit(0).cast("bigint")), [*keys, out]
    known = [F.col(k).isNotNull() for k in keys]
    level = 0
    while True:
        sizes = cut.groupBy(*pieces).agg(F.count(F.lit(1)).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        large = sizes.filter((F.col("_n") > limit) & (F.col("_lo") < F.col("_hi")))
        for k in known:
            large = large.filter(k)
        if large.isEmpty():
            return cut
        if not level:
            cut = cut_lineage(cut)
        sketch = cut.select(*pieces, x).join(large.select(*pieces, "_n", "_lo"), pieces).groupBy(*pieces, "_n", "_lo").agg(
            F.percentile_approx(x, F.expr(even_points(fan)), F.lit(20 * fan)).alias("_sketch"))
        wanted = F.least(F.ceil(F.col("_n") / F.lit(limit)) - 1, F.lit(fan - 1)).cast("int")
        thinned = F.transform(F.sequence(F.lit(1), wanted), lambda i: F.get("_sketch", (i * fan / (wanted + 1)).cast("int") - 1))
        cuts = sketch.select(*pieces, F.array_sort(F.array_distinct(F.concat(F.array("_lo"), thinned))).alias("_cuts"))
        cut = cut_lineage(cut.join(cuts, pieces, "left").withColumn(out, F.col(out) * (fan + 1) + bucket_number("_cuts", x, fan)).drop("_cuts"))
        level += 1


def dim_join(big: DataFrame, dim: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join of a large side with a per-key dimension; building it runs no job.

    The strategy is left to Spark's sizes at run time: a dimension that turns out small is
    broadcast below spark.sql.autoBroadcastJoinThreshold, and partitions of a hot key are
    split by the adaptive skew join, which can split the large side of these join types.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"the large side must be kept or filtered; {how!r} does neither")
    return big.join(dim, on, how)


def block_product(left: DataFrame, right: DataFrame, right_key: list[str], block_pairs: int | None = None) -> DataFrame:
    """Every (left, right) combination through an equi-join on a block number.

    `right` rows are dealt over blocks by hash and `left` is repeated once per block, so the
    work is spread evenly and the left side should be the small one. The number of blocks
    follows the counted rows, so a block makes about `block_pairs` combinations.
    """
    rows = lambda df: df.select(F.count(F.lit(1)).alias("n")).scalar()
    blocks = F.greatest(F.ceil(rows(left) * rows(right) / F.lit(float(block_pairs or BLOCK_PAIRS))), F.lit(1))
    dealt = right.withColumn("_block", F.pmod(F.xxhash64(*right_key), blocks))
    repeated = left.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    return repeated.join(dealt, "_block").drop("_block")
