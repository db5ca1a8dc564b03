"""Distribution encoding: exact percentiles, weight-proportional percentiles and the mean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.scalars import col_of
from tracemill.operators.ordered import prefix_length, value_buckets

# Percentile levels 1, 3, ..., 99.
PERCENT_POINTS = list(range(1, 100, 2))
VECTOR_LENGTH = 2 * len(PERCENT_POINTS) + 1


def vector_names(prefix: str) -> list[str]:
    raw = [f"{prefix}_raw_p{p}" for p in PERCENT_POINTS]
    weighted = [f"{prefix}_weighted_p{p}" for p in PERCENT_POINTS]
    return [*raw, *weighted, f"{prefix}_mean"]


def widen(vec: str | Column, prefix: str) -> list[Column]:
    """101 named columns from an encoded vector; for the sink only."""
    return [F.element_at(col_of(vec), i + 1).alias(n) for i, n in enumerate(vector_names(prefix))]


def _ranked_histogram(df: DataFrame, keys: list[str], x: str, limit: int | None) -> DataFrame:
    """One row per distinct value with its rank and weight ranges in the group.

    The first aggregation combines equal values on the map side. Groups with many
    distinct values are then split by value; group totals, range offsets and the
    neighbours across a split travel in one summary row per bucket.
    """
    hist = (
        df.select(*keys, F.col(x).cast("double").alias("_x"))
        .groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
        .filter(F.col("_c") > 0)
    )
    cut = value_buckets(hist, keys, "_x", "_b", limit).withColumn("_w", F.greatest("_x", F.lit(0.0)) * F.col("_c"))
    over_buckets = W.partitionBy(*keys).orderBy("_b")
    before = over_buckets.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    buckets = (
        cut.groupBy(*keys, "_b")
        .agg(
            F.sum("_c").alias("_bc"), F.sum("_w").alias("_bw"), F.sum(F.col("_x") * F.col("_c")).alias("_bs"),
            F.min("_x").alias("_bmin"), F.max("_x").alias("_bmax"),
        )
        .select(
            *keys, "_b",
            F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_c0"),
            F.coalesce(F.sum("_bw").over(before), F.lit(0.0)).alias("_w0"),
            F.lead("_bmin").over(over_buckets).alias("_next"),
            F.lag("_bmax").over(over_buckets).alias("_prev"),
            F.sum("_bc").over(whole).alias("_n"),
            F.sum("_bw").over(whole).alias("_wt"),
            F.sum("_bs").over(whole).alias("_s"),
        )
    )
    inside = W.partitionBy(*keys, "_b").orderBy("_x")
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    return (
        cut.withColumn("_ci", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
        .withColumn("_wi", F.coalesce(F.sum("_w").over(earlier), F.lit(0.0)))
        .withColumn("_xn", F.lead("_x").over(inside))
        .withColumn("_xp", F.lag("_x").over(inside))
        .join(buckets, [*keys, "_b"])
        .select(
            *keys, "_x", "_c", "_w", "_n", "_wt", "_s",
            (F.col("_c0") + F.col("_ci")).alias("_clo"),
            (F.col("_w0") + F.col("_wi")).alias("_wlo"),
            F.coalesce("_xn", "_next").alias("_xn"),
            F.coalesce("_xp", "_prev").alias("_xp"),
        )
    )


def _hits(points: list[float], first: Callable[[Column], Column], last: Callable[[Column], Column]) -> Column:
    """The points between two monotone conditions, found by binary search on the sorted list."""
    array = F.array(*[F.lit(float(p)) for p in points])
    n = len(points)
    lo = prefix_length(n, lambda i: first(F.get(array, i)), n)
    hi = prefix_length(n, lambda i: last(F.get(array, i)), n)
    return F.when(hi > lo, F.slice(array, lo + 1, F.greatest(hi - lo, F.lit(0)))).otherwise(F.expr("CAST(array() AS ARRAY<DOUBLE>)"))


def _raw_hits(points: list[float]) -> Column:
    """(point, value) pairs whose lower rank falls on this histogram row."""
    position = lambda p: (F.col("_n") - 1).cast("double") * p / 100.0
    lower = lambda p: F.floor(position(p))
    end = F.col("_clo") + F.col("_c")
    mine = _hits(points, lambda p: lower(p) < F.col("_clo"), lambda p: lower(p) < end)
    step = F.coalesce(F.col("_xn"), F.col("_x")) - F.col("_x")
    return F.transform(
        mine,
        lambda p: F.struct(
            p.alias("p"),
            F.when(lower(p) + 1 >= end, F.col("_x") + step * (position(p) - lower(p))).otherwise(F.col("_x")).alias("v"),
        ),
    )


def _weighted_hits(points: list[float]) -> Column:
    """(point, value) pairs whose share of the total weight falls on this row.

    Between the previous value and this one the value rises linearly over the
    weight of a single copy; further copies stay flat.
    """
    wlo, w, wt, x, xp = (F.col(c) for c in ("_wlo", "_w", "_wt", "_x", "_xp"))
    share = lambda p: p / 100.0 * wt
    mine = _hits(points, lambda p: share(p) <= wlo, lambda p: (w > 0) & ((share(p) <= wlo + w) | F.col("_xn").isNull()))
    rise = lambda p: (share(p) - wlo) / x
    return F.transform(
        mine,
        lambda p: F.struct(
            p.alias("p"),
            F.when(xp.isNull() | (rise(p) >= 1.0), x).otherwise(xp + (x - xp) * rise(p)).alias("v"),
        ),
    )


def _values(hits: str) -> Column:
    return F.transform(F.array_sort(F.flatten(F.collect_list(hits))), lambda s: s["v"])


def distribution(
    df: DataFrame, keys: list[str], x: str, points: list[float] | None = None,
    weighted: bool = True, limit: int | None = None,
) -> DataFrame:
    """keys -> n, mean, raw[], weighted[]; exact, with linear interpolation."""
    points = PERCENT_POINTS if points is None else points
    rows = _ranked_histogram(df, keys, x, limit).withColumn("_raw", _raw_hits(points))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<p: DOUBLE, v: DOUBLE>>)")
    rows = rows.withColumn("_weighted", _weighted_hits(points) if weighted else none)
    # Most histogram rows carry no percentile; only those that do are shuffled again.
    hits = rows.filter((F.size("_raw") > 0) | (F.size("_weighted") > 0))
    out = hits.groupBy(*keys).agg(
        F.first("_n").alias("n"),
        (F.first("_s") / F.first("_n")).alias("mean"),
        F.first("_wt").alias("_wt"),
        _values("_raw").alias("raw"),
        _values("_weighted").alias("weighted"),
    )
    if not weighted:
        return out.drop("_wt", "weighted")
    return out.withColumn("weighted", F.when(F.col("_wt") > 0, F.col("weighted")).otherwise(F.col("raw"))).drop("_wt")


def cdf_raw(df: DataFrame, keys: list[str], x: str, limit: int | None = None) -> DataFrame:
    return distribution(df, keys, x, weighted=False, limit=limit).select(*keys, "raw")


def cdf_weighted(df: DataFrame, keys: list[str], x: str, limit: int | None = None) -> DataFrame:
    return distribution(df, keys, x, limit=limit).select(*keys, "weighted")


def cdf_encode(df: DataFrame, keys: list[str], x: str, limit: int | None = None) -> DataFrame:
    """keys -> vec: raw percentiles, weighted percentiles, mean (101 doubles)."""
    d = distribution(df, keys, x, limit=limit)
    return d.select(*keys, F.concat("raw", "weighted", F.array("mean")).alias("vec"))


def small_domain_percentiles(df: DataFrame, keys: list[str], xs: dict[str, list[float]]) -> DataFrame:
    """Exact percentiles of columns with a bounded number of distinct values.

    Equal values are combined before the shuffle, so the final aggregation holds
    at most the domain (16-bit latencies, block sizes) per group.
    """
    parts = None
    for x, points in xs.items():
        hist = df.groupBy(*keys, F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
        wanted = F.array(*[F.lit(p / 100.0) for p in points])
        part = hist.groupBy(*keys).agg(
            F.percentile("_x", wanted, F.col("_c")).alias(f"{x}_pct"),
            (F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")).alias(f"{x}_mean"),
        )
        parts = part if parts is None else parts.join(part, keys)
    return parts


def throughput_summary(window_thr: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Window count and range of the throughput per parameter combination."""
    keys = keys or ["resource", "p0", "p1"]
    return window_thr.groupBy(*keys).agg(
        F.count("thr").alias("n_windows"), F.avg("thr").alias("avg_thr"),
        F.min("thr").alias("min_thr"), F.max("thr").alias("max_thr"),
    )


LOOKUP_KEYS = ["trace_id", "resource", "cfg_idx", "p0", "p1"]


def build_lookup(window_thr: DataFrame, limit: int | None = None) -> DataFrame:
    """Encoded vector of every (trace, resource, cache config, parameters) in one grouped job."""
    filled = window_thr
    for c in ("cfg_idx", "p1"):
        if c not in filled.columns:
            filled = filled.withColumn(c, F.lit(0))
    return cdf_encode(filled, LOOKUP_KEYS, "thr", limit)


def lookup_stats(lookup: DataFrame) -> DataFrame:
    return lookup.groupBy("trace_id", "resource").agg(F.count(F.lit(1)).alias("n_entries"))


def cumulative_weight(df: DataFrame, keys: list[str], x: str, limit: int | None = None) -> DataFrame:
    """Per distinct value: its copies and the share of the group's weight up to it."""
    rows = _ranked_histogram(df, keys, x, limit)
    return rows.select(
        *keys, F.col("_x").alias("x"), F.col("_c").alias("copies"),
        F.when(F.col("_wt") > 0, (F.col("_wlo") + F.col("_w")) / F.col("_wt")).otherwise(F.lit(0.0)).alias("cum_weight"),
    )
