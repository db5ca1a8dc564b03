"""Two-objective skyline operators that never order all points in one task."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.scalars import must
from tracemill.operators.ordered import bucket_number, bucketed_rank, even_points
from tracemill.session import cut_lineage

RANGES = 256  # value ranges of the first objective whose best points are compared first


def _bucket(df: DataFrame, x: str, buckets: int) -> DataFrame:
    """Adds `_b`, the value range of `x` (equal values together), from a mergeable quantile sketch."""
    cuts = df.agg(F.percentile_approx(x, F.expr(even_points(buckets)), F.lit(1000)).alias("c")).scalar()
    return df.withColumn("_cuts", cuts).withColumn("_b", bucket_number("_cuts", x, buckets)).drop("_cuts")


def _first_best(df: DataFrame, f0: str, f1: str, tie_break: list[str]) -> DataFrame:
    """Per f0 only the smallest f1 can stay; a mergeable aggregate that also removes copies."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(F.col(f0).alias("_f0")).agg(F.min_by(whole, F.struct(f1, *tie_break)).alias("_row"), F.min(f1).alias("_f1"))


def pareto_front(df: DataFrame, f0: str, f1: str, tie_break: list[str] = (), buckets: int = RANGES) -> DataFrame:
    """Rows that no other row beats in both objectives (smaller is better); equal points collapse to one.

    f0 is cut into ranges and the best f1 of every range is collected: two scans that
    shuffle one small row per range. Each row is then compared with the best of all
    earlier ranges where it is read, which drops nearly everything before the only full
    shuffle: the exact running minimum of the survivors inside their range.
    """
    cut = _bucket(df, f0, buckets)
    best = cut.groupBy("_b").agg(F.min(f1).alias("_m")).select(
        "_b", F.min("_m").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_m")
    )
    bounds = best.agg(F.map_from_entries(F.collect_list(F.struct("_b", "_m"))).alias("m")).scalar()
    cut = cut.withColumn("_best", bounds).withColumn("_carry", F.try_element_at("_best", F.col("_b"))).drop("_best")
    alive = cut.filter(F.col("_carry").isNull() | (F.col(f1) < F.col("_carry"))).drop("_carry")
    firsts = _first_best(alive, f0, f1, tie_break)
    inside = F.min("_f1").over(W.partitionBy("_row._b").orderBy("_f0").rowsBetween(W.unboundedPreceding, -1))
    return firsts.withColumn("_in", inside).filter(F.col("_in").isNull() | (F.col("_f1") < F.col("_in"))).select("_row.*").drop("_b")


def pareto_layers(df: DataFrame, f0: str, f1: str, row_key: list[str], n_target: int, buckets: int = RANGES) -> DataFrame:
    """Successive fronts, numbered from 0, until at least `n_target` rows are collected or no row is left.

    `row_key` must be unique; a copy of a front point belongs to a later layer. A row that
    follows a chain of L ranges with non-decreasing best f1, all at most its own f1, cannot
    be in the first L layers. So the rows that can be are filtered out of `df` in one scan
    and checkpointed, fronts are peeled from those few, and L doubles when they run out.
    """
    cut = _bucket(df, f0, buckets)
    best = sorted((r["_b"], r["_m"]) for r in cut.groupBy("_b").agg(F.min(f1).alias("_m")).collect())  # one row per range
    found, collected, layer, depth = None, 0, 0, 8
    while collected < n_target:
        near = cut.withColumn("_limit", _chain_limit(best, depth)).filter(F.col("_limit").isNull() | (F.col("_limit") > F.col(f1)))
        near = cut_lineage(near.drop("_b", "_limit"))
        before = layer
        while collected < n_target and layer < depth:
            rest = near if found is None else near.join(found.select(*row_key), row_key, "left_anti")
            front = cut_lineage(pareto_front(rest, f0, f1, row_key, buckets).withColumn("layer", F.lit(layer)))
            n = front.count()
            if n == 0:
                break
            found = front if found is None else found.unionByName(front)
            collected, layer = collected + n, layer + 1
        if layer < depth and (layer == before or collected < n_target):
            break
        depth *= 2
    return df.limit(0).withColumn("layer", F.lit(0)) if found is None else found


def _chain_limit(best: list[tuple[int, float]], depth: int) -> Column:
    """Per range: the smallest f1 at which `depth` earlier ranges form a non-decreasing chain."""
    tails: list[float] = []
    entries: list[Column] = []
    for b, m in best:
        if len(tails) >= depth:
            entries += [F.lit(b), F.lit(tails[depth - 1])]
        i = bisect.bisect_right(tails, m)
        tails[i:i + 1] = [m]
    if not entries:
        return F.lit(None).cast("double")
    return F.try_element_at(F.create_map(*entries), F.col("_b"))


def dedup_rows(df: DataFrame, on: list[str], keep_first_by: list[str] | None = None) -> DataFrame:
    """One row per key; which one is fixed by `keep_first_by`."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    order = F.struct(*(keep_first_by or sorted(df.columns)))
    return df.groupBy(*[F.col(c).alias(f"_k_{c}") for c in on]).agg(F.min_by(whole, order).alias("_row")).select("_row.*")


def final_front(archives: list[DataFrame], config: list[str], valid: Column, f0: str = "cpi", f1: str = "cost") -> DataFrame:
    """Archives stacked, infeasible rows and copies of a configuration dropped, skyline ordered by cost.

    `valid` is a condition on the columns of `config`, so copies stay or go together: infeasible rows are dropped where they
    are read, and only the feasible ones are shuffled. These are kept once, as the skyline reads them several times.
    """
    stacked = archives[0].filter(valid)
    for a in archives[1:]:
        stacked = stacked.unionByName(a.filter(valid))
    unique = cut_lineage(dedup_rows(stacked, config, [f0, f1]))
    return pareto_front(unique, f0, f1, config).orderBy(f1)


def flag_validation(front: DataFrame, k: int, cpi: str = "cpi", cost: str = "cost", tie_break: list[str] = ()) -> DataFrame:
    """Marks the CPI optimum, the cost optimum and up to k - 2 points evenly spaced along the cost order."""
    cut = _bucket(front, cost, RANGES)
    ranked = bucketed_rank(cut, [], F.col("_b"), [cost, cpi, *tie_break], "_pos", "_n").drop("_b")
    best = front.agg(F.min(F.struct(cpi, cost, *tie_break)).alias("b")).scalar()
    extra = max(0, k - 2)
    spaced = F.transform(
        F.sequence(F.lit(1), F.lit(max(extra, 1))), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(extra + 1))
    )
    chosen = F.col("_pos") == 0
    if extra:
        chosen = chosen | ((F.col("_n") >= 2) & F.array_contains(spaced, F.col("_pos").cast("bigint")))
    return (
        ranked.withColumn("_best", best)
        .withColumn("validation_candidate", chosen | (F.struct(cpi, cost, *tie_break) == F.col("_best")))
        .drop("_pos", "_n", "_best")
    )


def rank_pick(df: DataFrame, keys: list[str], order: list[str | Column], n: int = 1) -> DataFrame:
    """First n rows per key as a mergeable aggregate (a heap per key, combined before the shuffle)."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if n == 1:
        return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min_by(whole, F.struct(*cols)).alias("_r")).select("_r.*")
    w = W.partitionBy(*keys).orderBy(*cols)
    # rank <= n lets Spark stop each group early on the map side (window group limit).
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def thin_series(df: DataFrame, pos: str, total: str, limit: int) -> DataFrame:
    """Rows at `limit` evenly spaced positions (both ends included); short series stay whole."""
    last, steps = F.col(total) - 1, limit - 1
    i = F.ceil(F.col(pos) * F.lit(steps) / last)
    return df.filter((F.col(total) <= limit) | (F.floor(i * last / F.lit(steps)) == F.col(pos)))


def first_rows(df: DataFrame, row_id: str, n: int) -> DataFrame:
    """Rows with 1-based id up to n: deterministic, unlike a bare limit."""
    return df.filter(must(F.col(row_id).isNotNull(), "row id is missing", F.col(row_id) <= n))
