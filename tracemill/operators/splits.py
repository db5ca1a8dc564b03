"""Reproducible samples and leak-free train/test splits.

Random order is md5(key, seed), so a split does not depend on partitioning and can
be recomputed anywhere. Exact counts come from `hash_rank`, which never sorts more
than one hash bucket per task. A split is one DataFrame with a column `part`, `train`
or `test`; rows of neither part are not in it. `parts` makes two DataFrames of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import all_of, hash_hex, hash_uniform, must
from tracemill.operators.encode import distribution
from tracemill.operators.ordered import dim_join, hash_first, hash_rank
from tracemill.session import cut_lineage


def _test_count(total: str, test: float) -> Column:
    """Rows of the test part: the share rounded up."""
    return F.ceil(F.lit(test) * F.col(total) - F.lit(1e-9))


def _part(is_test: Column) -> Column:
    return F.when(is_test, F.lit("test")).otherwise(F.lit("train"))


def parts(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of a split. Whoever reads both should keep the split first."""
    return split.filter("part = 'train'").drop("part"), split.filter("part = 'test'").drop("part")


def random_split(df: DataFrame, key: list[str], test: float, seed: int | str, exact: bool = True) -> DataFrame:
    """Share `test` of the rows, exactly (ranked) or in expectation (threshold, no shuffle)."""
    if not exact:
        return df.withColumn("part", _part(hash_uniform(key, seed) < test))
    ranked = hash_rank(df, [], key, seed, "_rank", "_total")
    return ranked.withColumn("part", _part(F.col("_rank") < _test_count("_total", test))).drop("_rank", "_total")


def _held_out(df: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    flagged = dim_join(df, chosen.select(*on).withColumn("_test", F.lit(True)), on, "left")
    return flagged.withColumn("part", _part(F.col("_test").isNotNull())).drop("_test")


def _config_chosen(df: DataFrame, config: list[str], frac: float, seed: int | str) -> Column:
    """Whether a row's configuration is among the share with the first hashes.

    The hash of the last chosen configuration decides, so rows are neither joined nor sorted. Configurations with a null are never chosen.
    """
    ranked = hash_rank(cut_lineage(df.select(*config).distinct()), [], config, seed, "_rank", "_total")
    place = F.struct(hash_hex(config, seed).alias("_h"), *config)
    last = ranked.filter(F.col("_rank") == F.floor(F.lit(frac) * F.col("_total")) - 1).select(place.alias("last")).scalar()
    return F.coalesce(all_of([F.col(c).isNotNull() for c in config]) & (place <= last), F.lit(False))


def holdout_configs(df: DataFrame, config: list[str], frac: float, seed: int | str) -> DataFrame:
    """Whole configurations move to the test part."""
    return df.withColumn("part", _part(_config_chosen(df, config, frac, seed)))


def chosen_regions(df: DataFrame, frac: float, seed: int | str, region: str = "region") -> DataFrame:
    regions = df.select("benchmark", region).distinct()
    ranked = hash_rank(regions, ["benchmark"], ["benchmark", region], seed, "_rank", "_total")
    n = F.floor(F.lit(frac) * F.col("_total"))
    text = F.concat(F.lit("no test region for benchmark "), F.col("benchmark"))
    return ranked.filter(must(n > 0, text, F.col("_rank") < n)).select("benchmark", region)


def holdout_regions(df: DataFrame, frac: float, seed: int | str, region: str = "region") -> DataFrame:
    """A share of each benchmark's regions moves to the test part; too few regions fail the job."""
    return _held_out(df, chosen_regions(df, frac, seed, region), ["benchmark", region])


def holdout_both(df: DataFrame, config: list[str], config_frac: float, region_frac: float, seed: int | str, region: str = "region") -> DataFrame:
    """Test: held-out configurations in held-out regions; train: neither."""
    reg = chosen_regions(df, region_frac, seed, region).withColumn("_r", F.lit(True))
    flagged = dim_join(df.withColumn("_c", _config_chosen(df, config, config_frac, seed)), reg, ["benchmark", region], "left")
    return flagged.filter(F.col("_c") == F.col("_r").isNotNull()).withColumn("part", _part(F.col("_c"))).drop("_c", "_r")


def holdout_benchmark(df: DataFrame, name: str, key: list[str], onboard: int = 0, seed: int | str = 0, train_benchmarks: list[str] | None = None) -> DataFrame:
    """One benchmark is the test set; `onboard` of its rows may return to training.

    Fails when the benchmark has no row left for the test set.
    """
    train = df.filter(F.col("benchmark") != name)
    if train_benchmarks is not None:
        train = train.filter(F.col("benchmark").isin(train_benchmarks))
    pool = hash_rank(df.filter(F.col("benchmark") == name), [], key, seed, "_rank", "_total")
    pool = pool.filter(must(F.col("_total") > onboard, f"benchmark {name} has too few rows to onboard {onboard}", F.lit(True)))
    pool = pool.withColumn("part", _part(F.col("_rank") >= onboard)).drop("_rank", "_total")
    return train.withColumn("part", F.lit("train")).unionByName(pool)


def single_benchmark_split(df: DataFrame, name: str, key: list[str], test: float, seed: int | str, others: list[str] | None = None) -> DataFrame:
    """Split inside one benchmark; rows of the `others` join the training part."""
    split = random_split(df.filter(F.col("benchmark") == name), key, test, seed)
    if others:
        more = df.filter(F.col("benchmark").isin(others) & (F.col("benchmark") != name))
        split = split.unionByName(more.withColumn("part", F.lit("train")))
    return split


def _first_by_hash(df: DataFrame, group: list[str], key: list[str], seed: int | str) -> DataFrame:
    """The row with the smallest hash per group: a mergeable aggregate, so a hot group is pre-reduced everywhere."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    order = F.struct(hash_hex(key, seed), *[F.col(k) for k in key])
    return df.groupBy(*group).agg(F.min_by(whole, order).alias("_row")).select("_row.*")


def one_config_per_region(df: DataFrame, key: list[str], seed: int | str, region: str = "region") -> DataFrame:
    return _first_by_hash(df, ["benchmark", region], key, seed)


def one_region_per_benchmark(df: DataFrame, seed: int | str, region: str = "region") -> DataFrame:
    """All rows of one random region of each benchmark."""
    regions = df.select("benchmark", region).distinct()
    chosen = _first_by_hash(regions, ["benchmark"], ["benchmark", region], seed)
    return dim_join(df, chosen, ["benchmark", region], "left_semi")


def stratified_sample(df: DataFrame, n: int, key: list[str], seed: int) -> DataFrame:
    """n rows, proportional per benchmark (rounded), topped up from the rest when rounding falls short.

    Only the rows with the first hashes are ranked. The rest's first rows are among the first n of the whole table under
    the second seed, as no more than n minus the missing ones are picked before.
    """
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    share = F.least(F.lit(1.0), F.lit(float(n)) / total)
    picked = cut_lineage(hash_first(df, ["benchmark"], key, seed, F.rint(share * F.col("_size"))))
    short = n - picked.count()
    if short <= 0:
        return picked
    taken = picked.select(*[F.col(k).alias(f"_t_{k}") for k in key])
    same = reduce(lambda a, c: a & c, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in key])
    rest = hash_first(df, [], key, seed + 1, F.lit(n)).join(taken, same, "left_anti")
    return picked.unionByName(hash_first(rest, [], key, seed + 1, F.lit(short)))


def quantile_edges(df: DataFrame, x: str, q: int) -> DataFrame:
    """One row, `edges`: equal-frequency bin edges with duplicates dropped."""
    d = distribution(df.withColumn("_all", F.lit(1)), ["_all"], x, points=[100.0 * i / q for i in range(q + 1)], weighted=False)
    return d.select(F.array_distinct("raw").alias("edges"))


def quantile_bins(df: DataFrame, x: str, q: int, out: str = "bin") -> DataFrame:
    """0-based equal-frequency bin; bins are closed on the right and the first also on the left."""
    edges = quantile_edges(df, x, q).scalar()
    below = F.size(F.filter("_e", lambda e: e < F.col(x)))
    return df.withColumn("_e", edges).withColumn(out, F.greatest(below - 1, F.lit(0))).drop("_e")


def stratified_split(df: DataFrame, x: str, bins: int, test: float, key: list[str], seed: int | str) -> DataFrame:
    """Random split inside each quantile bin of `x`."""
    ranked = hash_rank(quantile_bins(df, x, bins, "_bin"), ["_bin"], key, seed, "_rank", "_total")
    return ranked.withColumn("part", _part(F.col("_rank") < _test_count("_total", test))).drop("_bin", "_rank", "_total")


def shared_keys(train: DataFrame, test: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys that occur in both parts."""
    return train.select(*on).distinct().join(test.select(*on).distinct(), on, "left_semi")


def leak_report(split: DataFrame, config: list[str], region: list[str]) -> DataFrame:
    """One row: duplicate keys in and across the parts, shared configurations, shared regions.

    The split is read once: rows are counted by key in each part, and configurations and regions from those counts. The rows'
    own figures are added up on the way; only configurations and regions are grouped again.
    """
    row = [*config, *region]
    n_train, n_test = F.count_if(F.col("part") == "train"), F.count_if(F.col("part") == "test")
    by_row = split.groupBy(*row).agg(n_train.alias("_train"), n_test.alias("_test"))
    levels = F.explode(F.array(*[F.lit(x) for x in ("row", "config", "region")]))
    long = by_row.withColumn("_level", levels)
    for c in row:
        of = [level for level, cols in (("config", config), ("region", region)) if c in cols]
        long = long.withColumn(c, F.when(F.col("_level").isin(of), F.col(c)))
    here = F.col("_level") == "row"
    counts = long.groupBy("_level", *row).agg(
        F.sum("_train").alias("_train"), F.sum("_test").alias("_test"),
        F.sum(F.when(here & (F.col("_train") > 1), F.col("_train") - 1)).alias("_train_twice"),
        F.sum(F.when(here & (F.col("_test") > 1), F.col("_test") - 1)).alias("_test_twice"),
        F.count_if(here & (F.col("_train") > 0) & (F.col("_test") > 0)).alias("_shared"),
    )
    shared = lambda level: F.count_if((F.col("_level") == level) & (F.col("_train") > 0) & (F.col("_test") > 0))
    added = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counts.agg(
        added("_train_twice").alias("train_duplicates"), added("_test_twice").alias("test_duplicates"), added("_shared").alias("shared_rows"),
        shared("config").alias("shared_configs"), shared("region").alias("shared_regions"),
    )


def assert_no_leak(split: DataFrame, config: list[str], region: list[str], checks: list[str]) -> None:
    """Raises when a named count of the leak report is not zero."""
    found = leak_report(split, config, region).first().asDict()
    broken = {c: found[c] for c in checks if found[c]}
    if broken:
        raise ValueError(f"train and test overlap: {broken}")


def intersect_keys(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))


def except_rows(df: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    return dim_join(df, chosen.select(*on).distinct(), on, "left_anti")


def stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, c: a.unionByName(c), parts)


def ablation_masks(groups: list[str]) -> Column:
    """Array of {mask, label, dropped[]} over all subsets of the feature groups."""
    names = F.array(*[F.lit(g) for g in groups])

    def row(mask: Column) -> Column:
        dropped = F.filter(names, lambda g, i: F.getbit(mask, i) == 1)
        label = F.when(F.size(dropped) == 0, F.lit("keep_all")).otherwise(F.concat(F.lit("drop_"), F.array_join(dropped, "+")))
        return F.struct(mask.alias("mask"), label.alias("label"), dropped.alias("dropped"))

    return F.transform(F.sequence(F.lit(0), F.lit(2 ** len(groups) - 1)), row)


def run_matrix(base: DataFrame, axes: dict[str, list], groups: list[str] | None = None) -> DataFrame:
    """Experiment runs: every base row (for example a benchmark) with every axis value and ablation subset."""
    out = base
    if groups:
        out = out.select("*", F.inline(ablation_masks(groups)))
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def conflict_pairs(benchmarks: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Pairs (benchmark, partner) listed in `conflicts` whose members both exist."""
    known = benchmarks.select("benchmark").distinct()
    kept = conflicts.join(known, "benchmark", "left_semi")
    return kept.join(known.select(F.col("benchmark").alias("partner")), "partner", "left_semi").select("benchmark", "partner")


