"""Ordinal windows of a trace and the closed-form throughput bounds on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.opclass import fu_group, mask_flags
from tracemill.functions.registry import REGISTRY, Registry
from tracemill.operators.ordered import dim_join, last_before, prefix_sum

WINDOW_ROWS = 400  # fixed value: default window length


def instruction_flags(trace: DataFrame, opcodes: DataFrame | None = None) -> DataFrame:
    """is_load, is_store, first addresses, sync flag and the execution-class flags.

    Execution classes come from `opcodes` (opcode, mask: category bits, one row a mnemonic)
    when it is given; mnemonics that it doesn't list have none. Without it they come from
    the functional-unit group of the operation class.
    """
    out = (
        trace.withColumn("is_load", F.size("read_addrs") > 0)
        .withColumn("is_store", F.size("write_addrs") > 0)
        .withColumn("load_addr", F.get("read_addrs", F.lit(0)))
        .withColumn("store_addr", F.get("write_addrs", F.lit(0)))
    )
    if opcodes is not None:
        out = dim_join(out, opcodes.select("opcode", "mask"), ["opcode"]).withColumn("mask", F.coalesce("mask", F.lit(0)))
        return out.select("*", *[f.alias(n) for n, f in mask_flags().items()]).drop("mask")
    group = fu_group("op_class")
    return (
        out.withColumn("fu_group", group)
        .withColumn("is_alu", F.col("fu_group") == "int_alu")
        .withColumn("is_mult_div", F.col("fu_group") == "int_mult_div")
        .withColumn("is_simd", F.col("fu_group") == "simd_unit")
        .withColumn("is_fp", F.col("fu_group") == "fp_alu")
        .withColumn("is_fp_mult_div", F.col("fu_group") == "fp_mult_div")
    )


def ordinal_windows(trace: DataFrame, k: int = WINDOW_ROWS) -> DataFrame:
    """Tumbling windows of k rows; the last window of a trace may be shorter."""
    return trace.withColumn("window_id", F.floor(F.col("idx") / F.lit(k)))


COUNTED = {
    "n_alu": lambda: F.col("is_alu"),
    "n_mult_div": lambda: F.col("is_mult_div"),
    "n_fp": lambda: F.col("is_fp"),
    "n_fp_mult_div": lambda: F.col("is_fp_mult_div"),
    "n_load": lambda: F.col("is_load"),
    "n_store": lambda: F.col("is_store"),
    "n_sync": lambda: F.col("inst_sync"),
    "n_direct_cond": lambda: F.col("branch_type") == "direct_conditional",
    "n_direct_uncond": lambda: F.col("branch_type") == "direct_unconditional",
    "n_indirect": lambda: F.col("branch_type") == "indirect",
}


def count_columns() -> list[Column]:
    return [F.count(F.lit(1)).alias("size"), *[F.count_if(c()).alias(n) for n, c in COUNTED.items()]]


def window_counts(trace: DataFrame, k: int = WINDOW_ROWS, opcodes: DataFrame | None = None) -> DataFrame:
    """One row per (trace, window): its size and the number of rows of each class."""
    flagged = trace if "is_load" in trace.columns else instruction_flags(trace, opcodes)
    return ordinal_windows(flagged, k).groupBy("trace_id", "window_id").agg(*count_columns())


def issue_bound(n: Column, width: Column) -> Column:
    """Window size over the cycles needed to issue n rows, at least one cycle."""
    size = F.col("size").cast("double")
    return F.when(n == 0, size).otherwise(size / F.greatest(n.cast("double") / width, F.lit(1.0)))


def pipes_lower_bound(ls_pipes: Column, load_pipes: Column) -> Column:
    """Worst-case allocation: stores first, loads share every pipe."""
    loads, stores, size = F.col("n_load").cast("double"), F.col("n_store").cast("double"), F.col("size").cast("double")
    return F.when(loads + stores == 0, size).otherwise(size / (loads / (ls_pipes + load_pipes) + stores / ls_pipes))


def pipes_upper_bound(ls_pipes: Column, load_pipes: Column) -> Column:
    """Best-case allocation: load pipes work while the stores drain."""
    loads, stores, size = F.col("n_load").cast("double"), F.col("n_store").cast("double"), F.col("size").cast("double")
    drain = stores / ls_pipes
    rest = F.greatest(F.lit(0.0), loads - drain * load_pipes)
    return F.when(loads + stores == 0, size).otherwise(size / (drain + rest / (ls_pipes + load_pipes)))


# Pluggable per-window aggregates: resource name -> expression over the window
# counts and the swept parameters. Add an entry (and a registry resource) to extend.
Bound = Callable[[Column, Column], Column]
BOUNDS: dict[str, Bound] = {
    "alu_issue": lambda p0, p1: issue_bound(F.col("n_alu"), p0),
    "alu_mult_div_issue": lambda p0, p1: issue_bound(F.col("n_mult_div"), p0),
    "fp_issue": lambda p0, p1: issue_bound(F.col("n_fp"), p0),
    "fp_mult_div_issue": lambda p0, p1: issue_bound(F.col("n_fp_mult_div"), p0),
    "ls_issue": lambda p0, p1: issue_bound(F.col("n_load") + F.col("n_store"), p0),
    "load_ls_pipes_lower": pipes_lower_bound,
    "load_ls_pipes_upper": pipes_upper_bound,
}


def sweep_array(registry: Registry, resource: str) -> Column:
    """Array of {resource, p0, p1} over the resource's parameter ranges, last one fastest."""
    params = next(r for r in registry.resources if r.name == resource).params
    first = registry.by_name[params[0]].values()

    def row(a: Column, b: Column) -> Column:
        return F.struct(F.lit(resource).alias("resource"), a.cast("int").alias("p0"), b.cast("int").alias("p1"))

    if len(params) == 1:
        return F.transform(first, lambda a: row(a, F.lit(0)))
    second = registry.by_name[params[1]].values()
    return F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: row(a, b))))


def issue_throughput(counts: DataFrame, resource: str, registry: Registry = REGISTRY, bounds: dict[str, Bound] | None = None) -> DataFrame:
    """One resource over its whole sweep."""
    return window_throughput(counts, registry, [resource], bounds)


def window_throughput(
    counts: DataFrame, registry: Registry = REGISTRY, resources: list[str] | None = None,
    bounds: dict[str, Bound] | None = None,
) -> DataFrame:
    """Every enabled latency-independent resource and parameter combination per window.

    One pass over the counts: the sweep is a constant array that is exploded, and
    the bound is picked by resource, so nothing is joined or scanned twice.
    """
    bounds = {**BOUNDS, **(bounds or {})}
    if resources is None:
        resources = [r.name for r in registry.enabled_resources(latency_dependent=False)]
    missing = [r for r in resources if r not in bounds]
    if missing:
        raise ValueError(f"no bound registered for {missing}")
    combos = F.concat(*[sweep_array(registry, r) for r in resources])
    swept = counts.withColumn("_s", F.explode(combos)).select(
        "*", F.col("_s.resource").alias("resource"), F.col("_s.p0").alias("p0"), F.col("_s.p1").alias("p1")
    )
    return swept.select("trace_id", "resource", "p0", "p1", "window_id", _pick(resources, bounds, F.col("p0"), F.col("p1")).alias("thr"))


def _pick(resources: list[str], bounds: dict[str, Bound], p0: Column, p1: Column) -> Column:
    thr = F.lit(None).cast("double")
    for r in resources:
        thr = F.when(F.col("resource") == r, bounds[r](p0, p1)).otherwise(thr)
    return thr


def single_config_throughput(counts: DataFrame, config: dict[str, int], registry: Registry = REGISTRY, bounds: dict[str, Bound] | None = None) -> DataFrame:
    """The same bounds for exactly one value per parameter."""
    bounds = {**BOUNDS, **(bounds or {})}
    rows = [
        F.struct(
            F.lit(r.name).alias("resource"),
            F.lit(int(config[r.params[0]])).alias("p0"),
            F.lit(int(config[r.params[1]]) if len(r.params) > 1 else 0).alias("p1"),
        )
        for r in registry.enabled_resources(latency_dependent=False)
    ]
    names = [r.name for r in registry.enabled_resources(latency_dependent=False)]
    swept = counts.withColumn("_s", F.explode(F.array(*rows))).select("*", "_s.resource", "_s.p0", "_s.p1")
    return swept.select("trace_id", "resource", "p0", "p1", "window_id", _pick(names, bounds, F.col("p0"), F.col("p1")).alias("thr"))


def block_id(trace: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Number of taken branches strictly before each row."""
    taken = F.when(F.col("branch_type").isNotNull() & F.col("taken"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return prefix_sum(trace, ["trace_id"], ["idx"], taken, "block_id", segment_rows)


def wrapping_difference(a: str, b: str) -> Column:
    """a - b of unsigned 64-bit addresses; widened only where the BIGINT difference overflows."""
    exact = F.col(a).cast("decimal(20,0)") - F.col(b).cast("decimal(20,0)")
    return F.coalesce(F.try_subtract(F.col(a), F.col(b)).cast("decimal(20,0)"), exact.cast("decimal(20,0)"))


def lag_delta(trace: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Loads only: difference of the first read address to the previous load of the same ip."""
    loads = trace.filter(F.size("read_addrs") > 0).select("trace_id", "idx", "ip", F.get("read_addrs", F.lit(0)).alias("addr"))
    lagged = last_before(loads, ["trace_id", "ip"], ["idx"], "addr", "prev_addr", segment_rows)
    return lagged.withColumn("delta", wrapping_difference("addr", "prev_addr"))


def reuse_profile(trace: DataFrame, gaps: list[int] = (1, 16, 256, 4096), line_bytes: int = 64, segment_rows: int | None = None) -> DataFrame:
    """Per trace: touched lines, first-touch share and the share of accesses reused within each gap."""
    shift = line_bytes.bit_length() - 1
    accesses = trace.select(
        "trace_id", "idx", F.posexplode(F.concat("read_addrs", "write_addrs")).alias("pos", "addr")
    ).withColumn("line", F.shiftrightunsigned("addr", shift))
    seen = last_before(accesses, ["trace_id", "line"], ["idx", "pos"], "idx", "prev_idx", segment_rows)
    gap = F.col("idx") - F.col("prev_idx")
    total = F.count(F.lit(1))
    return seen.groupBy("trace_id").agg(
        total.alias("n_accesses"),
        F.count_if(F.col("prev_idx").isNull()).alias("n_lines"),
        (F.count_if(F.col("prev_idx").isNull()) / total).alias("first_touch_share"),
        *[(F.count_if(gap <= c) / total).alias(f"reuse_within_{c}") for c in gaps],
    )


def outcome_predictability(trace: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Per branch ip: how well a majority vote or the previous outcome would predict it.

    Only conditional branches can miss; all branches count in `n_branches`.
    """
    branches = trace.filter(F.col("branch_type").isNotNull()).select(
        "trace_id", "idx", "ip", F.col("taken").cast("int").alias("taken"),
        (F.col("branch_type") == "direct_conditional").alias("cond"),
    )
    watched = last_before(branches, ["trace_id", "ip"], ["idx"], F.when(F.col("cond"), F.col("taken")), "prev_taken", segment_rows)
    n, n_cond, n_taken = F.count(F.lit(1)), F.count_if("cond"), F.count_if(F.col("cond") & (F.col("taken") == 1))
    return watched.groupBy("trace_id", "ip").agg(
        n.alias("n_branches"),
        F.avg("taken").alias("taken_share"),
        (F.least(n_taken, n_cond - n_taken) / n).alias("majority_miss_rate"),
        (F.count_if(F.col("cond") & (F.col("prev_taken") != F.col("taken"))) / n).alias("previous_miss_rate"),
    )
