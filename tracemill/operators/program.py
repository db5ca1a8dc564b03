"""Program behaviour of a trace: mixes, dependencies, blocks, memory access patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.opclass import FU_GROUPS, fu_group
from tracemill.functions.scalars import must, safe_div
from tracemill.operators.encode import distribution, small_domain_percentiles
from tracemill.operators.ordered import dim_join, last_before
from tracemill.operators.windows import block_id, lag_delta
from tracemill.session import cut_lineage

PAGE_BITS = 12              # fixed value: 4 KiB pages
DEP_WINDOW = 16             # fixed value: a dependency farther than this counts as independent
CRIT_THRESHOLD = 10         # fixed value: a dependency farther than this counts as critical
STRIDE_MIN_SAMPLES = 16     # fixed value: loads an ip needs before its stride counts

# Names and order of the 30 program features.
PROGRAM_FEATURES = [
    "frac_int_alu", "frac_int_mult_div", "frac_fp_alu", "frac_fp_mult_div", "frac_simd",
    "frac_load", "frac_store", "frac_branch", "frac_other",
    "branch_rate", "mean_basic_block_size", "p50_basic_block_size", "p95_basic_block_size",
    "frac_sync_instructions", "frac_indirect_branches", "frac_direct_cond_branches",
    "frac_direct_uncond_branches",
    "mean_reg_dep_distance", "p50_reg_dep_distance", "p95_reg_dep_distance",
    "frac_independent_last_16", "crit_path_density_10", "mean_reg_fan_out",
    "memory_instruction_fraction", "store_to_load_ratio", "unique_load_pages",
    "unique_store_pages", "frac_mem_dependent", "frac_memory_ordering_hazards",
    "load_stride_regularity",
]

# Feature name of each functional-unit group.
GROUP_FEATURES = {
    "int_alu": "frac_int_alu", "int_mult_div": "frac_int_mult_div", "fp_alu": "frac_fp_alu",
    "fp_mult_div": "frac_fp_mult_div", "simd_unit": "frac_simd", "read_port": "frac_load",
    "rdwr_port": "frac_store", "other": "frac_other",
}


def with_fu_group(trace: DataFrame) -> DataFrame:
    return trace if "fu_group" in trace.columns else trace.withColumn("fu_group", fu_group("op_class"))


def _share(condition: Column) -> Column:
    return F.count_if(condition) / F.count(F.lit(1))


def _known_group() -> Column:
    known = F.col("fu_group").isin(FU_GROUPS)
    return F.when(known, F.col("fu_group")).otherwise(
        F.raise_error(F.concat(F.lit("unknown functional-unit group: "), F.col("fu_group")))
    )


def _mix_columns() -> list[Column]:
    cols = [_share(F.col("fu_group") == g).alias(name) for g, name in GROUP_FEATURES.items()]
    return [*cols, _share(F.col("branch_type").isNotNull()).alias("frac_branch")]


def _branch_columns() -> list[Column]:
    n = F.count("branch_type")

    def among(kind: str) -> Column:
        return safe_div(F.count_if(F.col("branch_type") == kind), n)

    return [
        _share(F.col("branch_type").isNotNull()).alias("branch_rate"),
        among("indirect").alias("frac_indirect_branches"),
        among("direct_conditional").alias("frac_direct_cond_branches"),
        among("direct_unconditional").alias("frac_direct_uncond_branches"),
    ]


def _sync_columns() -> list[Column]:
    return [_share(F.col("inst_sync")).alias("frac_sync_instructions")]


def _memory_columns() -> list[Column]:
    load, store = F.col("fu_group") == "read_port", F.col("fu_group") == "rdwr_port"
    return [
        _share(load | store).alias("memory_instruction_fraction"),
        safe_div(F.count_if(store), F.count_if(load)).alias("store_to_load_ratio"),
    ]


def _hazard_columns() -> list[Column]:
    memory = (F.size("read_addrs") > 0) | (F.size("write_addrs") > 0)
    deps = F.size("mem_deps")
    return [
        safe_div(F.count_if(memory & (deps > 0)), F.count_if(memory)).alias("frac_mem_dependent"),
        safe_div(F.count_if(memory & (deps > 1)), F.count_if(memory)).alias("frac_memory_ordering_hazards"),
    ]


def instruction_mix(trace: DataFrame) -> DataFrame:
    checked = with_fu_group(trace).withColumn("fu_group", _known_group())
    return checked.groupBy("trace_id").agg(*_mix_columns())


def branch_mix(trace: DataFrame) -> DataFrame:
    return trace.groupBy("trace_id").agg(*_branch_columns())


def sync_fraction(trace: DataFrame) -> DataFrame:
    return trace.groupBy("trace_id").agg(*_sync_columns())


def memory_mix(trace: DataFrame) -> DataFrame:
    return with_fu_group(trace).groupBy("trace_id").agg(*_memory_columns())


def memory_hazards(trace: DataFrame) -> DataFrame:
    return trace.groupBy("trace_id").agg(*_hazard_columns())


def unique_pages(trace: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct pages of the first load and first store address of each row."""
    def pages(addrs: str) -> Column:
        return F.shiftrightunsigned(F.get(addrs, F.lit(0)), PAGE_BITS)

    if approximate:
        return trace.groupBy("trace_id").agg(
            F.approx_count_distinct(pages("read_addrs")).cast("double").alias("unique_load_pages"),
            F.approx_count_distinct(pages("write_addrs")).cast("double").alias("unique_store_pages"),
        )
    # Distinct (trace, kind, page) first, so a hot trace is counted by many tasks.
    touched = trace.select("trace_id", F.explode(F.array(
        F.struct(F.lit("load").alias("kind"), pages("read_addrs").alias("page")),
        F.struct(F.lit("store").alias("kind"), pages("write_addrs").alias("page")),
    )).alias("p")).select("trace_id", "p.kind", "p.page").distinct()
    return touched.groupBy("trace_id").agg(
        F.count_if((F.col("kind") == "load") & F.col("page").isNotNull()).cast("double").alias("unique_load_pages"),
        F.count_if((F.col("kind") == "store") & F.col("page").isNotNull()).cast("double").alias("unique_store_pages"),
    )


def fan_out(trace: DataFrame) -> DataFrame:
    """Dependency uses per distinct producer ip."""
    uses = trace.select("trace_id", F.explode("reg_deps").alias("dep")).groupBy("trace_id", "dep").agg(F.count(F.lit(1)).alias("uses"))
    per = uses.groupBy("trace_id").agg(safe_div(F.sum("uses"), F.count(F.lit(1))).alias("mean_reg_fan_out"))
    return _every_trace(trace, per)


def _every_trace(trace: DataFrame, per: DataFrame) -> DataFrame:
    """Traces without any sample get 0.0, not a missing row."""
    traces = trace.select("trace_id").distinct()
    values = [c for c in per.columns if c != "trace_id"]
    return traces.join(per, "trace_id", "left").select(
        "trace_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in values]
    )


def basic_block_sizes(trace: DataFrame, segment_rows: int | None = None) -> DataFrame:
    return block_id(trace.select("trace_id", "idx", "branch_type", "taken"), segment_rows).groupBy("trace_id", "block_id").agg(
        F.count(F.lit(1)).alias("block_size")
    )


def basic_blocks(trace: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Mean and percentiles of block sizes; the rows after the last taken branch form a block too.

    Sizes add up to the trace length, so a trace has at most sqrt(2 * rows) distinct sizes.
    """
    sizes = basic_block_sizes(trace, segment_rows)
    stats = small_domain_percentiles(sizes, ["trace_id"], {"block_size": [50, 95]})
    return _every_trace(trace, stats.select(
        "trace_id", F.col("block_size_mean").alias("mean_basic_block_size"),
        F.get("block_size_pct", F.lit(0)).alias("p50_basic_block_size"),
        F.get("block_size_pct", F.lit(1)).alias("p95_basic_block_size"),
    ))


def last_seen_distance(trace: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """As-of join: rows between each register dependency and its latest strictly earlier producer.

    Producers (one per row) and consumers (one per dependency) are stacked; at equal
    position consumers sort first, so a row never depends on itself. The distance is
    NULL where the ip has not been seen yet.
    """
    producers = trace.select("trace_id", "ip", "idx", F.lit(1).alias("kind"), F.lit(0).alias("pos"))
    consumers = trace.select("trace_id", "idx", F.posexplode("reg_deps").alias("pos", "ip")).select(
        "trace_id", "ip", "idx", F.lit(0).alias("kind"), "pos"
    )
    produced = F.when(F.col("kind") == 1, F.col("idx"))
    seen = last_before(producers.unionByName(consumers), ["trace_id", "ip"], ["idx", "kind", "pos"], produced, "seen", segment_rows)
    return seen.filter(F.col("kind") == 0).select(
        "trace_id", "idx", "pos", F.col("ip").alias("dep_ip"), (F.col("idx") - F.col("seen")).alias("distance")
    )


def dependency_stats(
    trace: DataFrame, dep_window: int = DEP_WINDOW, crit_threshold: int = CRIT_THRESHOLD,
    segment_rows: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Distance statistics over all dependencies and the shares of independent and critical rows."""
    dist = last_seen_distance(trace, segment_rows)
    known = dist.filter(F.col("distance").isNotNull())
    d = distribution(known, ["trace_id"], "distance", points=[50, 95], weighted=False, limit=limit)
    farthest = known.groupBy("trace_id", "idx").agg(F.max("distance").alias("far"))
    far = farthest.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("_known"),
        F.count_if(F.col("far") > dep_window).alias("_far"),
        F.count_if(F.col("far") > crit_threshold).alias("_crit"),
    )
    total = trace.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_rows"))
    zero = F.lit(0)
    independent = F.col("_rows") - F.coalesce("_known", zero) + F.coalesce("_far", zero)
    return total.join(far, "trace_id", "left").join(d, "trace_id", "left").select(
        "trace_id",
        F.coalesce("mean", F.lit(0.0)).alias("mean_reg_dep_distance"),
        F.coalesce(F.get("raw", F.lit(0)), F.lit(0.0)).alias("p50_reg_dep_distance"),
        F.coalesce(F.get("raw", F.lit(1)), F.lit(0.0)).alias("p95_reg_dep_distance"),
        safe_div(independent, "_rows").alias("frac_independent_last_16"),
        safe_div(F.coalesce("_crit", zero), "_rows").alias("crit_path_density_10"),
    )


def stride_regularity(trace: DataFrame, min_samples: int = STRIDE_MIN_SAMPLES, segment_rows: int | None = None) -> DataFrame:
    """Share of the most frequent address step per load ip, averaged over ips with enough loads."""
    steps = lag_delta(trace, segment_rows).groupBy("trace_id", "ip", "delta").agg(F.count(F.lit(1)).alias("n"))
    step = F.col("delta").isNotNull()
    per_ip = steps.groupBy("trace_id", "ip").agg(
        F.sum("n").alias("loads"), F.sum(F.when(step, F.col("n"))).alias("steps"), F.max(F.when(step, F.col("n"))).alias("best")
    ).filter((F.col("loads") >= min_samples) & (F.col("steps") > 0))
    return _every_trace(trace, per_ip.groupBy("trace_id").agg(F.avg(F.col("best") / F.col("steps")).alias("load_stride_regularity")))


def program_features(
    trace: DataFrame, dep_window: int = DEP_WINDOW, crit_threshold: int = CRIT_THRESHOLD,
    stride_min_samples: int = STRIDE_MIN_SAMPLES, segment_rows: int | None = None, kept: bool = False,
) -> DataFrame:
    """One row of 30 features per trace; all plain counts come from one scan.

    The trace is read and placed once: its rows are kept in the checkpoint folder for the parts, unless the caller has `kept` them.
    """
    trace = trace if kept else cut_lineage(trace)
    checked = with_fu_group(trace).withColumn("fu_group", _known_group())
    counts = checked.groupBy("trace_id").agg(
        *_mix_columns(), *_branch_columns(), *_sync_columns(), *_memory_columns(), *_hazard_columns()
    )
    parts = [
        unique_pages(trace), fan_out(trace), basic_blocks(trace, segment_rows),
        dependency_stats(trace, dep_window, crit_threshold, segment_rows),
        stride_regularity(trace, stride_min_samples, segment_rows),
    ]
    for part in parts:
        counts = counts.join(part, "trace_id")
    return counts.select("trace_id", *[F.col(c).cast("double").alias(c) for c in PROGRAM_FEATURES])


def resolve_dependencies(trace: DataFrame) -> DataFrame:
    """Producer positions of each row: the last occurrence of the ip in the whole trace, if earlier.

    Register and memory dependencies together, sorted and distinct. This differs from
    `last_seen_distance`, which looks at the latest earlier occurrence.
    """
    last_row = trace.groupBy("trace_id", "ip").agg(F.max("idx").alias("dep_idx")).withColumnRenamed("ip", "dep")
    wanted = trace.select("trace_id", "idx", F.explode_outer(F.array_distinct(F.concat("reg_deps", "mem_deps"))).alias("dep"))
    found = dim_join(wanted, last_row, ["trace_id", "dep"], "left")
    return found.groupBy("trace_id", "idx").agg(
        F.array_sort(F.collect_set(F.when(F.col("dep_idx") < F.col("idx"), F.col("dep_idx")))).alias("deps")
    )


def attach_latency(trace: DataFrame, latency: DataFrame) -> DataFrame:
    """Fetch and execution latency of each row for every cache configuration.

    Fails when a (trace, configuration) has another number of rows than the trace.
    """
    config = ["l1i_kb", "l1d_kb", "l2_kb"]
    n_trace = trace.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_rows"))
    n_lat = latency.groupBy("trace_id", *config).agg(F.count(F.lit(1)).alias("_lat"))
    text = F.concat(F.lit("latency length differs from the trace: "), F.col("trace_id").cast("string"))
    wrong = n_lat.join(n_trace, "trace_id", "left").filter(must(F.col("_rows") == F.col("_lat"), text, F.lit(False)))
    # The check is one aggregate per (trace, configuration); the rows themselves are joined once.
    checked = latency.withColumn("_wrong", wrong.select(F.count(F.lit(1)).alias("n")).scalar()).filter("_wrong = 0").drop("_wrong")
    return trace.join(checked, ["trace_id", "idx"])


LATENCY_POINTS = [50, 75, 95]  # fixed values
CACHE_SUMMARY = [
    "fetch_mean", "exec_mean", "fetch_p50", "fetch_p75", "fetch_p95", "exec_p50", "exec_p75", "exec_p95",
]


def latency_summary(latency: DataFrame) -> DataFrame:
    """Mean and percentiles of both latencies per trace and cache configuration (16-bit values)."""
    keys = ["trace_id", "l1i_kb", "l1d_kb", "l2_kb"]
    s = small_domain_percentiles(latency, keys, {"fetch_lat": LATENCY_POINTS, "exec_lat": LATENCY_POINTS})
    cols = [F.col("fetch_lat_mean").alias("fetch_mean"), F.col("exec_lat_mean").alias("exec_mean")]
    for kind in ("fetch", "exec"):
        cols += [F.get(f"{kind}_lat_pct", F.lit(i)).alias(f"{kind}_p{p}") for i, p in enumerate(LATENCY_POINTS)]
    return s.select(*keys, *cols)


def rate_summary(rates: DataFrame) -> DataFrame:
    """One misprediction rate per (key, predictor)."""
    return rates.groupBy("benchmark", "bp_type").agg(F.min("misprediction_rate").alias("misprediction_rate"))
