"""Wide training matrix: lookup vectors, stall and queue blocks, configuration scalars.

Everything stays an ARRAY<DOUBLE> until the sink: thousands of columns would be slow
to plan and too wide for generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.registry import REGISTRY, Registry
from tracemill.functions.scalars import must
from tracemill.operators.encode import VECTOR_LENGTH, cdf_encode, vector_names
from tracemill.operators.ordered import dim_join
from tracemill.operators.sweeps import config_feature_columns
from tracemill.operators.windows import WINDOW_ROWS, window_counts

# Stall kinds in column order, and the window count each one reads.
STALL_KINDS = {"ISB": "n_sync", "DIRECT_COND": "n_direct_cond", "DIRECT_UNCOND": "n_direct_uncond", "INDIRECT": "n_indirect"}


def zeros(n: int = VECTOR_LENGTH) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def _in_order(position: str, vec: str) -> Column:
    """Vectors of a group, concatenated by position (a fixed small number per group)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(vec).alias("v"))))
    return F.flatten(F.transform(ordered, lambda s: s["v"]))


def lookup_features(
    configs: DataFrame, lookup: DataFrame, id_cols: list[str], registry: Registry = REGISTRY,
    resources: list[str] | None = None, on_missing: str = "error",
) -> DataFrame:
    """id columns -> `vec`: the encoded vectors of every resource in registry order.

    Each configuration becomes one narrow row per resource, is joined on the lookup
    key, and the vectors are put back together per configuration.
    """
    names = resources or [r.name for r in registry.enabled_resources()]
    by_name = {r.name: r for r in registry.resources}
    cfg = F.col("cfg_idx") if "cfg_idx" in configs.columns else F.lit(0)
    rows = []
    for pos, name in enumerate(names):
        r = by_name[name]
        p = [F.col(x).cast("int") for x in r.params]
        rows.append(F.struct(
            F.lit(pos).alias("pos"), F.lit(name).alias("resource"),
            (cfg if r.depends else F.lit(0)).cast("int").alias("cfg_idx"),
            p[0].alias("p0"), (p[1] if len(p) > 1 else F.lit(0)).alias("p1"),
        ))
    keyed = configs.select("trace_id", *[c for c in id_cols if c != "trace_id"], F.explode(F.array(*rows)).alias("_k")).select(
        "trace_id", *[c for c in id_cols if c != "trace_id"], "_k.*"
    )
    keys = ["trace_id", "resource", "cfg_idx", "p0", "p1"]
    joined = dim_join(keyed, lookup.select(*keys, "vec"), keys, "left")
    if on_missing == "error":
        text = F.concat(F.lit("lookup key not found: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
        joined = joined.withColumn("vec", must(F.col("vec").isNotNull(), text, F.col("vec")))
    elif on_missing == "zero":
        joined = joined.withColumn("vec", F.coalesce("vec", zeros()))
    elif on_missing != "drop":
        raise ValueError(f"unknown on_missing {on_missing!r}")
    out = joined.groupBy(*id_cols).agg(_in_order("pos", "vec").alias("vec"), F.count("vec").alias("_n"))
    return out.filter(F.col("_n") == len(names)).drop("_n")


def stall_features(trace: DataFrame, k: int = WINDOW_ROWS) -> DataFrame:
    """trace_id -> 404 doubles: distribution of each stall kind's count per window."""
    counts = window_counts(trace, k)
    kinds = F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.col(c).cast("double").alias("n")) for i, c in enumerate(STALL_KINDS.values())
    ]))
    long = counts.select("trace_id", kinds.alias("s")).select("trace_id", "s.pos", "s.n")
    vec = cdf_encode(long, ["trace_id", "pos"], "n")
    return vec.groupBy("trace_id").agg(_in_order("pos", "vec").alias("vec"))


def stall_names() -> list[str]:
    return [n for kind in STALL_KINDS for n in vector_names(kind)]


def queue_latency_features(queue: DataFrame, overall: DataFrame) -> DataFrame:
    """(trace, cache config) -> throughput per size, issue and commit vectors per size, execution vector.

    `queue` has one row per (size, instruction) with issue, commit and exec latency;
    execution latency is averaged over the sizes of each instruction first.
    """
    keys = ["trace_id", "cfg_idx"]
    sized = queue.select(*keys, "size", F.explode(F.array(
        F.struct(F.lit(1).alias("part"), F.col("issue").cast("double").alias("x")),
        F.struct(F.lit(2).alias("part"), F.col("commit").cast("double").alias("x")),
    )).alias("s")).select(*keys, "s.part", "size", "s.x")
    execution = queue.groupBy(*keys, "idx").agg(F.avg(F.col("exec").cast("double")).alias("x")).select(
        *keys, F.lit(3).alias("part"), F.lit(0).cast(queue.schema["size"].dataType).alias("size"), "x"
    )
    vec = cdf_encode(sized.unionByName(execution), [*keys, "part", "size"], "x")
    thr = overall.select(*keys, F.lit(0).alias("part"), F.col("size").cast(queue.schema["size"].dataType).alias("size"), F.array(F.col("thr").cast("double")).alias("vec"))
    return vec.unionByName(thr).withColumn("_p", F.struct("part", "size")).groupBy(*keys).agg(_in_order("_p", "vec").alias("vec"))


def queue_names(sizes: list[int], prefix: str = "rob") -> list[str]:
    names = [f"{prefix}{s}_overall_thr" for s in sizes]
    for part in ("issue", "commit"):
        for s in sizes:
            names += vector_names(f"{prefix}{s}_{part}")
    return names + vector_names("exec")


def training_matrix(
    configs: DataFrame, lookup: DataFrame, stalls: DataFrame, queue: DataFrame | None = None,
    registry: Registry = REGISTRY, id_cols: list[str] = ("trace_id", "cid"), resources: list[str] | None = None,
    on_missing: str = "error", label: str | None = None, queue_len: int = 0,
) -> DataFrame:
    """id columns -> `features`: lookup ++ stalls ++ queue ++ configuration scalars, and the label.

    Per-trace blocks are computed once and joined; a block that is absent is
    zero-filled when `on_missing` is zero, else its rows are dropped or fail.
    """
    ids = list(id_cols)
    scalars = F.array(*[c.cast("double") for c in config_feature_columns(registry)])
    base = configs.select(*ids, *(["cfg_idx"] if queue is not None else []), scalars.alias("_s"), *([label] if label else []))
    out = base.join(lookup_features(configs, lookup, ids, registry, resources, on_missing), ids)
    out = dim_join(out, stalls.select("trace_id", F.col("vec").alias("_stall")), ["trace_id"], "left")
    blocks = [("_stall", VECTOR_LENGTH * len(STALL_KINDS))]
    if queue is not None:
        out = dim_join(out, queue.select("trace_id", "cfg_idx", F.col("vec").alias("_queue")), ["trace_id", "cfg_idx"], "left")
        blocks.append(("_queue", queue_len))
    for name, length in blocks:
        if on_missing == "zero":
            out = out.withColumn(name, F.coalesce(name, zeros(length)))
        elif on_missing == "drop":
            out = out.filter(F.col(name).isNotNull())
        else:
            out = out.withColumn(name, must(F.col(name).isNotNull(), f"missing block {name[1:]}", F.col(name)))
    features = F.concat("vec", *[n for n, _ in blocks], "_s").alias("features")
    return out.select(*ids, features, *([label] if label else []))


def matrix_names(registry: Registry = REGISTRY, sizes: list[int] = (), resources: list[str] | None = None) -> list[str]:
    names = resources or [r.name for r in registry.enabled_resources()]
    cols = [n for r in names for n in vector_names(r)] + stall_names()
    if sizes:
        cols += queue_names(list(sizes))
    scalars = [p.name for p in registry.enabled_params()]
    return [*cols, *scalars, "bp_is_simple", "bp_is_tage", "prefetcher_off", "prefetcher_on"]


def widen_matrix(matrix: DataFrame, names: list[str], id_cols: list[str], label: str | None = None) -> DataFrame:
    """Named columns for a sink that needs them."""
    cols = [F.element_at("features", i + 1).alias(n) for i, n in enumerate(names)]
    return matrix.select(*id_cols, *cols, *([label] if label else []))
