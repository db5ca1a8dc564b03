"""Design-space study: sweeps, sampling, feasibility, repair, cost, inference input, sensitivity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.registry import FIXED_PARAMS, REGISTRY, SEARCH_GRID, Registry
from tracemill.functions.scalars import all_of, hash_long, hash_uniform, must, parse_size
from tracemill.operators.ordered import SEGMENT_ROWS, block_product, bucketed_rank, dim_join, small_broadcast

DEALT_ROWS = 1 << 19        # rows (dimension, id) that a task makes
HASH_ROWS = 1 << 17         # rows of a dimension in one hash range

# Feasibility constants.
ROB_HEADROOM = 8
ISSUE_WIDTH_RENAME_RATIO = 2

ISSUE_WIDTHS = [
    "int_reg_issue_width", "int_mult_div_issue_width", "fp_reg_issue_width",
    "fp_mult_div_issue_width", "read_port_issue_width", "rdwr_port_issue_width",
]

# Cost weights per unit of each parameter.
COST_WEIGHTS = {
    "int_reg_issue_width": 1.0, "int_mult_div_issue_width": 5.0, "fp_reg_issue_width": 3.0,
    "fp_mult_div_issue_width": 8.0, "read_port_issue_width": 3.0, "rdwr_port_issue_width": 4.0,
    "fetch_width": 2.0, "decode_width": 3.0, "rename_width": 4.0, "commit_width": 2.0,
    "rob_size": 0.8, "lq_entries": 2.5, "sq_entries": 2.5, "max_icache_fills": 3.0,
}
ISSUE_NETWORK_WEIGHT = 0.4
PREDICTOR_COST = {"local": 10.0, "tage": 100.0}
PREDICTOR_SHARED_COST = 30.0
PREFETCHER_COST = 15.0
L1_COST_PER_KB, L2_COST_PER_KB, MEMORY_WEIGHT = 5.0, 1.0, 0.1


def total(cols: list[str]) -> Column:
    return reduce(lambda a, c: a + c, [F.col(c) for c in cols])


# ---------------------------------------------------------------- sweeps and samples

def param_sweep(registry: Registry, params: list[str]) -> Column:
    """Array of {param: value} over the cartesian product of the ranges, last parameter fastest."""
    def nest(i: int, chosen: list[Column]) -> Column:
        values = registry.by_name[params[i]].values()
        if i == len(params) - 1:
            return F.transform(values, lambda v: F.struct(*[c.alias(n) for c, n in zip([*chosen, v], params)]))
        return F.flatten(F.transform(values, lambda v: nest(i + 1, [*chosen, v])))

    return nest(0, [])


def sweep_table(spark: SparkSession, registry: Registry, params: list[str]) -> DataFrame:
    return spark.range(1).select(F.inline(param_sweep(registry, params)))


def _pick(values: list, digit: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (digit + 1).cast("int"))


PERMUTE_ROUNDS = 6


def _contiguous(values: list) -> bool:
    return all(isinstance(v, int) for v in values) and values == list(range(values[0], values[0] + len(values)))


def grid_value(values: list, digit: Column) -> Column:
    """Grid value at a 0-based digit; ranges are arithmetic, not array lookups."""
    if _contiguous(values):
        return (digit + values[0]).cast("int")
    return _pick(values, digit)


def draw_grid(ids: DataFrame, id_col: str, seed: int | str, grid: dict[str, list] = SEARCH_GRID) -> DataFrame:
    """One uniform configuration per id: an independent hashed digit per parameter, so the grid is never enumerated."""
    cols = [
        grid_value(v, F.pmod(hash_long([id_col], f"{seed}|{p}"), F.lit(len(v)))).alias(p) for p, v in grid.items()
    ]
    return ids.select(id_col, *cols, *[F.lit(v).alias(p) for p, v in FIXED_PARAMS.items() if p not in grid])


def distinct_draws(ids: DataFrame, id_col: str, n: int, seed: int | str, grid: dict[str, list] = SEARCH_GRID) -> DataFrame:
    """The first n distinct configurations drawn over the ids, in id order."""
    drawn = draw_grid(ids, id_col, seed, grid)
    params = [c for c in drawn.columns if c != id_col]
    unique = drawn.groupBy(*params).agg(F.min(id_col).alias(id_col))
    ranked = bucketed_rank(unique, [], F.floor(F.col(id_col) / SEGMENT_ROWS), [id_col], "_rank")
    return ranked.filter(F.col("_rank") < n).drop("_rank")


def permute_grid(ids: DataFrame, id_col: str, seed: int | str, grid: dict[str, list] = SEARCH_GRID) -> DataFrame:
    """A different grid point for every id from 0 up to the grid's size, in an order that looks random.

    The grid is cut into two halves below 2^63 points. The id's place in them is shuffled by
    rounds that add a hash of one half to the other, modulo its size; every round can be
    undone, so no two ids meet. Only expressions over each row: nothing is drawn twice,
    ranked or shuffled, however large the share of the grid that is asked for.
    """
    names = list(grid)
    halves = [{p: grid[p] for p in names[:len(names) // 2]}, {p: grid[p] for p in names[len(names) // 2:]}]
    sizes = [reduce(lambda a, v: a * len(v), half.values(), 1) for half in halves]
    if max(sizes) >= 2**62:
        raise ValueError("half of the grid has 2^62 points or more")
    out = ids.select(id_col, F.pmod(F.col(id_col), F.lit(sizes[1])).alias("_1"), F.expr(f"`{id_col}` DIV {sizes[1]}L").alias("_0"))
    text = f"the grid has only {sizes[0] * sizes[1]} points"
    out = out.filter(must((F.col(id_col) >= 0) & (F.col("_0") < sizes[0]), text, F.lit(True)))
    for r in range(PERMUTE_ROUNDS):
        to, by = r % 2, (r + 1) % 2
        mixed = F.pmod(F.col(f"_{to}") + F.pmod(hash_long([f"_{by}"], f"{seed}|{r}"), F.lit(sizes[to])), F.lit(sizes[to]))
        out = settle(out, {f"_{to}": mixed})
    return decode_index(decode_index(out, "_0", halves[0]), "_1", halves[1]).select(
        id_col, *names, *[F.lit(v).alias(p) for p, v in FIXED_PARAMS.items() if p not in grid])


def sample_grid(spark: SparkSession, n: int, seed: int | str, grid: dict[str, list] = SEARCH_GRID) -> DataFrame:
    """n distinct configurations (column draw and the parameters); one rule for any n up to the grid's size."""
    size = reduce(lambda a, v: a * len(v), grid.values(), 1)
    if n > min(size, 2**63 - 1):
        raise ValueError(f"n is too large for a grid of {size} points")
    return permute_grid(spark.range(n).withColumnRenamed("id", "draw"), "draw", seed, grid)


def decode_index(df: DataFrame, index: str, grid: dict[str, list] = SEARCH_GRID) -> DataFrame:
    """Mixed-radix index -> configuration, last parameter fastest; for grids below 2^63 points."""
    sizes = {p: len(v) for p, v in grid.items()}
    if reduce(lambda a, v: a * v, sizes.values(), 1) >= 2**63:
        raise ValueError("the grid has 2^63 points or more; draw digits instead")
    cols, stride = {}, 1
    for p in reversed(list(grid)):
        digit = F.pmod(F.floor(F.expr(f"`{index}` DIV {stride}L")), F.lit(sizes[p]))
        cols[p] = grid_value(grid[p], digit)
        stride *= sizes[p]
    return df.select("*", *[cols[p].alias(p) for p in grid])


def sample_configs(ids: DataFrame, id_col: str, seed: int | str, registry: Registry = REGISTRY) -> DataFrame:
    """Independent draws of every enabled parameter: float ranges, value lists, inclusive integer ranges."""
    cols = []
    for p in registry.enabled_params():
        if p.kind == "float":
            value = F.lit(float(p.low)) + hash_uniform([id_col], f"{seed}|{p.name}") * F.lit(float(p.high - p.low))
        elif isinstance(p.step, tuple):
            value = _pick(list(p.step), F.pmod(hash_long([id_col], f"{seed}|{p.name}"), F.lit(len(p.step))))
        else:
            span = int(p.high) - int(p.low) + 1
            value = (F.pmod(hash_long([id_col], f"{seed}|{p.name}"), F.lit(span)) + int(p.low)).cast("int")
        cols.append(value.alias(p.name))
    return ids.select(id_col, *cols)


def _hash_places(keys: list[bytes], name: str, dim: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Range number of each key's hash in a dimension, and the hash as two longs that sort like its digits."""
    tail = f"|{name}".encode()
    halves = np.frombuffer(b"".join([md5(k + tail).digest() for k in keys]), ">u8").reshape(-1, 2).astype(np.uint64)
    places = dim * ranges + np.floor((halves[:, 0] >> np.uint64(32)).astype(np.float64) * ranges / 2.0**32).astype(np.int64)
    return places, (halves ^ np.uint64(1 << 63)).view(np.int64)


def latin_hypercube(ids: DataFrame, id_col: str, seed: int | str, grid: dict[str, list] = SEARCH_GRID, bucket_rows: int | None = None) -> DataFrame:
    """One draw per stratum in every dimension, snapped to the grid.

    The stratum of a draw is its rank under a hash that differs per dimension. All
    dimensions are ranked together, as rows (dimension, id), and folded back once. Every
    dimension has as many rows as there are ids, so no row is dealt by its dimension. The
    ids are dealt first, as a scan of a few files would make all rows in a few tasks; the
    rows move to their hash range, where NumPy sorts the hashes, and back to their id.
    """
    n = ids.count()
    ranges = max(1, -(-n // (bucket_rows or HASH_ROWS)))
    key = F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary").alias("_key")
    dealt = ids.select(id_col, key).repartition(max(1, -(-n * len(grid) // DEALT_ROWS)))
    id_type = ids.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_pylist()
            for dim, name in enumerate(grid):
                sizes = np.bincount(_hash_places(keys, name, dim, ranges)[0] - dim * ranges)
                found = np.flatnonzero(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(dim * ranges + found), pa.array(sizes[found])], names=["_place", "_n"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_pylist()
            for dim, name in enumerate(grid):
                places, halves = _hash_places(keys, name, dim, ranges)
                yield pa.RecordBatch.from_arrays([batch.column(id_col), *map(pa.array, (places, halves[:, 0].copy(), halves[:, 1].copy()))], names=[id_col, "_place", "_hi", "_lo"])

    def rank(rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows["_lo"].to_numpy(), rows["_hi"].to_numpy()))
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        return rows.select([id_col, "_place"]).append_column("_in", pa.array(at))

    dim = F.call_function("div", F.col("_place"), F.lit(ranges)).cast("int")
    counts = dealt.select("_key").mapInArrow(count, "_place long, _n long").groupBy("_place").agg(F.sum("_n").alias("_n")).withColumn("_dim", dim)
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy("_dim").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = small_broadcast(counts.select("_place", "_dim", earlier.alias("_off")))
    placed = dealt.mapInArrow(hashes, f"`{id_col}` {id_type}, _place long, _hi long, _lo long")
    ranked = placed.groupBy("_place").applyInArrow(rank, f"`{id_col}` {id_type}, _place long, _in long").join(offsets, "_place")
    rows = ranked.select(id_col, "_dim", (F.col("_in") + F.col("_off")).alias("_rank")).repartition(id_col)
    out = rows.groupBy(id_col).agg(*[F.max(F.when(F.col("_dim") == i, F.col("_rank"))).alias(f"_r_{p}") for i, p in enumerate(grid)])
    values = {}
    for p, choices in grid.items():
        u = (F.col(f"_r_{p}") + hash_uniform([id_col], f"{seed}|{p}|u")) / F.lit(n)
        values[p] = grid_value(choices, F.least(F.floor(u * len(choices)), F.lit(len(choices) - 1)))
    return out.select(id_col, *[v.alias(p) for p, v in values.items()])


# ---------------------------------------------------------------- feasibility, repair, cost

def is_valid() -> Column:
    """Width ordering, queue floors and the issue budget as one predicate."""
    ports = F.col("read_port_issue_width") + F.col("rdwr_port_issue_width")
    return all_of([
        F.col("decode_width") <= F.col("fetch_width"),
        F.col("rename_width") <= F.col("decode_width"),
        F.col("commit_width") <= F.col("rename_width"),
        F.col("rob_size") >= F.col("commit_width") * ROB_HEADROOM,
        F.col("lq_entries") >= ports,
        F.col("sq_entries") >= ports,
        total(ISSUE_WIDTHS) <= F.col("rename_width") * ISSUE_WIDTH_RENAME_RATIO,
    ])


def _bounded(p: str, grid: dict[str, list]) -> Column:
    return F.greatest(F.least(F.col(p), F.lit(grid[p][-1])), F.lit(grid[p][0]))


def _clipped(level: Column | int) -> Column:
    """Sum of the issue widths, each counted from 0 and cut to a level."""
    cut = F.lit(level) if isinstance(level, int) else level
    return reduce(lambda a, c: a + c, [F.least(F.col(w) - 1, cut) for w in ISSUE_WIDTHS])


def settle(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Replaces columns through a one-row generator.

    Later steps then refer to finished values: filters and projections are not pushed
    through a generator, which would copy the chained expressions into one another.
    """
    kept = [c for c in df.columns if c not in values]
    order = [*df.columns, *[n for n in values if n not in df.columns]]
    out = df.select(*kept, F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))
    return out.select(*order)


def _trim_widths(df: DataFrame, widest: int) -> DataFrame:
    """Issue widths lowered from the largest down until their sum fits twice the rename width.

    With x = width - 1, every x is cut to the highest level whose clipped sum fits the room;
    what is left is given back one by one to the last positions above that level.
    """
    room = F.col("rename_width") * ISSUE_WIDTH_RENAME_RATIO - len(ISSUE_WIDTHS)
    level = F.greatest(*[F.when(_clipped(lv) <= room, F.lit(lv)) for lv in range(widest)])
    out = settle(df, {"_room": room, "_level": level})
    out = settle(out, {"_left": F.col("_room") - _clipped(F.col("_level"))})
    above = [((F.col(w) - 1) > F.col("_level")) for w in ISSUE_WIDTHS]
    trimmed = {}
    for i, w in enumerate(ISSUE_WIDTHS):
        later = reduce(lambda a, c: a + c, [c.cast("int") for c in above[i + 1:]], F.lit(0))
        back = F.when(above[i] & (later < F.col("_left")), F.lit(1)).otherwise(F.lit(0))
        trimmed[w] = (F.least(F.col(w) - 1, F.col("_level")) + back + 1).cast("int")
    return settle(out, trimmed).drop("_room", "_level", "_left")


def repair(df: DataFrame, predictor: str | None = None, grid: dict[str, list] = SEARCH_GRID) -> DataFrame:
    """Nearest feasible configuration by closed-form clamps; leaves feasible rows unchanged.

    A list of expressions over each row only: no shuffle, no Python.
    """
    numeric = [p for p in grid if isinstance(grid[p][0], int) and len(grid[p]) > 2]
    bounded = {p: _bounded(p, grid).cast("int") for p in numeric}
    floor = F.lit(-(-len(ISSUE_WIDTHS) // ISSUE_WIDTH_RENAME_RATIO))
    fetch = F.greatest(bounded["fetch_width"], floor)
    decode = F.least(F.greatest(bounded["decode_width"], floor), fetch)
    rename = F.least(F.greatest(bounded["rename_width"], floor), decode)
    commit = F.least(bounded["commit_width"], rename)
    values = {**bounded, "fetch_width": fetch, "decode_width": decode, "rename_width": rename, "commit_width": commit}
    if predictor is not None:
        values["branch_predictor"] = F.lit(predictor)
    out = settle(df, values)
    out = _trim_widths(out, max(len(grid[w]) for w in ISSUE_WIDTHS))

    rob_floor = F.least(F.col("commit_width") * ROB_HEADROOM, F.lit(grid["rob_size"][-1]))
    ports = F.col("read_port_issue_width") + F.col("rdwr_port_issue_width")
    queues = {p: F.greatest(F.col(p), F.least(ports, F.lit(grid[p][-1]))) for p in ("lq_entries", "sq_entries")}
    return out.withColumns({"rob_size": F.greatest(F.col("rob_size"), rob_floor), **queues})


def hardware_cost() -> Column:
    """Relative area estimate as one arithmetic expression; an unknown predictor fails the job."""
    linear = reduce(lambda a, b: a + b, [F.col(p) * F.lit(w) for p, w in COST_WEIGHTS.items()])
    width = total(ISSUE_WIDTHS)
    bp = F.lower(F.col("branch_predictor").cast("string"))
    core = F.raise_error(F.concat(F.lit("unknown branch predictor: "), F.coalesce(bp, F.lit("NULL")))).cast("double")
    for name, cost in PREDICTOR_COST.items():
        core = F.when(bp == name, F.lit(cost)).otherwise(core)
    prefetch = F.when(F.col("stride_prefetcher_degree") > 0, F.lit(PREFETCHER_COST)).otherwise(F.lit(0.0))
    memory = (
        (parse_size("l1i_size") + parse_size("l1d_size")) * F.lit(L1_COST_PER_KB) + parse_size("l2_size") * F.lit(L2_COST_PER_KB)
    ) * F.lit(MEMORY_WEIGHT)
    return linear + width * width * F.lit(ISSUE_NETWORK_WEIGHT) + core + F.lit(PREDICTOR_SHARED_COST) + prefetch + memory


# ---------------------------------------------------------------- inference input and scoring

CACHE_COLUMNS = [
    "fetch_mean", "exec_mean", "fetch_p50", "fetch_p75", "fetch_p95", "exec_p50", "exec_p75", "exec_p95",
]  # fixed values


def cross_sweep(configs: DataFrame, workloads: DataFrame, workload_key: list[str]) -> DataFrame:
    """Every configuration with every workload; workload columns first.

    The result is the full product by definition. The workloads are dealt over blocks
    and the (few) configurations repeated per block, so it is an even equi-join.
    """
    out = block_product(configs, workloads, workload_key)
    return out.select(*workloads.columns, *configs.columns)


def assemble_inference(
    configs: DataFrame, program: DataFrame, cache: DataFrame, rates: DataFrame, config_id: str,
    features: list[str] | None = None, scaler: DataFrame | None = None,
) -> DataFrame:
    """(config, trace) rows with configuration, program, cache and predictor features, z-scored.

    The cache, program and predictor rows of a trace become one table with a row per memory configuration, predictor and
    trace, so one join pairs each config with every trace. It is kept once and broadcast if it is counted small: its few
    keys would otherwise gather the rows of all configs in as many tasks.
    """
    memory = ["l1i_kb", "l1d_kb", "l2_kb"]
    # Each config becomes one row per trace: deal the narrow configs evenly first. The mean
    # over traces later reuses this partitioning.
    sizes = {f"{level}_kb": parse_size(f"{level}_size") for level in ("l1i", "l1d", "l2")}
    keyed = configs.withColumns(sizes).withColumn("branch_predictor", F.lower("branch_predictor")).repartition(F.col(config_id))
    keyed = keyed.withColumns({f"{level}_size": (F.col(f"{level}_kb") * 1024).cast("double") for level in ("l1i", "l1d", "l2")})
    lat = cache.select("trace_id", *[F.col(m).cast("bigint").alias(m) for m in memory], *[F.col(c).alias(f"cache_{c}") for c in CACHE_COLUMNS])
    n_traces = program.select(F.count(F.lit(1)).alias("n")).scalar()
    per_memory = lat.groupBy(*memory).agg(F.count(F.lit(1)).alias("_n")).withColumn("_whole", F.col("_n") == n_traces).drop("_n")
    text = "cache latency rows are missing for a memory configuration"
    paired = dim_join(keyed, small_broadcast(per_memory), memory, "left")
    paired = paired.filter(must(F.col("_whole"), text, F.lit(True))).drop("_whole")
    prog = program.select("trace_id", *[F.col(c).alias(f"prog_{c}") for c in program.columns if c != "trace_id"])
    bp_name = "misprediction_rate" if features and "misprediction_rate" in features else "bp_misprediction_rate"
    rate = rates.select("trace_id", F.lower("bp_type").alias("branch_predictor"), F.col("misprediction_rate").alias(bp_name))
    traces = small_broadcast(lat.join(prog, "trace_id").join(rate, "trace_id"))
    wide = dim_join(paired, traces, [*memory, "branch_predictor"], "inner").drop(*memory)
    wide = wide.withColumns({
        **{f"stride_prefetcher_degree_{v}": (F.col("stride_prefetcher_degree") == v).cast("double") for v in SEARCH_GRID["stride_prefetcher_degree"]},
        **{f"reciprocal_{q}": F.lit(1.0) / F.col(q) for q in ("lq_entries", "sq_entries", "rob_size")},
    })
    if features is None:
        skip = {config_id, "trace_id", "branch_predictor", "stride_prefetcher_degree"}
        features = [f.name for f in wide.schema.fields if f.name not in skip and f.dataType.typeName() in ("double", "float", "integer", "long")]
    out = wide.select(config_id, "trace_id", *[F.col(c).cast("double").alias(c) for c in features])
    if scaler is None:
        return out
    # `scaler`: one row with struct columns mean and scale, fields named like the features.
    stats = scaler.select(F.struct("mean", "scale").alias("s")).scalar()
    scaled = {c: (F.col(c) - F.col(f"_s.mean.{c}")) / F.col(f"_s.scale.{c}") for c in features}
    return out.withColumn("_s", stats).withColumns(scaled).drop("_s")


def mean_cpi_over_traces(scored: DataFrame, config_id: str, cpi: str = "predicted_cpi") -> DataFrame:
    return scored.groupBy(config_id).agg(F.avg(cpi).alias("cpi"))


Scorer = Callable[[DataFrame], DataFrame]


def evaluate_configs(
    configs: DataFrame, program: DataFrame, cache: DataFrame, rates: DataFrame, config_id: str, score: Scorer,
    cost: Column | None = None, features: list[str] | None = None, scaler: DataFrame | None = None,
) -> DataFrame:
    """Configurations with mean predicted CPI over all traces and their cost.

    `score` adds `predicted_cpi` to the assembled rows; `cost` may be any column expression.
    """
    scored = score(assemble_inference(configs, program, cache, rates, config_id, features, scaler))
    cpi = mean_cpi_over_traces(scored, config_id)
    priced = configs.withColumn("cost", hardware_cost() if cost is None else cost)
    return priced.join(cpi, config_id)


def perturbations(front: DataFrame, point_id: str, grid: dict[str, list] = SEARCH_GRID) -> DataFrame:
    """Feasible neighbours of each point: one parameter moved one grid step up or down."""
    moves = F.explode(F.array(*[
        F.struct(F.lit(p).alias("param"), F.lit(step).alias("step")) for p in grid for step in (-1, 1)
    ]))
    moved = front.select(point_id, F.col("cpi").alias("_cpi"), F.col("cost").alias("_cost"), *grid, *FIXED_PARAMS, moves.alias("_m")).select("*", "_m.param", "_m.step").drop("_m")
    inside, cols = F.lit(True), {}
    for p, values in grid.items():
        lookup = F.array(*[F.lit(v) for v in values]) if not _contiguous(values) else None
        index = (F.col(p) - values[0]) if lookup is None else F.array_position(lookup, F.col(p)).cast("int") - 1
        target = index + F.col("step")
        ok = (target >= 0) & (target < len(values))
        hit = F.col("param") == p
        inside = inside & (~hit | ok)
        cols[p] = F.when(hit & ok, grid_value(values, target)).otherwise(F.col(p))
    return moved.filter(inside).withColumns(cols).filter(is_valid())


def sensitivity(front: DataFrame, point_id: str, evaluate: Callable[[DataFrame, str], DataFrame], grid: dict[str, list] = SEARCH_GRID) -> DataFrame:
    """Per point: map from parameter to the largest absolute change of CPI and cost over one grid step.

    `evaluate(df, id)` adds `cpi` and `cost` to the perturbed rows. Parameters without a
    feasible neighbour are absent from the map.
    """
    moved = perturbations(front, point_id, grid).withColumn("_move", F.concat_ws("|", F.col(point_id).cast("string"), "param", F.col("step").cast("string")))
    scored = evaluate(moved, "_move")
    worst = scored.groupBy(point_id, "param").agg(
        F.max(F.abs(F.col("cpi") - F.col("_cpi"))).alias("max_abs_dcpi"), F.max(F.abs(F.col("cost") - F.col("_cost"))).alias("max_abs_dcost")
    )
    per_point = worst.groupBy(point_id).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("param", F.struct("max_abs_dcpi", "max_abs_dcost"))))).alias("sensitivity")
    )
    empty = F.expr("CAST(map() AS MAP<STRING, STRUCT<max_abs_dcpi: DOUBLE, max_abs_dcost: DOUBLE>>)")
    return front.join(per_point, point_id, "left").withColumn("sensitivity", F.coalesce("sensitivity", empty))
