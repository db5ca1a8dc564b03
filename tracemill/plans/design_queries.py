"""Queries over the design-space study."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tracemill.functions.registry import FIXED_PARAMS, REGISTRY, SEARCH_GRID, Param
from tracemill.operators import design, metrics, scoring, similarity, skyline, sweeps
from tracemill.plans import bindings as b
from tracemill.plans.catalog import query, rounded
from tracemill.plans.split_queries import md5
from tracemill.plans.sweep_queries import kb

WITH_C = f"WITH {b.C_SQL}"
WITH_P = f"WITH {b.P_SQL}"
GRID = list(SEARCH_GRID)
GRIDS = ", ".join(GRID)
CID = ["cid", "l_orderkey", "l_linenumber"]
CIDS = ", ".join(CID)

WIDTH = " + ".join(design.ISSUE_WIDTHS)
VALID_SQL = f"""(decode_width <= fetch_width AND rename_width <= decode_width AND commit_width <= rename_width AND rob_size >= 8 * commit_width
  AND lq_entries >= read_port_issue_width + rdwr_port_issue_width AND sq_entries >= read_port_issue_width + rdwr_port_issue_width AND {WIDTH} <= 2 * rename_width)"""
COST_SQL = f"""({' + '.join(f'{w!r}E0 * {p}' for p, w in design.COST_WEIGHTS.items())} + 0.4E0 * ({WIDTH}) * ({WIDTH})
  + CASE branch_predictor WHEN 'local' THEN 10.0E0 WHEN 'tage' THEN 100.0E0 END + 30.0E0 + CASE WHEN stride_prefetcher_degree > 0 THEN 15.0E0 ELSE 0.0E0 END
  + 0.1E0 * (5.0E0 * (({kb('l1i_size')}) + ({kb('l1d_size')})) + ({kb('l2_size')})))"""


@query("b16_is_valid", f"{WITH_C} SELECT cid, {VALID_SQL} AS valid FROM c")
def _(spark, sf_dir):
    return b.configs(spark, sf_dir).select("cid", design.is_valid().alias("valid"))


@query("b18_hardware_cost", f"{WITH_C} SELECT cid, round({COST_SQL}, 4) AS cost FROM c")
def _(spark, sf_dir):
    return rounded(b.configs(spark, sf_dir).select("cid", design.hardware_cost().alias("cost")), 4)


_X = "[" + ", ".join(f"{w} - 1" for w in design.ISSUE_WIDTHS) + "]"
REPAIR_SQL = f"""f0 AS (SELECT * REPLACE (greatest(fetch_width, 3) AS fetch_width, greatest(decode_width, 3) AS decode_width, greatest(rename_width, 3) AS rename_width) FROM c),
  f1 AS (SELECT * REPLACE (least(decode_width, fetch_width) AS decode_width, least(rename_width, decode_width, fetch_width) AS rename_width,
    least(commit_width, rename_width, decode_width, fetch_width) AS commit_width) FROM f0),
  f2 AS (SELECT * REPLACE (greatest(rob_size, least(8 * commit_width, 1024)) AS rob_size), {_X} AS x, 2 * rename_width - 6 AS room FROM f1),
  f3 AS (SELECT *, list_max(list_filter(range(0, 8), lambda lv: list_sum(list_transform(x, lambda v: least(v, lv))) <= room)) AS lvl FROM f2),
  f4 AS (SELECT *, room - list_sum(list_transform(x, lambda v: least(v, lvl))) AS lf FROM f3),
  f5 AS (SELECT * EXCLUDE ({', '.join(design.ISSUE_WIDTHS)}), {', '.join(
    f'CAST(least(x[{i + 1}], lvl) + 1 + CASE WHEN x[{i + 1}] > lvl AND len(list_filter(x[{i + 2}:], lambda v: v > lvl)) < lf THEN 1 ELSE 0 END AS INT) AS {w}' for i, w in enumerate(design.ISSUE_WIDTHS))} FROM f4),
  rp AS (SELECT * EXCLUDE (x, room, lvl, lf) REPLACE (greatest(lq_entries, read_port_issue_width + rdwr_port_issue_width) AS lq_entries,
    greatest(sq_entries, read_port_issue_width + rdwr_port_issue_width) AS sq_entries) FROM f5)"""


@query("b17_repair", f"{WITH_C}, {REPAIR_SQL} SELECT cid, {GRIDS}, {VALID_SQL} AS valid FROM rp")
def _(spark, sf_dir):
    fixed = design.repair(b.configs(spark, sf_dir))
    return fixed.select("cid", *GRID, design.is_valid().alias("valid"))


# ---------------------------------------------------------------- sweeps and samples

@query(
    "h1_param_sweep",
    """SELECT resource, p0, p1, n FROM (SELECT l_linenumber % 3 AS resource, count(*) AS n FROM lineitem GROUP BY ALL), (SELECT CAST(unnest(range(1, 9)) AS INT) AS p0), (SELECT unnest([16, 32, 64, 128, 256]) AS p1)""",
)
def _(spark, sf_dir):
    per = b.table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") % 3).alias("resource")).agg(F.count(F.lit(1)).alias("n"))
    swept = per.select("resource", "n", F.inline(design.param_sweep(REGISTRY, ["num_ls_pipes", "l1d_cache_kb"])))
    return swept.select("resource", F.col("num_ls_pipes").alias("p0"), F.col("l1d_cache_kb").alias("p1"), "n")


def _digit(ids: str, p: str, size: int, seed=7) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', CAST({ids} AS VARCHAR), '{seed}|{p}')), 1, 13)) AS BIGINT) % {size})"


def _grid_sql(p: str, digit: str) -> str:
    v = SEARCH_GRID[p]
    if isinstance(v[0], int) and v == list(range(v[0], v[0] + len(v))):
        return f"CAST({digit} + {v[0]} AS INT) AS {p}"
    items = ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in v)
    return f"list_extract([{items}], CAST({digit} + 1 AS BIGINT)) AS {p}"


DRAW_SQL = ", ".join(_grid_sql(p, _digit("o_orderkey", p, len(v))) for p, v in SEARCH_GRID.items())


@query("h2_draw_grid", f"SELECT o_orderkey, {DRAW_SQL}, 1 AS simd_unit_issue_width FROM orders")
def _(spark, sf_dir):
    return design.draw_grid(b.table(spark, sf_dir, "orders"), "o_orderkey", 7)


_SMALL = {p: SEARCH_GRID[p] for p in ("fetch_width", "decode_width", "l1d_size", "l2_size")}


@query(
    "h2_distinct_draws",
    f"""WITH d AS (SELECT o_orderkey, {', '.join(_grid_sql(p, _digit('o_orderkey', p, len(v))) for p, v in _SMALL.items())} FROM orders),
      u AS (SELECT {', '.join(_SMALL)}, min(o_orderkey) AS o_orderkey FROM d GROUP BY ALL) SELECT *, 1 AS simd_unit_issue_width FROM u ORDER BY o_orderkey LIMIT 1000""",
)
def _(spark, sf_dir):
    return design.distinct_draws(b.table(spark, sf_dir, "orders"), "o_orderkey", 1000, 7, _SMALL)


def _permute_sql(names: list[str]) -> str:
    """Places of o_orderkey in the two halves of the grid after the rounds of permute_grid."""
    halves = [names[:len(names) // 2], names[len(names) // 2:]]
    sizes = [math.prod(len(SEARCH_GRID[p]) for p in half) for half in halves]
    sql = f"SELECT o_orderkey, o_orderkey // {sizes[1]} AS p0, o_orderkey % {sizes[1]} AS p1 FROM orders"
    for r in range(design.PERMUTE_ROUNDS):
        to, by = r % 2, (r + 1) % 2
        mixed = f"(p{to} + CAST(('0x' || substr(md5(concat_ws('|', CAST(p{by} AS VARCHAR), '7|{r}')), 1, 13)) AS BIGINT) % {sizes[to]}) % {sizes[to]} AS p{to}"
        sql = f"SELECT o_orderkey, p{by}, {mixed} FROM ({sql})"
    cols = []
    for i, half in enumerate(halves):
        stride = 1
        for p in reversed(half):
            cols.append(_grid_sql(p, f"(p{i} // {stride} % {len(SEARCH_GRID[p])})"))
            stride *= len(SEARCH_GRID[p])
    return f"SELECT o_orderkey, {', '.join(cols)}, 1 AS simd_unit_issue_width FROM ({sql})"


@query("h2_sample_grid", _permute_sql(list(SEARCH_GRID)))
def _(spark, sf_dir):
    return design.permute_grid(b.table(spark, sf_dir, "orders"), "o_orderkey", 7)


@query(
    "h3_decode_index",
    """SELECT o_orderkey, CAST(o_orderkey // 240 % 12 + 1 AS INT) AS fetch_width, CAST(o_orderkey // 20 % 12 + 1 AS INT) AS decode_width,
      list_extract(['16KiB', '32KiB', '64KiB', '128KiB', '256KiB'], o_orderkey // 4 % 5 + 1) AS l1d_size, list_extract(['512KiB', '1MiB', '2MiB', '4MiB'], o_orderkey % 4 + 1) AS l2_size FROM orders""",
)
def _(spark, sf_dir):
    return design.decode_index(b.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", _SMALL)


def _config_sql() -> str:
    cols = []
    for p in REGISTRY.enabled_params():
        if p.kind == "float":
            cols.append(f"round({p.low}E0 + CAST(('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '7|{p.name}')), 1, 13)) AS BIGINT) / 4503599627370496.0E0 * {p.high - p.low}E0, 6) AS {p.name}")
        elif isinstance(p.step, tuple):
            cols.append(f"list_extract({list(p.step)}, {_digit('o_orderkey', p.name, len(p.step))} + 1) AS {p.name}")
        else:
            cols.append(f"CAST({_digit('o_orderkey', p.name, int(p.high - p.low) + 1)} + {int(p.low)} AS INT) AS {p.name}")
    return ", ".join(cols)


@query("h4_sample_configs", f"SELECT o_orderkey, {_config_sql()} FROM orders")
def _(spark, sf_dir):
    return rounded(design.sample_configs(b.table(spark, sf_dir, "orders"), "o_orderkey", 7))


# A parameter of the caller's own, read from a sweep column, swept, sampled and turned into a feature like the others.
DEPTH = REGISTRY.with_param(Param("spec_depth", "l_linenumber", 4, step=(2, 4, 8)))


@query(
    "u2_custom_parameter",
    f"""WITH {b.S_SQL}, d AS (SELECT o_orderkey, list_extract([2, 4, 8], {_digit('o_orderkey', 'spec_depth', 3)} + 1) AS drawn, CAST({_digit('o_orderkey', 'rob_size', 1024)} + 1 AS INT) AS drawn_rob_size FROM orders)
      SELECT {', '.join(b.SWEEP_KEY)}, CAST(l_linenumber AS INT) AS spec_depth, CAST(commit_width AS INT) AS commit_width, drawn, drawn_rob_size,
        (SELECT count(*) FROM (VALUES (2), (4), (8)) v(x) WHERE x >= l_linenumber) * 8 AS n_swept
      FROM s JOIN d ON l_orderkey = o_orderkey""",
)
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir).withColumns({c: F.lit(2) for c in ("rdwr_port_issue_width", "read_port_issue_width")})
    mapped = sweeps.config_features(sweeps.to_config(s, DEPTH, b.SWEEP_KEY), DEPTH, b.SWEEP_KEY)
    drawn = design.sample_configs(b.table(spark, sf_dir, "orders"), "o_orderkey", 7, DEPTH)
    drawn = drawn.select(F.col("o_orderkey").alias("l_orderkey"), F.col("spec_depth").alias("drawn"), F.col("rob_size").alias("drawn_rob_size"))
    swept = F.filter(design.param_sweep(DEPTH, ["spec_depth", "num_ls_pipes"]), lambda p: p["spec_depth"] >= F.col("spec_depth"))
    return mapped.join(drawn, "l_orderkey").select(*b.SWEEP_KEY, "spec_depth", "commit_width", "drawn", "drawn_rob_size", F.size(swept).cast("bigint").alias("n_swept"))


_HYPER = SEARCH_GRID


def _hyper_sql(p: str) -> str:
    n = len(SEARCH_GRID[p])
    h = md5(["o_orderkey"], f"7|{p}")
    u = f"CAST(('0x' || substr({md5(['o_orderkey'], f'7|{p}|u')}, 1, 13)) AS BIGINT) / 4503599627370496.0E0"
    digit = f"least(CAST(floor((row_number() OVER (ORDER BY {h}, o_orderkey) - 1 + {u}) / count(*) OVER () * {n}) AS BIGINT), {n - 1})"
    return _grid_sql(p, digit)


@query("h5_latin_hypercube", f"SELECT o_orderkey, {', '.join(_hyper_sql(p) for p in _HYPER)} FROM orders")
def _(spark, sf_dir):
    return design.latin_hypercube(b.table(spark, sf_dir, "orders"), "o_orderkey", 7, _HYPER)


# ---------------------------------------------------------------- skyline

_FRONT = "pf AS (SELECT DISTINCT cost, cpi FROM (SELECT cost, cpi, min(cpi) OVER (ORDER BY cost, cpi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p) WHERE m IS NULL OR cpi < m)"


@query("f1_pareto_front", f"{WITH_P}, {_FRONT} SELECT cost, cpi FROM pf")
def _(spark, sf_dir):
    return skyline.pareto_front(b.points(spark, sf_dir), "cost", "cpi", ["pid"]).select("cost", "cpi")


N_TARGET = 60
_PEEL = "min(cpi) OVER (ORDER BY cost, cpi, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m"


@query(
    "f2_pareto_layers",
    f"""WITH RECURSIVE pts AS (SELECT cost, cpi, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rid
        FROM (SELECT l_extendedprice AS cost, 51.0E0 - l_quantity AS cpi, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)),
      peel AS (
        SELECT 0 AS layer, rid, cost, cpi, on_front, sum(on_front::INT) OVER () AS taken FROM (SELECT *, coalesce(cpi < m, true) AS on_front FROM (SELECT *, {_PEEL} FROM pts))
        UNION ALL
        SELECT layer + 1, rid, cost, cpi, on_front, taken + sum(on_front::INT) OVER ()
        FROM (SELECT *, coalesce(cpi < m, true) AS on_front FROM (SELECT layer, rid, cost, cpi, taken, {_PEEL} FROM peel WHERE NOT on_front AND taken < {N_TARGET})))
      SELECT CAST(layer AS INT) AS layer, cost, cpi FROM peel WHERE on_front""",
)
def _(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    pts = li.select(*key, F.col("l_extendedprice").alias("cost"), (F.lit(51.0) - F.col("l_quantity")).alias("cpi"))
    return skyline.pareto_layers(pts, "cost", "cpi", key, N_TARGET).select("layer", "cost", "cpi")


PRICED = f"pc AS (SELECT *, round({COST_SQL}, 4) AS cost FROM c)"
_FINAL = f"""u AS (SELECT {GRIDS}, min((cpi, cost)) AS m FROM pc GROUP BY ALL), v AS (SELECT {GRIDS}, m[1] AS cpi, m[2] AS cost FROM u WHERE {VALID_SQL}),
  ff AS (SELECT cpi, cost FROM (SELECT cpi, cost, min(cost) OVER (ORDER BY cpi, cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM v) WHERE pm IS NULL OR cost < pm)"""


def priced(spark, sf_dir):
    return b.configs(spark, sf_dir).withColumn("cost", F.round(design.hardware_cost(), 4))


def final(spark, sf_dir):
    p = priced(spark, sf_dir).select(*GRID, "cpi", "cost")
    low, high = p.filter(F.col("branch_predictor") == "local"), p.filter(F.col("branch_predictor") == "tage")
    return skyline.final_front([low, high], GRID, design.is_valid())


@query("f3_final_front", f"{WITH_C}, {PRICED}, {_FINAL} SELECT round(cpi, 6) AS cpi, cost FROM ff")
def _(spark, sf_dir):
    return rounded(final(spark, sf_dir).select("cpi", "cost"))


@query(
    "f4_flag_validation",
    f"""{WITH_P}, {_FRONT}, r AS (SELECT *, row_number() OVER (ORDER BY cost, cpi) - 1 AS pos, count(*) OVER () AS n FROM pf)
      SELECT cost, cpi, pos = 0 OR cpi = (SELECT min(cpi) FROM pf) OR (n >= 2 AND pos IN (SELECT CAST(floor(i * (n - 1) / 4) AS BIGINT) FROM range(1, 4) q(i))) AS validation_candidate FROM r""",
)
def _(spark, sf_dir):
    front = skyline.pareto_front(b.points(spark, sf_dir), "cost", "cpi", ["pid"])
    return skyline.flag_validation(front, 5).select("cost", "cpi", "validation_candidate")


@query(
    "f6_ordered_configs",
    f"WITH {b.L_SQL} SELECT l1i_kb, l1d_kb, l2_kb, count(*) AS n, row_number() OVER (ORDER BY l1i_kb, l1d_kb, l2_kb) - 1 AS pos FROM l GROUP BY l1i_kb, l1d_kb, l2_kb",
)
def _(spark, sf_dir):
    from tracemill.operators.ordered import bucketed_rank
    keys = ["l1i_kb", "l1d_kb", "l2_kb"]
    per = b.latency(spark, sf_dir).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return bucketed_rank(per, [], F.col("l1i_kb"), keys, "pos").orderBy(*keys)


@query("e10_rank_pick", f"{WITH_P} SELECT pid, cost, cpi FROM p QUALIFY row_number() OVER (PARTITION BY pid ORDER BY cost, cpi) <= 2")
def _(spark, sf_dir):
    return skyline.rank_pick(b.points(spark, sf_dir), ["pid"], ["cost", "cpi"], 2)


@query(
    "e10_thin_series",
    """WITH r AS (SELECT o_custkey % 20 AS run_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey % 20) AS n FROM orders)
      SELECT run_id, pos FROM r WHERE n <= 200 OR pos IN (SELECT i * (n - 1) // 199 FROM range(0, 200) q(i))""",
)
def _(spark, sf_dir):
    from tracemill.operators.ordered import SEGMENT_ROWS, bucketed_rank
    o = b.table(spark, sf_dir, "orders").withColumn("run_id", F.col("o_custkey") % 20)
    ranked = bucketed_rank(o, ["run_id"], F.floor(F.col("o_orderkey") / SEGMENT_ROWS), ["o_orderkey"], "pos", "n")
    return skyline.thin_series(ranked, "pos", "n", 200).select("run_id", "pos")


# ---------------------------------------------------------------- inference, scoring, sensitivity

# Program features, cache rows and predictor rates of eight traces, aggregated from the
# events for every memory configuration.
SIZES_L1, SIZES_L2 = [16, 32, 64, 128, 256], [512, 1024, 2048, 4096]
BUNDLE_SQL = f"""bp AS (SELECT user_id % 8 AS trace_id, avg(value) AS mean_value, count(*)::DOUBLE AS n_rows FROM events GROUP BY ALL),
  bc AS (SELECT trace_id, l1i_kb, l1d_kb, l2_kb, mean_value / l1i_kb AS fetch_mean, mean_value / l1d_kb + 100.0E0 / l2_kb AS exec_mean
    FROM bp, (SELECT unnest({SIZES_L1}) AS l1i_kb), (SELECT unnest({SIZES_L1}) AS l1d_kb), (SELECT unnest({SIZES_L2}) AS l2_kb)),
  br AS (SELECT user_id % 8 AS trace_id, bt AS branch_predictor, CASE bt WHEN 'local' THEN 0.1E0 ELSE 0.05E0 END * avg(CAST(event_type = 'error' AS INT)) AS rate
    FROM events, (VALUES ('local'), ('tage')) x(bt) GROUP BY user_id % 8, bt)"""


def bundles(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events").withColumn("trace_id", F.col("user_id") % 8)
    agg = ev.groupBy("trace_id").agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).cast("double").alias("n_rows"), F.avg((F.col("event_type") == "error").cast("int")).alias("_err"))
    arr = lambda v: F.explode(F.array(*[F.lit(x) for x in v]))
    cache = agg.withColumn("l1i_kb", arr(SIZES_L1)).withColumn("l1d_kb", arr(SIZES_L1)).withColumn("l2_kb", arr(SIZES_L2))
    fetch = F.col("mean_value") / F.col("l1i_kb")
    exe = F.col("mean_value") / F.col("l1d_kb") + F.lit(100.0) / F.col("l2_kb")
    cache = cache.select(
        "trace_id", "l1i_kb", "l1d_kb", "l2_kb", fetch.alias("fetch_mean"), exe.alias("exec_mean"),
        *[fetch.alias(f"fetch_p{p}") for p in (50, 75, 95)], *[exe.alias(f"exec_p{p}") for p in (50, 75, 95)],
    )
    rates = agg.withColumn("bp_type", arr(["local", "tage"])).select(
        "trace_id", "bp_type", (F.when(F.col("bp_type") == "local", 0.1).otherwise(0.05).cast("double") * F.col("_err")).alias("misprediction_rate")
    )
    return agg.drop("_err"), cache, rates


FEATURES = ["rob_size", "fetch_width", "l1d_size", "reciprocal_rob_size", "stride_prefetcher_degree_4", "prog_mean_value", "cache_fetch_mean", "cache_exec_mean", "bp_misprediction_rate"]
# Sizes are parsed once a configuration; {rows} is the table of configurations.
WIDE_SQL = f"""kk AS MATERIALIZED (SELECT cid, rob_size, fetch_width, stride_prefetcher_degree, branch_predictor, ({kb('l1i_size')}) AS k1i, ({kb('l1d_size')}) AS k1d, ({kb('l2_size')}) AS k2 FROM {{rows}}),
  bb AS MATERIALIZED (SELECT bc.*, bp.mean_value, br.branch_predictor, br.rate FROM bc JOIN bp USING (trace_id) JOIN br USING (trace_id)),
  wi AS MATERIALIZED (SELECT cid, bb.trace_id, rob_size::DOUBLE AS rob_size, fetch_width::DOUBLE AS fetch_width, k1d * 1024.0E0 AS l1d_size, 1.0E0 / rob_size AS reciprocal_rob_size,
    CAST(stride_prefetcher_degree = 4 AS INT)::DOUBLE AS stride_prefetcher_degree_4, mean_value AS prog_mean_value, fetch_mean AS cache_fetch_mean, exec_mean AS cache_exec_mean, rate AS bp_misprediction_rate
  FROM kk JOIN bb ON bb.l1i_kb = k1i AND bb.l1d_kb = k1d AND bb.l2_kb = k2 AND bb.branch_predictor = kk.branch_predictor)"""

# A fixed linear scorer, so that the SQL text can restate it.
SCORE_WEIGHTS = {
    "reciprocal_rob_size": 2.0, "fetch_width": -0.01, "prog_mean_value": 0.002, "cache_fetch_mean": 0.05,
    "cache_exec_mean": 0.04, "bp_misprediction_rate": 3.0, "stride_prefetcher_degree_4": -0.02,
}
SCORE_SQL = "(1.0E0 + " + " + ".join(f"({w}E0) * {c}" for c, w in SCORE_WEIGHTS.items()) + ")"


def linear_score(df):
    total = F.lit(1.0)
    for c, w in SCORE_WEIGHTS.items():
        total = total + F.lit(w) * F.col(c)
    return df.withColumn("predicted_cpi", total)


@query(
    "c11_assemble_inference",
    f"""{WITH_C}, {BUNDLE_SQL}, {WIDE_SQL.format(rows='c')} SELECT trace_id, count(*) AS n, {', '.join(f'round(avg({f}), 6) AS {f}' for f in FEATURES)} FROM wi GROUP BY ALL""",
)
def _(spark, sf_dir):
    wide = design.assemble_inference(b.configs(spark, sf_dir), *bundles(spark, sf_dir), "cid", FEATURES)
    return rounded(wide.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in FEATURES]))


@query(
    "c11_scaled_inference",
    f"""{WITH_C}, {BUNDLE_SQL}, {WIDE_SQL.format(rows='c')}, st AS (SELECT avg(rob_size) AS m, stddev_pop(rob_size) AS d, avg(cache_exec_mean) AS m2, stddev_pop(cache_exec_mean) AS d2 FROM wi)
      SELECT cid, trace_id, round((rob_size - m) / d, 6) AS rob_size, round((cache_exec_mean - m2) / d2, 6) AS cache_exec_mean FROM wi, st""",
)
def _(spark, sf_dir):
    cols = ["rob_size", "cache_exec_mean"]
    args = (b.configs(spark, sf_dir), *bundles(spark, sf_dir), "cid", [*cols, "bp_misprediction_rate"])
    plain = design.assemble_inference(*args)
    names = [*cols, "bp_misprediction_rate"]
    scaler = plain.agg(F.struct(*[F.avg(c).alias(c) for c in names]).alias("mean"), F.struct(*[F.stddev_pop(c).alias(c) for c in names]).alias("scale"))
    return rounded(design.assemble_inference(*args, scaler).select("cid", "trace_id", *cols))


@query(
    "i3_evaluate_configs",
    f"""{WITH_C}, {BUNDLE_SQL}, {WIDE_SQL.format(rows='c')}, sc AS (SELECT cid, avg({SCORE_SQL}) AS cpi FROM wi GROUP BY ALL)
      SELECT cid, round(sc.cpi, 6) AS cpi, round({COST_SQL}, 4) AS cost FROM c JOIN sc USING (cid)""",
)
def _(spark, sf_dir):
    out = design.evaluate_configs(b.configs(spark, sf_dir).drop("cpi"), *bundles(spark, sf_dir), "cid", linear_score, features=FEATURES)
    return out.select("cid", F.round("cpi", 6).alias("cpi"), F.round("cost", 4).alias("cost"))


@query("d34_mean_cpi_over_traces", f"WITH {b.S_SQL} SELECT rob_size, round(avg(predicted_cpi), 6) AS cpi FROM s GROUP BY ALL")
def _(spark, sf_dir):
    return rounded(design.mean_cpi_over_traces(b.sweep(spark, sf_dir), "rob_size"))


@query(
    "u3_custom_cost",
    f"{WITH_C}, {BUNDLE_SQL}, {WIDE_SQL.format(rows='c')}, sc AS (SELECT cid, avg({SCORE_SQL}) AS cpi FROM wi GROUP BY ALL) SELECT cid, round(sc.cpi, 6) AS cpi, rob_size * 2.0E0 + fetch_width AS cost FROM c JOIN sc USING (cid)",
)
def _(spark, sf_dir):
    out = design.evaluate_configs(
        b.configs(spark, sf_dir).drop("cpi"), *bundles(spark, sf_dir), "cid", linear_score, F.col("rob_size") * 2.0 + F.col("fetch_width"), FEATURES
    )
    return rounded(out.select("cid", "cpi", "cost"))


def _moves_sql() -> str:
    parts = []
    for p, values in SEARCH_GRID.items():
        for step in (-1, 1):
            if isinstance(values[0], int) and len(values) > 2:
                new, ok = f"{p} + {step}", f"{p} + {step} BETWEEN {values[0]} AND {values[-1]}"
            else:
                items = ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in values)
                pos = f"list_position([{items}], {p})"
                new, ok = f"list_extract([{items}], {pos} + {step})", f"{pos} + {step} BETWEEN 1 AND {len(values)}"
            parts.append(f"SELECT fid, '{p}' AS param, base_cpi, base_cost, {', '.join(f'{new} AS {q}' if q == p else q for q in GRID)} FROM fb WHERE {ok}")
    return " UNION ALL ".join(parts)


@query(
    "d29_sensitivity",
    f"""{WITH_C}, {PRICED}, {_FINAL}, {BUNDLE_SQL}, fb AS (SELECT CAST(row_number() OVER (ORDER BY cost) AS VARCHAR) AS fid, round(cpi, 6) AS base_cpi, cost AS base_cost, {GRIDS}
        FROM (SELECT *, min(cost) OVER (ORDER BY cpi, cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM v) WHERE pm IS NULL OR cost < pm),
      mv AS ({_moves_sql()}), ok AS (SELECT *, row_number() OVER () AS cid FROM mv WHERE {VALID_SQL}), {WIDE_SQL.format(rows='ok')},
      sc AS (SELECT cid, avg({SCORE_SQL}) AS cpi FROM wi GROUP BY ALL)
      SELECT base_cost AS point_cost, param, round(max(abs(sc.cpi - base_cpi)), 5) AS max_abs_dcpi, round(max(abs({COST_SQL} - base_cost)), 4) AS max_abs_dcost FROM ok JOIN sc USING (cid) GROUP BY fid, base_cost, param""",
)
def _(spark, sf_dir):
    front = final(spark, sf_dir).withColumn("cpi", F.round("cpi", 6)).withColumn("fid", F.col("cost").cast("string"))
    front = front.withColumns({p: F.lit(v) for p, v in FIXED_PARAMS.items()})
    parts = bundles(spark, sf_dir)

    def evaluate(df, key):
        return design.evaluate_configs(df, *parts, key, linear_score, features=FEATURES)

    out = design.sensitivity(front, "fid", evaluate)
    flat = out.select(F.col("cost").alias("point_cost"), F.explode("sensitivity").alias("param", "s"))
    return flat.select("point_cost", "param", F.round("s.max_abs_dcpi", 5).alias("max_abs_dcpi"), F.round("s.max_abs_dcost", 4).alias("max_abs_dcost"))


@query(
    "c10_cross_sweep",
    f"""{WITH_P}, {_FRONT}, wl AS (SELECT DISTINCT 'b' || CAST(l_suppkey % 9 AS VARCHAR) AS benchmark, l_orderkey % 50 AS region FROM lineitem)
      SELECT benchmark, region, cost, cpi FROM wl, pf""",
)
def _(spark, sf_dir):
    front = skyline.pareto_front(b.points(spark, sf_dir), "cost", "cpi", ["pid"]).select("cost", "cpi")
    workloads = b.sweep(spark, sf_dir).select("benchmark", "region").distinct()
    return design.cross_sweep(front, workloads, ["benchmark", "region"])


_CMP = ["commit_width", "l1d_size", "branch_predictor"]


@query(
    "c14_compare_pareto",
    f"""WITH {b.S_SQL}, pr AS (SELECT {', '.join(_CMP)}, min(predicted_cpi) AS predicted_cpi FROM s GROUP BY ALL), ac AS (SELECT {', '.join(_CMP)}, avg(cpi) AS cpi FROM s WHERE region < 49 GROUP BY ALL)
      SELECT {', '.join(_CMP)}, round(predicted_cpi, 6) AS predicted_cpi, round(cpi, 6) AS cpi, round(abs(predicted_cpi - cpi) / cpi * 100.0E0, 6) AS error FROM pr LEFT JOIN ac USING ({', '.join(_CMP)})""",
)
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    predicted = s.groupBy(*_CMP).agg(F.min("predicted_cpi").alias("predicted_cpi"))
    return rounded(metrics.compare_pareto(predicted, s.filter(F.col("region") < 49), _CMP))


_NUM, _CAT = ["rob_size", "lq_entries", "commit_width", "stride_prefetcher_degree"], ["branch_predictor", "l1d_size", "l2_size"]


@query(
    "c16_neighbor_density",
    f"""WITH {b.S_SQL}, tc AS (SELECT DISTINCT {', '.join(_NUM + _CAT)} FROM s), rg AS (SELECT {', '.join(f'min({c}) AS lo_{c}, greatest(max({c}) - min({c}), 1)::DOUBLE AS sp_{c}' for c in _NUM)} FROM tc),
      qu AS (SELECT CAST(l_suppkey AS BIGINT) AS qid, {', '.join(_NUM + _CAT)} FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, ship) = 1),
      pa AS (SELECT qid, {' + '.join(f'CAST(q.{c} <> t.{c} AS INT)' for c in _CAT)} AS cats, {' + '.join(f'CAST(q.{c} <> t.{c} AS INT)' for c in _NUM)} AS nums,
        sqrt({' + '.join(f'((q.{c} - t.{c}) / sp_{c}) ** 2' for c in _NUM)}) AS l2 FROM qu q, tc t, rg)
      SELECT qid, min(cats + nums)::BIGINT AS min_hamming, count(*) FILTER (cats + nums <= 3) AS n_within_hamming_r, count(*) FILTER (l2 <= 0.5E0 AND cats = 0) AS n_within_l2_r FROM pa GROUP BY ALL""",
)
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    queries = skyline.rank_pick(s, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "ship"]).select(F.col("l_suppkey").alias("qid"), *_NUM, *_CAT)
    return similarity.neighbor_density(queries, s, "qid", _NUM, _CAT, hamming_r=3)


def _network(n_in: int) -> list:
    """Deterministic small weights for a 3-layer network."""
    sizes = [n_in, *scoring.HIDDEN, 1]
    layers = []
    for a, c in zip(sizes, sizes[1:]):
        i, j = np.meshgrid(np.arange(a), np.arange(c), indexing="ij")
        layers.append((((i * 31 + j * 17) % 23 - 11) / (23.0 * np.sqrt(a)), ((np.arange(c) * 7) % 5 - 2) / 50.0))
    return layers


@query("i2_score_mlp")
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir).select(*b.SWEEP_KEY, F.col("rob_size").cast("double").alias("rob_size"), F.col("commit_width").cast("double").alias("commit_width"), "cpi")
    scaled = metrics.standard_scale(s, s, ["rob_size", "commit_width"])
    return rounded(scoring.score_mlp(scaled, ["rob_size", "commit_width"], _network(2)), 4)


# A network whose weights and inputs are whole multiples of a power of two: exact in single precision.
_SMALL_NET = [(np.array([[0.5, -0.25, 0.125], [-1.0, 2.0, 0.5]]), np.array([1.0, -4.0, 0.5])), (np.array([[0.25], [0.5], [-2.0]]), np.array([3.0]))]


@query(
    "i2_score_small_network",
    f"""WITH {b.S_SQL}, h AS (SELECT {', '.join(b.SWEEP_KEY)}, greatest(0.5E0 * rob_size - commit_width + 1.0E0, 0.0E0) AS h0, greatest(-0.25E0 * rob_size + 2.0E0 * commit_width - 4.0E0, 0.0E0) AS h1,
        greatest(0.125E0 * rob_size + 0.5E0 * commit_width + 0.5E0, 0.0E0) AS h2 FROM s)
      SELECT {', '.join(b.SWEEP_KEY)}, 0.25E0 * h0 + 0.5E0 * h1 - 2.0E0 * h2 + 3.0E0 AS predicted_cpi FROM h""",
)
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir).select(*b.SWEEP_KEY, "rob_size", "commit_width")
    return scoring.score_mlp(s, ["rob_size", "commit_width"], _SMALL_NET).select(*b.SWEEP_KEY, "predicted_cpi")


@query(
    "i1_fit_regressor",
    f"""WITH {b.S_SQL}, tr AS (SELECT * FROM s WHERE region < 40), f AS (SELECT regr_slope(cpi, lq_entries::DOUBLE) AS k, regr_intercept(cpi, lq_entries::DOUBLE) AS b FROM tr)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lq_entries, round(k * lq_entries + b, 4) AS predicted_cpi FROM s, f WHERE region >= 40""",
)
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir).drop("predicted_cpi")
    model = scoring.fit_regressor(s.filter(F.col("region") < 40), ["lq_entries"])
    out = scoring.predict(model, s.filter(F.col("region") >= 40))
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "lq_entries", "predicted_cpi"), 4)


def prepared_sweep(spark, sf_dir):
    """All prepared features of the sweep beside its keys, label, region and benchmark number; and the features' names."""
    s = b.sweep(spark, sf_dir).drop("predicted_cpi", "ship")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    kept = s.withColumns({"region_id": F.col("region"), "benchmark_id": F.substring("benchmark", 2, 9).cast("int"), "label": F.col("cpi")})
    wide = sweeps.prepare_features(kept)
    features = [c for c in wide.columns if c not in (*keys, "region_id", "benchmark_id", "label")]
    return wide.withColumns({c: F.col(c).cast("bigint") for c in (*keys, "region_id", "benchmark_id")}), features


@query("d23_ols_r2_all_features")
def _(spark, sf_dir):
    """R² over all prepared features; two of them depend on others. Tested against a solver outside Spark."""
    wide, features = prepared_sweep(spark, sf_dir)
    return wide.agg(F.round(F.lit(metrics.ols_r2(wide, features, "label")), 6).alias("r2"))


@query("d23_r2_all_features_by_group")
def _(spark, sf_dir):
    wide, features = prepared_sweep(spark, sf_dir)
    return rounded(metrics.ols_r2_by_group(wide, ["benchmark_id"], features, "label"))


@query("i1_fit_absolute")
def _(spark, sf_dir):
    """A plane of least absolute deviations over all prepared features, fitted on four fifths of the regions, applied to the rest."""
    wide, features = prepared_sweep(spark, sf_dir)
    model = scoring.fit_regressor(wide.where("region_id < 40"), features, "label", kind="absolute")
    out = scoring.predict(model, wide.where("region_id >= 40"))
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("label").alias("cpi"), "predicted_cpi"), 4)
