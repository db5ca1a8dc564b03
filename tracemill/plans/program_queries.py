"""Queries over the program behaviour of traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import opclass, scalars
from tracemill.operators import program, windows
from tracemill.plans import bindings as b
from tracemill.plans.catalog import query, rounded

WITH_T = f"WITH {b.T_SQL}"

MIX_SQL = """count(*) FILTER (op_class = 'IntAlu') / count(*)::DOUBLE AS frac_int_alu, 0.0E0 AS frac_int_mult_div, 0.0E0 AS frac_fp_alu,
  count(*) FILTER (op_class = 'FloatMult') / count(*)::DOUBLE AS frac_fp_mult_div, 0.0E0 AS frac_simd,
  count(*) FILTER (op_class = 'MemRead') / count(*)::DOUBLE AS frac_load, count(*) FILTER (op_class = 'MemWrite') / count(*)::DOUBLE AS frac_store,
  0.0E0 AS frac_other, count(branch_type) / count(*)::DOUBLE AS frac_branch"""
BRANCH_SQL = """count(branch_type) / count(*)::DOUBLE AS branch_rate,
  coalesce(count(*) FILTER (branch_type = 'indirect') / nullif(count(branch_type), 0)::DOUBLE, 0) AS frac_indirect_branches,
  coalesce(count(*) FILTER (branch_type = 'direct_conditional') / nullif(count(branch_type), 0)::DOUBLE, 0) AS frac_direct_cond_branches,
  coalesce(count(*) FILTER (branch_type = 'direct_unconditional') / nullif(count(branch_type), 0)::DOUBLE, 0) AS frac_direct_uncond_branches"""
SYNC_SQL = "count(*) FILTER (inst_sync) / count(*)::DOUBLE AS frac_sync_instructions"
MEMORY_SQL = """count(*) FILTER (op_class IN ('MemRead', 'MemWrite')) / count(*)::DOUBLE AS memory_instruction_fraction,
  coalesce(count(*) FILTER (op_class = 'MemWrite') / nullif(count(*) FILTER (op_class = 'MemRead'), 0)::DOUBLE, 0) AS store_to_load_ratio"""
_MEM = "len(read_addrs) + len(write_addrs) > 0"
HAZARD_SQL = f"""coalesce(count(*) FILTER ({_MEM} AND len(mem_deps) > 0) / nullif(count(*) FILTER ({_MEM}), 0)::DOUBLE, 0) AS frac_mem_dependent,
  coalesce(count(*) FILTER ({_MEM} AND len(mem_deps) > 1) / nullif(count(*) FILTER ({_MEM}), 0)::DOUBLE, 0) AS frac_memory_ordering_hazards"""
PAGES_SQL = """CAST(count(DISTINCT read_addrs[1] >> 12) AS DOUBLE) AS unique_load_pages, CAST(count(DISTINCT write_addrs[1] >> 12) AS DOUBLE) AS unique_store_pages"""
DEPS_SQL = "dd AS (SELECT trace_id, idx, generate_subscripts(reg_deps, 1) AS pos, unnest(reg_deps) AS dep FROM t)"
DIST_SQL = """di AS (SELECT dd.trace_id, dd.idx, CAST(dd.pos - 1 AS INT) AS pos, dd.dep AS dep_ip, dd.idx - t.idx AS distance
  FROM dd ASOF LEFT JOIN t ON dd.trace_id = t.trace_id AND dd.dep = t.ip AND dd.idx > t.idx)"""
FAN_SQL = "fo AS (SELECT trace_id, count(*) / count(DISTINCT dep)::DOUBLE AS mean_reg_fan_out FROM dd GROUP BY ALL)"
BLOCK_SQL = """bi AS (SELECT trace_id, idx, coalesce(sum(CASE WHEN branch_type IS NOT NULL AND taken THEN 1 ELSE 0 END)
    OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block_id FROM t),
  bs AS (SELECT trace_id, block_id, count(*) AS block_size FROM bi GROUP BY ALL),
  bb AS (SELECT trace_id, avg(block_size) AS mean_basic_block_size, quantile_cont(block_size, 0.5) AS p50_basic_block_size,
    quantile_cont(block_size, 0.95) AS p95_basic_block_size FROM bs GROUP BY ALL)"""
DEPSTAT_SQL = """df AS (SELECT trace_id, idx, max(distance) AS far FROM di WHERE distance IS NOT NULL GROUP BY ALL),
  ds AS (SELECT * FROM (SELECT trace_id, avg(distance) AS mean_reg_dep_distance, quantile_cont(distance, 0.5) AS p50_reg_dep_distance,
      quantile_cont(distance, 0.95) AS p95_reg_dep_distance FROM di WHERE distance IS NOT NULL GROUP BY ALL)
    JOIN (SELECT t.trace_id, count(*) FILTER (far IS NULL OR far > 16) / count(*)::DOUBLE AS frac_independent_last_16,
      count(*) FILTER (far > 10) / count(*)::DOUBLE AS crit_path_density_10 FROM t LEFT JOIN df USING (trace_id, idx) GROUP BY ALL) USING (trace_id))"""
DELTA_SQL = """ld AS (SELECT trace_id, idx, ip, read_addrs[1] AS addr, lag(read_addrs[1]) OVER (PARTITION BY trace_id, ip ORDER BY idx) AS prev_addr
    FROM t WHERE len(read_addrs) > 0)"""
STRIDE_SQL = """st AS (SELECT trace_id, ip, addr - prev_addr AS delta, count(*) AS n FROM ld GROUP BY ALL),
  si AS (SELECT trace_id, ip, sum(n) AS loads, sum(n) FILTER (delta IS NOT NULL) AS steps, max(n) FILTER (delta IS NOT NULL) AS best FROM st GROUP BY ALL),
  sr AS (SELECT tt.trace_id, coalesce(avg(best / steps::DOUBLE), 0) AS load_stride_regularity FROM (SELECT DISTINCT trace_id FROM t) tt
    LEFT JOIN si ON tt.trace_id = si.trace_id AND loads >= 16 AND steps > 0 GROUP BY ALL)"""


def _round_all(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _simple(name: str, exprs: str, op, cols: list[str]) -> None:
    sql = f"{WITH_T}, x AS (SELECT trace_id, {exprs} FROM t GROUP BY ALL) SELECT trace_id, {_round_all(cols)} FROM x"
    query(name, sql)(lambda spark, sf_dir: rounded(op(b.trace(spark, sf_dir))))


_simple("d1_instruction_mix", MIX_SQL, program.instruction_mix, [*program.GROUP_FEATURES.values(), "frac_branch"])
_simple("d2_branch_mix", BRANCH_SQL, program.branch_mix, ["branch_rate", "frac_indirect_branches", "frac_direct_cond_branches", "frac_direct_uncond_branches"])
_simple("d3_sync_fraction", SYNC_SQL, program.sync_fraction, ["frac_sync_instructions"])
_simple("d4_memory_mix", MEMORY_SQL, program.memory_mix, ["memory_instruction_fraction", "store_to_load_ratio"])
_simple("d5_unique_pages", PAGES_SQL, program.unique_pages, ["unique_load_pages", "unique_store_pages"])
_simple("d6_memory_hazards", HAZARD_SQL, program.memory_hazards, ["frac_mem_dependent", "frac_memory_ordering_hazards"])


@query("d7_fan_out", f"{WITH_T}, {DEPS_SQL}, {FAN_SQL} SELECT trace_id, round(mean_reg_fan_out, 6) AS mean_reg_fan_out FROM fo")
def _(spark, sf_dir):
    return rounded(program.fan_out(b.trace(spark, sf_dir)))


@query("d8_basic_blocks", f"{WITH_T}, {BLOCK_SQL} SELECT trace_id, {_round_all(['mean_basic_block_size', 'p50_basic_block_size', 'p95_basic_block_size'])} FROM bb")
def _(spark, sf_dir):
    return rounded(program.basic_blocks(b.trace(spark, sf_dir)))


@query("e3_block_id", f"{WITH_T}, {BLOCK_SQL} SELECT trace_id, idx, block_id FROM bi")
def _(spark, sf_dir):
    t = b.trace(spark, sf_dir).select("trace_id", "idx", "branch_type", "taken")
    return windows.block_id(t).select("trace_id", "idx", "block_id")


_DEPCOLS = ["mean_reg_dep_distance", "p50_reg_dep_distance", "p95_reg_dep_distance", "frac_independent_last_16", "crit_path_density_10"]


@query("d9_dependency_stats", f"{WITH_T}, {DEPS_SQL}, {DIST_SQL}, {DEPSTAT_SQL} SELECT trace_id, {_round_all(_DEPCOLS)} FROM ds")
def _(spark, sf_dir):
    return rounded(program.dependency_stats(b.trace(spark, sf_dir)))


@query("c8_last_seen_distance", f"{WITH_T}, {DEPS_SQL}, {DIST_SQL} SELECT * FROM di")
def _(spark, sf_dir):
    return program.last_seen_distance(b.trace(spark, sf_dir))


@query("d10_stride_regularity", f"{WITH_T}, {DELTA_SQL}, {STRIDE_SQL} SELECT trace_id, {_round_all(['load_stride_regularity'])} FROM sr")
def _(spark, sf_dir):
    return rounded(program.stride_regularity(b.trace(spark, sf_dir)))


@query("e8_lag_delta", f"{WITH_T}, {DELTA_SQL} SELECT trace_id, idx, ip, addr, prev_addr, CAST(addr - prev_addr AS BIGINT) AS delta FROM ld")
def _(spark, sf_dir):
    d = windows.lag_delta(b.trace(spark, sf_dir))
    return d.select("trace_id", "idx", "ip", "addr", "prev_addr", F.col("delta").cast("bigint").alias("delta"))


@query(
    "d11_program_features",
    f"""{WITH_T}, {DEPS_SQL}, {DIST_SQL}, {DEPSTAT_SQL}, {FAN_SQL}, {BLOCK_SQL}, {DELTA_SQL}, {STRIDE_SQL},
      x AS (SELECT trace_id, {MIX_SQL}, {BRANCH_SQL}, {SYNC_SQL}, {MEMORY_SQL}, {HAZARD_SQL}, {PAGES_SQL} FROM t GROUP BY ALL)
      SELECT trace_id, {_round_all(program.PROGRAM_FEATURES)} FROM x JOIN ds USING (trace_id) JOIN fo USING (trace_id)
        JOIN bb USING (trace_id) JOIN sr USING (trace_id)""",
)
def _(spark, sf_dir):
    return rounded(program.program_features(b.trace(spark, sf_dir)))


@query(
    "c9_resolve_dependencies",
    f"""{WITH_T}, m AS (SELECT trace_id, ip, max(idx) AS dep_idx FROM t GROUP BY ALL),
      u AS (SELECT trace_id, idx, unnest(list_concat(reg_deps, mem_deps)) AS dep FROM t),
      f AS (SELECT u.trace_id, u.idx, list_sort(list(DISTINCT dep_idx)) AS deps FROM u JOIN m ON u.trace_id = m.trace_id AND u.dep = m.ip AND dep_idx < u.idx GROUP BY ALL)
      SELECT t.trace_id, t.idx, array_to_string(coalesce(f.deps, []), ',') AS deps FROM t LEFT JOIN f USING (trace_id, idx)""",
)
def _(spark, sf_dir):
    r = program.resolve_dependencies(b.trace(spark, sf_dir))
    return r.select("trace_id", "idx", F.array_join(F.col("deps").cast("array<string>"), ",").alias("deps"))


@query(
    "e12_reuse_profile",
    f"""{WITH_T}, a AS (SELECT trace_id, idx, generate_subscripts(list_concat(read_addrs, write_addrs), 1) AS pos,
        unnest(list_concat(read_addrs, write_addrs)) >> 6 AS line FROM t),
      q AS (SELECT *, idx - lag(idx) OVER (PARTITION BY trace_id, line ORDER BY idx, pos) AS gap FROM a)
      SELECT trace_id, count(*) AS n_accesses, count(*) FILTER (gap IS NULL) AS n_lines,
      round(count(*) FILTER (gap IS NULL) / count(*)::DOUBLE, 6) AS first_touch_share,
      {', '.join(f"round(count(*) FILTER (gap <= {c}) / count(*)::DOUBLE, 6) AS reuse_within_{c}" for c in (1, 16, 256, 4096))}
      FROM q GROUP BY ALL""",
)
def _(spark, sf_dir):
    return rounded(windows.reuse_profile(b.trace(spark, sf_dir)))


@query(
    "e13_outcome_predictability",
    f"""{WITH_T}, c AS (SELECT trace_id, idx, ip, taken, lag(taken) OVER (PARTITION BY trace_id, ip ORDER BY idx) AS prev FROM t WHERE branch_type = 'direct_conditional'),
      q AS (SELECT t.trace_id, t.ip, t.taken, t.branch_type = 'direct_conditional' AS cond, c.prev FROM t LEFT JOIN c USING (trace_id, idx) WHERE t.branch_type IS NOT NULL)
      SELECT trace_id, ip, count(*) AS n_branches, round(avg(taken::INT), 6) AS taken_share,
        round(least(count(*) FILTER (cond AND taken), count(*) FILTER (cond AND NOT taken)) / count(*)::DOUBLE, 6) AS majority_miss_rate,
        round(count(*) FILTER (cond AND prev <> taken) / count(*)::DOUBLE, 6) AS previous_miss_rate FROM q GROUP BY ALL""",
)
def _(spark, sf_dir):
    return rounded(windows.outcome_predictability(b.trace(spark, sf_dir)))


_LAT = program.CACHE_SUMMARY
SUMMARY_SQL = """cs AS (SELECT trace_id, l1i_kb, l1d_kb, l2_kb, avg(fetch_lat) AS fetch_mean, avg(exec_lat) AS exec_mean,
  quantile_cont(fetch_lat, 0.5) AS fetch_p50, quantile_cont(fetch_lat, 0.75) AS fetch_p75, quantile_cont(fetch_lat, 0.95) AS fetch_p95,
  quantile_cont(exec_lat, 0.5) AS exec_p50, quantile_cont(exec_lat, 0.75) AS exec_p75, quantile_cont(exec_lat, 0.95) AS exec_p95 FROM l GROUP BY ALL)"""


@query("d12_latency_summary", f"WITH {b.L_SQL}, {SUMMARY_SQL} SELECT trace_id, l1i_kb, l1d_kb, l2_kb, {_round_all(_LAT)} FROM cs")
def _(spark, sf_dir):
    return rounded(program.latency_summary(b.latency(spark, sf_dir)))


@query(
    "c20_attach_latency",
    f"""{WITH_T}, lt AS (SELECT t.trace_id, t.idx, t.ip, c.l1i_kb, c.l1d_kb, c.l2_kb, 2 + (t.idx * 7 + t.ip) % c.l1i_kb AS fetch_lat,
        3 + (t.idx * 5 + t.ip) % c.l1d_kb AS exec_lat FROM t CROSS JOIN (SELECT 16 AS l1i_kb, 16 AS l1d_kb, 512 AS l2_kb UNION ALL SELECT 32, 64, 1024 UNION ALL SELECT 256, 128, 4096) c)
      SELECT * FROM lt""",
)
def _(spark, sf_dir):
    t = b.trace(spark, sf_dir).select("trace_id", "idx", "ip")
    configs = F.array(*[F.struct(F.lit(x).alias("l1i_kb"), F.lit(y).alias("l1d_kb"), F.lit(z).alias("l2_kb")) for x, y, z in b.CACHE_CONFIGS])
    c = t.withColumn("c", F.explode(configs))
    lat = c.select(
        "trace_id", "idx", "c.l1i_kb", "c.l1d_kb", "c.l2_kb",
        (F.lit(2) + (F.col("idx") * 7 + F.col("ip")) % F.col("c.l1i_kb")).alias("fetch_lat"),
        (F.lit(3) + (F.col("idx") * 5 + F.col("ip")) % F.col("c.l1d_kb")).alias("exec_lat"),
    )
    return program.attach_latency(t, lat)


@query(
    "b5_fu_group",
    f"""{WITH_T} SELECT trace_id, idx, CASE op_class WHEN 'MemRead' THEN 'read_port' WHEN 'MemWrite' THEN 'rdwr_port' WHEN 'FloatMult' THEN 'fp_mult_div' ELSE 'int_alu' END AS fu_group,
      CASE op_class WHEN 'FloatMult' THEN 4 ELSE 1 END AS op_latency FROM t""",
)
def _(spark, sf_dir):
    t = b.trace(spark, sf_dir)
    return t.select("trace_id", "idx", opclass.fu_group("op_class").alias("fu_group"), opclass.op_latency("op_class").alias("op_latency"))


@query(
    "b7_opcode_flags",
    f"""{WITH_T}, o AS (SELECT *, CASE op_class WHEN 'MemRead' THEN 'MOVNTDQA' WHEN 'MemWrite' THEN 'PUSH' WHEN 'FloatMult' THEN 'MULPD' ELSE 'IMUL' END AS opcode FROM t)
      SELECT trace_id, idx, opcode, op_class = 'MemWrite' AS is_alu, op_class = 'IntAlu' AS is_mult_div, op_class = 'MemRead' AS is_simd,
      false AS is_fp, op_class = 'FloatMult' AS is_fp_mult_div FROM o""",
)
def _(spark, sf_dir):
    t = b.trace(spark, sf_dir)
    op = F.when(F.col("op_class") == "MemRead", "MOVNTDQA").when(F.col("op_class") == "MemWrite", "PUSH").when(F.col("op_class") == "FloatMult", "MULPD").otherwise("IMUL")
    masks = spark.createDataFrame([("MOVNTDQA", 0x14), ("PUSH", 0x21), ("MULPD", 0x40), ("IMUL", 0x02)], "opcode string, mask int")
    flagged = windows.instruction_flags(t.withColumn("opcode", op), masks)
    return flagged.select("trace_id", "idx", "opcode", "is_alu", "is_mult_div", "is_simd", "is_fp", "is_fp_mult_div")


@query(
    "b8_instr_flags",
    f"""{WITH_T} SELECT trace_id, idx, len(read_addrs) > 0 AS is_load, len(write_addrs) > 0 AS is_store, read_addrs[1] AS load_addr,
      write_addrs[1] AS store_addr, inst_sync AS is_isb FROM t""",
)
def _(spark, sf_dir):
    t = windows.instruction_flags(b.trace(spark, sf_dir))
    return t.select("trace_id", "idx", "is_load", "is_store", "load_addr", "store_addr", F.col("inst_sync").alias("is_isb"))


# Text fields of a trace file, rebuilt from the events, and parsed again.


def _text(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events")
    hexa = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    return ev.select(
        "event_id",
        F.concat(hexa(F.col("event_id") * 64 + 4096), F.lit("(8); "), hexa(F.col("event_id"))).alias("addrs"),
        F.concat(F.lit(" r"), F.col("user_id").cast("string"), F.lit(" ;;f"), (F.col("event_id") % 16).cast("string")).alias("regs"),
        F.when(F.col("event_type") == "error", "True").otherwise("false").alias("flag"),
        F.when(F.col("event_type") == "error", " indirect ").when(F.col("event_type") == "view", "direct_conditional").otherwise("").alias("branch"),
    )


@query("b1_parse_addr_list", "SELECT event_id, event_id * 64 + 4096 AS a0, event_id AS a1, 8 AS size0, 0 AS size1 FROM events")
def _(spark, sf_dir):
    x = _text(spark, sf_dir)
    a, m = scalars.parse_addr_list("addrs"), scalars.parse_mem_access_list("addrs")
    return x.select("event_id", F.get(a, F.lit(0)).alias("a0"), F.get(a, F.lit(1)).alias("a1"), F.get(m, F.lit(0))["size"].alias("size0"), F.get(m, F.lit(1))["size"].alias("size1"))


@query("b2_parse_name_list", "SELECT event_id, 2 AS n, 'r' || CAST(user_id AS VARCHAR) AS first_reg, 'f' || CAST(event_id % 16 AS VARCHAR) AS second_reg FROM events")
def _(spark, sf_dir):
    r = scalars.parse_name_list("regs")
    return _text(spark, sf_dir).select("event_id", F.size(r).alias("n"), F.get(r, F.lit(0)).alias("first_reg"), F.get(r, F.lit(1)).alias("second_reg"))


@query("b3_parse_bool", "SELECT event_id, event_type = 'error' AS flag FROM events")
def _(spark, sf_dir):
    return _text(spark, sf_dir).select("event_id", scalars.parse_bool("flag").alias("flag"))


@query(
    "b4_branch_type",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'indirect' WHEN 'view' THEN 'direct_conditional' END AS branch_type,
      event_type = 'error' AS taken FROM events""",
)
def _(spark, sf_dir):
    x = _text(spark, sf_dir).withColumn("branch_type", scalars.parse_branch_type("branch"))
    return x.select("event_id", "branch_type", scalars.branch_taken("branch_type", "flag").alias("taken"))
