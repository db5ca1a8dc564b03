"""Queries over sweep rows: mapping, joins, preparation, error reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import scalars
from tracemill.functions.registry import REGISTRY
from tracemill.operators import metrics, similarity, sweeps
from tracemill.plans import bindings as b
from tracemill.plans.catalog import query, rounded

WITH_S = f"WITH {b.S_SQL}"
WITH_C = f"WITH {b.C_SQL}"
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(KEY)


def kb(c: str) -> str:
    return f"CASE WHEN {c} LIKE '%MiB' THEN CAST(replace({c}, 'MiB', '') AS BIGINT) * 1024 ELSE CAST(replace({c}, 'KiB', '') AS BIGINT) END"


@query("b9_parse_size", f"{WITH_S} SELECT {KEYS}, {kb('l1d_size')} AS l1d_kb, {kb('l2_size')} AS l2_kb, ({kb('l2_size')}) * 1024 AS l2_bytes FROM s")
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    return s.select(*KEY, scalars.parse_size("l1d_size").alias("l1d_kb"), scalars.parse_size("l2_size").alias("l2_kb"), scalars.parse_size("l2_size", "bytes").alias("l2_bytes"))


@query("b10_encode_predictor", f"{WITH_S} SELECT {KEYS}, CASE branch_predictor WHEN 'local' THEN 0 ELSE 1 END AS bp FROM s")
def _(spark, sf_dir):
    return b.sweep(spark, sf_dir).select(*KEY, scalars.encode_predictor("branch_predictor").alias("bp"))


CONFIG_SQL = f"""cf AS (SELECT cid, l_orderkey, l_linenumber, rob_size, commit_width, lq_entries AS load_queue_size, sq_entries AS store_queue_size,
  int_reg_issue_width AS alu_issue_width, int_mult_div_issue_width AS alu_mult_div_issue_width, fp_reg_issue_width AS fp_issue_width,
  fp_mult_div_issue_width, rdwr_port_issue_width + read_port_issue_width AS ls_issue_width, rdwr_port_issue_width AS num_ls_pipes,
  read_port_issue_width AS num_load_pipes, fetch_width, decode_width, rename_width, max_icache_fills,
  CASE branch_predictor WHEN 'local' THEN 0 ELSE 1 END AS branch_predictor, 0.05E0 AS misprediction_percent,
  CAST({kb('l1d_size')} AS INT) AS l1d_cache_kb, CAST({kb('l1i_size')} AS INT) AS l1i_cache_kb, CAST({kb('l2_size')} AS INT) AS l2_cache_kb,
  stride_prefetcher_degree AS l1d_stride_prefetch FROM c)"""
_PARAMS = [p.name for p in REGISTRY.enabled_params()]


@query("b11_to_config", f"{WITH_C}, {CONFIG_SQL} SELECT cid, {', '.join(_PARAMS)} FROM cf")
def _(spark, sf_dir):
    return sweeps.to_config(b.configs(spark, sf_dir), keep=["cid"])


@query(
    "b12_config_features",
    f"""{WITH_C}, {CONFIG_SQL} SELECT cid, {', '.join(_PARAMS)}, CAST(branch_predictor = 0 AS INT) AS bp_is_simple, CAST(branch_predictor = 1 AS INT) AS bp_is_tage,
      CAST(l1d_stride_prefetch = 0 AS INT) AS prefetcher_off, CAST(l1d_stride_prefetch <> 0 AS INT) AS prefetcher_on FROM cf""",
)
def _(spark, sf_dir):
    return sweeps.config_features(sweeps.to_config(b.configs(spark, sf_dir), keep=["cid"]), keep=["cid"])


_PREPARED = f"""CAST(rob_size AS DOUBLE) AS rob_size, CAST(lq_entries AS DOUBLE) AS lq_entries, CAST(commit_width AS DOUBLE) AS commit_width,
  CAST(({kb('l1d_size')}) * 1024 AS DOUBLE) AS l1d_size, CAST(({kb('l2_size')}) * 1024 AS DOUBLE) AS l2_size"""
_HOT = """CAST(stride_prefetcher_degree = 0 AS INT)::DOUBLE AS stride_prefetcher_degree_0, CAST(stride_prefetcher_degree = 4 AS INT)::DOUBLE AS stride_prefetcher_degree_4"""


@query(
    "b13_prepare_features",
    f"""{WITH_S} SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_partkey AS DOUBLE) AS l_partkey,
      CAST(l_suppkey AS DOUBLE) AS l_suppkey, {_PREPARED}, {_HOT}, round(1.0E0 / lq_entries, 6) AS reciprocal_lq_entries, round(1.0E0 / rob_size, 6) AS reciprocal_rob_size FROM s""",
)
def _(spark, sf_dir):
    return rounded(sweeps.prepare_features(b.sweep(spark, sf_dir), drop=["predicted_cpi", "ship"]))


BENCHMARKS = [f"b{i}" for i in range(9)]


@query(
    "b14_prepare_onehot",
    f"""{WITH_S} SELECT CAST(rob_size AS DOUBLE) AS rob_size, CAST(lq_entries AS DOUBLE) AS lq_entries, CAST(commit_width AS DOUBLE) AS commit_width,
      CAST({kb('l1d_size')} AS DOUBLE) AS l1d_size, CAST({kb('l2_size')} AS DOUBLE) AS l2_size,
      {', '.join(f"CAST(benchmark = '{x}' AS INT)::DOUBLE AS benchmark_{x}" for x in BENCHMARKS)},
      CAST(branch_predictor = 'local' AS INT)::DOUBLE AS branch_predictor_local, CAST(branch_predictor = 'tage' AS INT)::DOUBLE AS branch_predictor_tage, {_HOT} FROM s""",
)
def _(spark, sf_dir):
    return sweeps.prepare_features_onehot(b.sweep(spark, sf_dir), BENCHMARKS, drop=["region", "predicted_cpi", "ship", *KEY])[0]


# Dimensions aggregated from the sweep itself: program features, cache rows, predictor rates.
DIMS_SQL = """pr AS (SELECT benchmark, avg(rob_size) AS mean_rob, avg(lq_entries) AS mean_lq, avg(commit_width) AS frac_simd FROM s GROUP BY ALL),
  si AS (SELECT *, l1d_size AS l1i_size FROM s),
  ca AS (SELECT benchmark, l1d_size, l2_size, avg(cpi) AS exec_mean, max(cpi) AS exec_p95, min(cpi) AS fetch_mean FROM s GROUP BY ALL),
  ra AS (SELECT benchmark, branch_predictor, avg(cpi) / 100.0E0 AS misprediction_rate FROM s GROUP BY ALL)"""


def dims(spark, sf_dir):
    s = b.sweep(spark, sf_dir).withColumn("l1i_size", F.col("l1d_size"))
    prog = s.groupBy("benchmark").agg(F.avg("rob_size").alias("mean_rob"), F.avg("lq_entries").alias("mean_lq"), F.avg("commit_width").alias("frac_simd"))
    cache = s.groupBy("benchmark", "l1d_size", "l2_size").agg(F.avg("cpi").alias("exec_mean"), F.max("cpi").alias("exec_p95"), F.min("cpi").alias("fetch_mean"))
    cache = cache.select(
        "benchmark", scalars.parse_size("l1d_size").alias("l1i_kb"), scalars.parse_size("l1d_size").alias("l1d_kb"),
        scalars.parse_size("l2_size").alias("l2_kb"), "exec_mean", "exec_p95", "fetch_mean",
    )
    rates = s.groupBy("benchmark", F.col("branch_predictor").alias("bp_type")).agg((F.avg("cpi") / 100.0).alias("misprediction_rate"))
    return s, prog, cache, rates


@query("c1_join_program", f"{WITH_S}, {DIMS_SQL} SELECT {KEYS}, lq_entries, ship, round(mean_rob, 6) AS prog_mean_rob, round(mean_lq, 6) AS prog_mean_lq FROM s JOIN pr USING (benchmark)")
def _(spark, sf_dir):
    s, prog, _, _ = dims(spark, sf_dir)
    return rounded(sweeps.join_program(s, prog).select(*KEY, "lq_entries", "ship", "prog_mean_rob", "prog_mean_lq"))


@query("c2_join_cache", f"{WITH_S}, {DIMS_SQL} SELECT {KEYS}, lq_entries, ship, round(exec_mean, 6) AS cache_exec_mean, round(exec_p95, 6) AS cache_exec_p95 FROM s JOIN ca USING (benchmark, l1d_size, l2_size)")
def _(spark, sf_dir):
    s, _, cache, _ = dims(spark, sf_dir)
    return rounded(sweeps.join_cache(s, cache).select(*KEY, "lq_entries", "ship", "cache_exec_mean", "cache_exec_p95"))


@query("c3_join_predictor_rate", f"{WITH_S}, {DIMS_SQL} SELECT {KEYS}, lq_entries, ship, round(misprediction_rate, 6) AS misprediction_rate FROM s JOIN ra USING (benchmark, branch_predictor)")
def _(spark, sf_dir):
    s, _, _, rates = dims(spark, sf_dir)
    return rounded(sweeps.join_predictor_rate(s, rates).select(*KEY, "lq_entries", "ship", "misprediction_rate"))


@query(
    "c3_predictor_rate_default",
    f"""{WITH_S}, {DIMS_SQL} SELECT {KEYS}, lq_entries, ship, round(coalesce(misprediction_rate, 0.05E0), 6) AS misprediction_percent
      FROM s LEFT JOIN (SELECT * FROM ra WHERE branch_predictor = 'tage') USING (benchmark, branch_predictor)""",
)
def _(spark, sf_dir):
    s, _, _, rates = dims(spark, sf_dir)
    out = sweeps.join_predictor_rate(s, rates.filter(F.col("bp_type") == "tage"), "misprediction_percent", default=0.05)
    return rounded(out.select(*KEY, "lq_entries", "ship", "misprediction_percent"))


_TRAIN = "benchmark, region, rob_size, lq_entries, commit_width, l1d_size, l2_size, branch_predictor, stride_prefetcher_degree"


@query(
    "c4_build_training",
    f"""{WITH_S}, {DIMS_SQL} SELECT {_TRAIN}, round(cpi, 6) AS cpi, {KEYS}, ship, l1i_size, round(misprediction_rate, 6) AS misprediction_rate,
      round(frac_simd, 6) AS prog_frac_simd, round(mean_lq, 6) AS prog_mean_lq, round(mean_rob, 6) AS prog_mean_rob,
      round(exec_mean, 6) AS cache_exec_mean, round(exec_p95, 6) AS cache_exec_p95, round(fetch_mean, 6) AS cache_fetch_mean
      FROM si JOIN pr USING (benchmark) JOIN ca USING (benchmark, l1d_size, l2_size) JOIN ra USING (benchmark, branch_predictor)""",
)
def _(spark, sf_dir):
    s, prog, cache, rates = dims(spark, sf_dir)
    return rounded(sweeps.build_training(s.drop("predicted_cpi"), prog, cache, rates))


@query("d13_rate_summary", f"{WITH_S}, {DIMS_SQL} SELECT benchmark, branch_predictor AS bp_type, round(misprediction_rate, 6) AS misprediction_rate FROM ra")
def _(spark, sf_dir):
    from tracemill.operators.program import rate_summary
    return rounded(rate_summary(dims(spark, sf_dir)[3]))


@query(
    "b15_drop_feature_group",
    f"""{WITH_S}, {DIMS_SQL} SELECT benchmark, {KEYS}, ship, lq_entries, round(mean_rob, 6) AS prog_mean_rob, round(mean_lq, 6) AS prog_mean_lq,
      round(exec_mean, 6) AS cache_exec_mean FROM s JOIN pr USING (benchmark) JOIN ca USING (benchmark, l1d_size, l2_size)""",
)
def _(spark, sf_dir):
    s, prog, cache, _ = dims(spark, sf_dir)
    wide = sweeps.join_cache(sweeps.join_program(s.select("benchmark", *KEY, "ship", "lq_entries", "l1i_size", "l1d_size", "l2_size"), prog), cache)
    kept = sweeps.drop_feature_group(wide, ["cache_cdf_features", "stale_features"])
    return rounded(kept.drop("l1i_size", "l1d_size", "l2_size", "cache_fetch_mean"))


@query("b15_drop_all_features", f"""{WITH_S} SELECT {KEYS}, ship, lq_entries, {', '.join(f"CAST(benchmark = '{x}' AS INT)::DOUBLE AS benchmark_{x}" for x in BENCHMARKS)} FROM s""")
def _(spark, sf_dir):
    s, prog, _, _ = dims(spark, sf_dir)
    wide = sweeps.join_program(s.select("benchmark", *KEY, "ship", "lq_entries"), prog)
    return sweeps.drop_feature_group(wide, ["all_features"], BENCHMARKS).drop("benchmark")


@query("b19_whitelist", f"{WITH_S} SELECT {KEYS}, ship, lq_entries, benchmark FROM s WHERE benchmark IN ('b1', 'b2', 'b3', 'b7')")
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    names = sweeps.expand_tokens("low, b7, low_except_ood", {"low": ["b1", "b2", "b3"]}, ood="b2")
    return sweeps.whitelist(s, names, known=s).select(*KEY, "ship", "lq_entries", "benchmark")


@query("b19_drop_benchmarks", f"{WITH_S} SELECT {KEYS}, ship, lq_entries, benchmark FROM s WHERE benchmark NOT IN ('b0', 'b8')")
def _(spark, sf_dir):
    return sweeps.drop_benchmarks(b.sweep(spark, sf_dir), ["b0", "b8"]).select(*KEY, "ship", "lq_entries", "benchmark")


@query(
    "b20_config_key",
    f"""{WITH_S} SELECT DISTINCT {', '.join(b.SWEEP_CONFIG)}, substr(md5(concat_ws('_', 'branch_predictor' || branch_predictor, 'commit_width' || CAST(commit_width AS VARCHAR),
      'l1d_size' || l1d_size, 'l2_size' || l2_size, 'lq_entries' || CAST(lq_entries AS VARCHAR), 'rob_size' || CAST(rob_size AS VARCHAR),
      'stride_prefetcher_degree' || CAST(stride_prefetcher_degree AS VARCHAR))), 1, 12) AS config_key FROM s""",
)
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir).select(*b.SWEEP_CONFIG).distinct()
    return s.withColumn("config_key", scalars.config_key(b.SWEEP_CONFIG))


_TRACES = "tr AS (SELECT DISTINCT 'b' || CAST(user_id % 8 AS VARCHAR) AS benchmark FROM events)"


@query("b21_require_traces", f"{WITH_S}, {_TRACES} SELECT {KEYS}, ship, lq_entries, benchmark FROM s SEMI JOIN tr USING (benchmark)")
def _(spark, sf_dir):
    return _required(spark, sf_dir)[0].select(*KEY, "ship", "lq_entries", "benchmark")


@query("b21_missing_traces", f"{WITH_S}, {_TRACES} SELECT benchmark, count(*) AS n_rows FROM s ANTI JOIN tr USING (benchmark) GROUP BY ALL")
def _(spark, sf_dir):
    return _required(spark, sf_dir)[1]


def _required(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events")
    traces = ev.select(F.concat(F.lit("b"), (F.col("user_id") % 8).cast("string")).alias("benchmark"))
    return sweeps.require_traces(b.sweep(spark, sf_dir), traces, ["benchmark"])


@query(
    "b22_coerce_feature_map",
    """SELECT event_id, 'k' AS feature, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS v FROM events WHERE event_id % 3 = 0
      UNION ALL SELECT event_id, 'value', value FROM events WHERE event_id % 3 = 1
      UNION ALL SELECT event_id, f, CASE f WHEN 'f0' THEN value ELSE user_id END FROM events, (VALUES ('f0'), ('f1')) x(f) WHERE event_id % 3 = 2""",
)
def _(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events")
    value, user = F.col("value").cast("string"), F.col("user_id").cast("string")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.col("props"))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"features": {"value": '), value, F.lit("}}")))
        .otherwise(F.concat(F.lit("["), value, F.lit(", "), user, F.lit("]")))
    )
    out = sweeps.coerce_feature_map(ev.withColumn("j", text), "j")
    return out.select("event_id", F.explode("features").alias("feature", "v"))


@query(
    "d33_common_features",
    """WITH f AS (SELECT user_id % 8 AS benchmark, 'k' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20 AS VARCHAR) AS feature FROM events WHERE event_type <> 'error' OR user_id % 8 <> 3
        UNION ALL SELECT user_id % 8, event_type FROM events)
      SELECT feature FROM f GROUP BY feature HAVING count(DISTINCT benchmark) = (SELECT count(DISTINCT benchmark) FROM f)""",
)
def _(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events").withColumn("benchmark", F.col("user_id") % 8)
    k = F.concat(F.lit("k"), (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 20).cast("string"))
    first = F.when((F.col("event_type") != "error") | (F.col("benchmark") != 3), k).otherwise(F.col("event_type"))
    maps = ev.withColumn("features", F.map_from_entries(F.array_distinct(F.array(F.struct(first.alias("k"), F.lit(1.0).alias("v")), F.struct(F.col("event_type").alias("k"), F.lit(1.0).alias("v"))))))
    return sweeps.common_features(maps)


@query("b23_percent_error", f"{WITH_S} SELECT {KEYS}, ship, lq_entries, round(abs(predicted_cpi - cpi) / (abs(cpi) + 1e-8) * 100.0E0, 6) AS percent_error FROM s")
def _(spark, sf_dir):
    return rounded(b.sweep(spark, sf_dir).select(*KEY, "ship", "lq_entries", scalars.percent_error("predicted_cpi", "cpi").alias("percent_error")))


@query("b24_validated", f"{WITH_S} SELECT {KEYS}, ship, lq_entries, rob_size FROM s")
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    scalars.require_columns(s, b.SWEEP_CONFIG, "sweep")
    checks = {"rob_size in range": F.col("rob_size").between(1, 1024), "predictor known": F.col("branch_predictor").isin("local", "tage")}
    return sweeps.validated(s, checks).select(*KEY, "ship", "lq_entries", "rob_size")


# C6: every trace lists the distinct cache configurations of its own rows as JSON.
CACHE_JSON_SQL = f"""cx AS (SELECT DISTINCT l_linenumber % 4 AS trace_id, l1i_cache_kb, l1d_cache_kb, l2_cache_kb FROM cf),
  ci AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY l1i_cache_kb, l1d_cache_kb, l2_cache_kb) - 1 AS cfg_idx FROM cx)"""


@query(
    "c6_cache_config_idx",
    f"""{WITH_C}, {CONFIG_SQL}, {CACHE_JSON_SQL} SELECT cf.cid, ci.trace_id, CAST(ci.cfg_idx AS INT) AS cfg_idx FROM cf JOIN ci ON cf.l_linenumber % 4 = ci.trace_id
      AND cf.l1i_cache_kb = ci.l1i_cache_kb AND cf.l1d_cache_kb = ci.l1d_cache_kb AND cf.l2_cache_kb = ci.l2_cache_kb""",
)
def _(spark, sf_dir):
    raw = b.configs(spark, sf_dir)
    cfg = sweeps.to_config(raw, keep=["cid", "l_linenumber"]).withColumn("trace_id", F.col("l_linenumber") % 4)
    triple = F.array("l1i_cache_kb", "l1d_cache_kb", "l2_cache_kb")
    listed = cfg.groupBy("trace_id").agg(F.array_sort(F.collect_set(triple)).alias("configs"))
    listed = listed.select("trace_id", F.to_json(F.struct("configs")).alias("configs_json"))
    return sweeps.cache_config_idx(cfg, listed).select("cid", "trace_id", "cfg_idx")


_ON = ", ".join(b.SWEEP_CONFIG)


@query(
    "c7_join_cpi",
    f"""{WITH_S}, res AS (SELECT benchmark, {_ON}, arg_max(cpi, (l_orderkey, l_linenumber, l_partkey, l_suppkey, ship)) AS cpi FROM s WHERE region < 40 GROUP BY ALL)
      SELECT {KEYS}, ship, s.lq_entries, round(res.cpi, 6) AS cpi FROM s JOIN res USING (benchmark, {_ON})""",
)
def _(spark, sf_dir):
    return rounded(_cpi(spark, sf_dir)[0].select(*KEY, "ship", "lq_entries", "cpi"))


@query(
    "c7_missing_cpi",
    f"""{WITH_S}, res AS (SELECT DISTINCT benchmark, {_ON} FROM s WHERE region < 40) SELECT count(*) AS n_missing FROM s ANTI JOIN res USING (benchmark, {_ON})""",
)
def _(spark, sf_dir):
    return _cpi(spark, sf_dir)[1]


def _cpi(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    results = s.filter(F.col("region") < 40).withColumn("file_order", F.struct(*KEY, "ship"))
    return sweeps.join_cpi(s.drop("cpi"), results, ["benchmark", *b.SWEEP_CONFIG], "l_orderkey", "file_order")


@query("c12_pick_rows", """SELECT row_id, pick_order, o_custkey FROM (SELECT o_orderkey + 1 AS row_id, o_custkey FROM orders)
  JOIN (SELECT DISTINCT l_orderkey + 1 AS row_id, l_orderkey AS pick_order FROM lineitem) USING (row_id)""")
def _(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("row_id"), "o_custkey")
    lines = b.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("row_"), (F.col("l_orderkey") + 1).cast("string")).alias("value")).distinct()
    ids = sweeps.parse_row_ids(lines).withColumn("pick_order", F.col("row_id") - 1)
    return sweeps.pick_rows(orders, ids)


_HELD = f"h AS (SELECT DISTINCT {_ON} FROM s WHERE region < 10)"


@query("c13_semi_configs", f"{WITH_S}, {_HELD} SELECT {KEYS}, ship, lq_entries FROM s SEMI JOIN h USING ({_ON})")
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    return sweeps.semi_configs(s, s.filter(F.col("region") < 10), b.SWEEP_CONFIG).select(*KEY, "ship", "lq_entries")


@query("c13_anti_configs", f"{WITH_S}, {_HELD} SELECT {KEYS}, ship, lq_entries FROM s ANTI JOIN h USING ({_ON})")
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    return sweeps.anti_configs(s, s.filter(F.col("region") < 10), b.SWEEP_CONFIG).select(*KEY, "ship", "lq_entries")


# ---------------------------------------------------------------- reports

_PE = "abs(predicted_cpi - cpi) / (abs(cpi) + 1e-8) * 100.0E0"
_REPORT = ["commit_width", "branch_predictor", "l1d_size"]


@query(
    "d21_error_report",
    f"""{WITH_S}, u AS (SELECT benchmark, {_PE} AS e, 'overall' AS param, '' AS value FROM s
        {' '.join(f"UNION ALL SELECT benchmark, {_PE}, '{p}', CAST({p} AS VARCHAR) FROM s" for p in _REPORT)})
      SELECT param, value, benchmark, round(avg(e), 6) AS percent_error, count(*) AS n, round(100.0E0 - avg(e), 6) AS accuracy
      FROM u GROUP BY GROUPING SETS ((param, value), (param, value, benchmark))""",
)
def _(spark, sf_dir):
    return rounded(metrics.error_report(b.sweep(spark, sf_dir), _REPORT))


@query(
    "d22_variance_decomposition",
    f"""{WITH_S}, g AS (SELECT benchmark, count(*) AS n, avg(cpi) AS m, var_pop(cpi) * count(*) AS ss FROM s GROUP BY ALL),
      x AS (SELECT count(*) AS n, var_pop(cpi) * count(*) AS ss_total, (SELECT sum(ss) FROM g) AS ss_within FROM s)
      SELECT n, round(ss_total, 3) AS ss_total, round(ss_within, 3) AS ss_within, round(ss_total - ss_within, 3) AS ss_between,
      round((ss_total - ss_within) / ss_total, 6) AS between_share, round(ss_within / ss_total, 6) AS within_share FROM x""",
)
def _(spark, sf_dir):
    v = metrics.variance_decomposition(b.sweep(spark, sf_dir))
    digits = {"between_share": 6, "within_share": 6}
    return v.select("n", *[F.round(c, digits.get(c, 3)).alias(c) for c in v.columns if c != "n"])


@query("d23_ols_r2", f"{WITH_S} SELECT round(regr_r2(cpi, CAST(lq_entries AS DOUBLE)), 6) AS r2 FROM s")
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    r2 = metrics.ols_r2(s, ["lq_entries"])
    return s.agg(F.round(F.lit(r2), 6).alias("r2"))


@query("d23_r2_by_group", f"{WITH_S} SELECT benchmark, round(regr_r2(cpi, CAST(lq_entries AS DOUBLE)), 6) AS r2, count(*) AS n FROM s GROUP BY ALL")
def _(spark, sf_dir):
    return rounded(metrics.r2_by_group(b.sweep(spark, sf_dir), ["benchmark"], "lq_entries", "cpi"))


# Few parameters, so that many rows differ in exactly one of them.
CURVE_PARAMS = ["lq_entries", "commit_width", "l1d_size", "branch_predictor"]

def _numeric():
    return {
        "l1d_size": scalars.parse_size("l1d_size", "bytes"),
        "branch_predictor": F.when(F.col("branch_predictor") == "tage", F.lit(1.0)).otherwise(F.lit(0.0)),
    }


_VALUE = {"l1d_size": f"({kb('l1d_size')}) * 1024", "branch_predictor": "CASE branch_predictor WHEN 'tage' THEN 1 ELSE 0 END"}


def _others(p: str) -> str:
    return "md5(concat_ws(chr(31), " + ", ".join(f"CAST({o} AS VARCHAR)" for o in CURVE_PARAMS if o != p) + "))"


CURVES_SQL = f"""lg AS ({' UNION ALL '.join(f"SELECT '{p}' AS param, benchmark, {_others(p)} AS others, CAST({_VALUE.get(p, p)} AS DOUBLE) AS value, cpi, (l_orderkey, l_linenumber, l_partkey, l_suppkey, ship) AS o FROM s" for p in CURVE_PARAMS)}),
  gr AS (SELECT param, benchmark, others, count(*) AS n, min(o) AS fo FROM lg GROUP BY ALL HAVING count(*) >= 2),
  ch AS (SELECT param, benchmark, others FROM gr QUALIFY row_number() OVER (PARTITION BY param, benchmark ORDER BY n DESC, fo, others) = 1),
  cu AS (SELECT lg.* FROM lg JOIN ch USING (param, benchmark, others))"""


@query("d24_response_curves", f"{WITH_S}, {CURVES_SQL} SELECT param, benchmark, value, round(cpi, 6) AS cpi FROM cu")
def _(spark, sf_dir):
    c = similarity.response_curves(b.sweep(spark, sf_dir), CURVE_PARAMS, _numeric(), tie_break=[*KEY, "ship"])
    return rounded(c.drop("_o"))


@query(
    "c18_curve_distance",
    f"""{WITH_S}, {CURVES_SQL}, pt AS (SELECT param, benchmark, value, arg_max(cpi, o) AS cpi FROM cu GROUP BY ALL),
      d AS (SELECT x.param, x.benchmark AS a, y.benchmark AS b, sqrt(sum((x.cpi - y.cpi) ** 2)) AS distance FROM pt x JOIN pt y USING (param, value) GROUP BY ALL),
      nm AS (SELECT DISTINCT benchmark FROM s), pa AS (SELECT DISTINCT param FROM pt)
      SELECT pa.param, m.benchmark AS a, k.benchmark AS b, CASE WHEN m.benchmark = k.benchmark THEN 0 ELSE round(distance, 6) END AS distance
      FROM pa, nm m, nm k LEFT JOIN d ON d.param = pa.param AND d.a = m.benchmark AND d.b = k.benchmark""",
)
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    c = similarity.response_curves(s, CURVE_PARAMS, _numeric(), tie_break=[*KEY, "ship"])
    return rounded(similarity.curve_distance(c, s))


@query("d25_config_histogram", f"{WITH_S}, c AS (SELECT {_ON}, count(*) AS n_rows FROM s GROUP BY ALL) SELECT n_rows, count(*) AS n_configs FROM c GROUP BY ALL")
def _(spark, sf_dir):
    return metrics.dataset_profile(b.sweep(spark, sf_dir), b.SWEEP_CONFIG)["config_histogram"]


@query("d25_benchmark_profile", f"{WITH_S} SELECT benchmark, count(DISTINCT region) AS n_regions, CAST(count(*) AS BIGINT) AS n_rows FROM s GROUP BY ALL")
def _(spark, sf_dir):
    return metrics.dataset_profile(b.sweep(spark, sf_dir), b.SWEEP_CONFIG)["benchmarks"]


@query("d25_distinct_configs", f"{WITH_S} SELECT count(*) AS n_configs FROM (SELECT DISTINCT {_ON} FROM s)")
def _(spark, sf_dir):
    return metrics.dataset_profile(b.sweep(spark, sf_dir), b.SWEEP_CONFIG)["configs"]


@query("d26_mean_by_config", f"{WITH_S} SELECT commit_width, l1d_size, branch_predictor, round(avg(cpi), 6) AS cpi FROM s GROUP BY ALL")
def _(spark, sf_dir):
    return rounded(metrics.mean_by_config(b.sweep(spark, sf_dir), ["commit_width", "l1d_size", "branch_predictor"]))


_SCALED = ["rob_size", "lq_entries", "commit_width"]
_FIT = "ft AS (SELECT * FROM s WHERE region < 40)"


@query(
    "d27_minmax_scale",
    f"""{WITH_S}, {_FIT}, st AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in _SCALED)} FROM ft)
      SELECT {KEYS}, ship, {', '.join(f'round(({c} - lo_{c}) / CASE WHEN hi_{c} > lo_{c} THEN hi_{c} - lo_{c} ELSE 1 END::DOUBLE, 6) AS {c}' for c in _SCALED)} FROM s, st""",
)
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    return rounded(metrics.minmax_scale(s.filter(F.col("region") < 40), s, _SCALED).select(*KEY, "ship", *_SCALED))


@query(
    "d28_standard_scale",
    f"""{WITH_S}, {_FIT}, st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}' for c in _SCALED)} FROM ft)
      SELECT {KEYS}, ship, {', '.join(f'round(({c} - m_{c}) / CASE WHEN d_{c} > 0 THEN d_{c} ELSE 1 END, 6) AS {c}' for c in _SCALED)} FROM s, st""",
)
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    return rounded(metrics.standard_scale(s.filter(F.col("region") < 40), s, _SCALED).select(*KEY, "ship", *_SCALED))


@query("i4_predictions_table", f"{WITH_S} SELECT benchmark, region, l_orderkey, l_linenumber, round(cpi, 8) AS actual_cpi, round(predicted_cpi, 8) AS predicted_cpi FROM s")
def _(spark, sf_dir):
    return rounded(metrics.predictions_table(b.sweep(spark, sf_dir), ["benchmark", "region", "l_orderkey", "l_linenumber"]), 8)


@query(
    "c19_compare_runs",
    f"""{WITH_S}, x AS (SELECT benchmark, avg({_PE}) AS e FROM s WHERE region < 25 AND benchmark <> 'b8' GROUP BY ALL), y AS (SELECT benchmark, avg({_PE}) AS e FROM s WHERE region >= 25 AND benchmark <> 'b0' GROUP BY ALL)
      SELECT benchmark, round(coalesce(x.e, 'nan'::DOUBLE), 6) AS a_error, round(coalesce(y.e, 'nan'::DOUBLE), 6) AS b_error FROM x FULL JOIN y USING (benchmark)""",
)
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir).withColumn("e", scalars.percent_error("predicted_cpi", "cpi"))
    mean = lambda df: df.groupBy("benchmark").agg(F.avg("e").alias("percent_error"))
    a = mean(s.filter((F.col("region") < 25) & (F.col("benchmark") != "b8")))
    c = mean(s.filter((F.col("region") >= 25) & (F.col("benchmark") != "b0")))
    return rounded(metrics.compare_runs(a, c))

