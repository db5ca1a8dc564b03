"""Trace, latency, throughput, sweep, point and run tables derived from the given tables.

Each binding exists twice: as a DataFrame plan and as the equivalent SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.ordered import SEGMENT_ROWS, bucketed_rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution trace: one row per event, eight traces."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    ev = ev.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")).withColumn(
        "trace_id", F.col("user_id") % 8
    )
    ev = bucketed_rank(ev, ["trace_id"], F.floor(F.col("event_id") / SEGMENT_ROWS), ["event_id"], "idx")
    none = F.expr("CAST(array() AS ARRAY<BIGINT>)")
    addr = F.array(F.lit(64) * F.floor(F.col("value") * 100))
    ip = lambda e: F.lit(4096) + F.lit(4) * e
    k, is_branch = F.col("k"), F.col("event_type") == "error"
    return ev.select(
        "trace_id",
        F.col("idx").cast("bigint").alias("idx"),
        ip(k).alias("ip"),
        F.when(F.col("event_type") == "view", "MemRead").when(F.col("event_type") == "signup", "MemWrite")
        .when(F.col("event_type") == "purchase", "FloatMult").otherwise("IntAlu").alias("op_class"),
        F.when(~is_branch, F.lit(None).cast("string")).when(k % 3 == 0, "direct_conditional")
        .when(k % 3 == 1, "direct_unconditional").otherwise("indirect").alias("branch_type"),
        (is_branch & (F.floor("value") % 2 == 0)).alias("taken"),
        (k == 0).alias("inst_sync"),
        F.when(F.col("event_type") == "view", addr).otherwise(none).alias("read_addrs"),
        F.when(F.col("event_type") == "signup", addr).otherwise(none).alias("write_addrs"),
        F.when(F.col("event_id") % 4 == 0, none).otherwise(
            F.array(ip((k * 7 + 3) % 100), ip((k + F.col("event_id")) % 100))
        ).alias("reg_deps"),
        F.when(F.col("event_id") % 3 == 0, none).when(F.col("event_id") % 3 == 1, F.array(ip((k + 1) % 100))).otherwise(
            F.array(ip((k + 1) % 100), ip((k + 2) % 100))
        ).alias("mem_deps"),
    )


T_SQL = """t AS (SELECT user_id % 8 AS trace_id,
  CAST(row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS BIGINT) AS idx,
  4096 + 4 * k AS ip,
  CASE event_type WHEN 'view' THEN 'MemRead' WHEN 'signup' THEN 'MemWrite' WHEN 'purchase' THEN 'FloatMult' ELSE 'IntAlu' END AS op_class,
  CASE WHEN event_type <> 'error' THEN NULL WHEN k % 3 = 0 THEN 'direct_conditional' WHEN k % 3 = 1 THEN 'direct_unconditional' ELSE 'indirect' END AS branch_type,
  event_type = 'error' AND CAST(floor(value) AS BIGINT) % 2 = 0 AS taken,
  k = 0 AS inst_sync,
  CASE WHEN event_type = 'view' THEN list_value(64 * CAST(floor(value * 100) AS BIGINT)) ELSE CAST([] AS BIGINT[]) END AS read_addrs,
  CASE WHEN event_type = 'signup' THEN list_value(64 * CAST(floor(value * 100) AS BIGINT)) ELSE CAST([] AS BIGINT[]) END AS write_addrs,
  CASE WHEN event_id % 4 = 0 THEN CAST([] AS BIGINT[]) ELSE list_value(4096 + 4 * ((k * 7 + 3) % 100), 4096 + 4 * ((k + event_id) % 100)) END AS reg_deps,
  CASE event_id % 3 WHEN 0 THEN CAST([] AS BIGINT[]) WHEN 1 THEN list_value(4096 + 4 * ((k + 1) % 100)) ELSE list_value(4096 + 4 * ((k + 1) % 100), 4096 + 4 * ((k + 2) % 100)) END AS mem_deps
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) e)"""

CACHE_CONFIGS = [(16, 16, 512), (32, 64, 1024), (256, 128, 4096)]


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-instruction fetch and execution latencies for three cache configurations."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    configs = F.array(*[
        F.struct(F.lit(a).alias("l1i_kb"), F.lit(b).alias("l1d_kb"), F.lit(c).alias("l2_kb")) for a, b, c in CACHE_CONFIGS
    ])
    e = ev.withColumn("c", F.explode(configs))
    return e.select(
        (F.col("user_id") % 8).alias("trace_id"), "c.l1i_kb", "c.l1d_kb", "c.l2_kb", F.col("event_id").alias("idx"),
        (F.lit(2) + F.floor(F.col("value") * 10) % F.col("c.l1i_kb")).alias("fetch_lat"),
        (F.lit(3) + F.floor(F.col("value") * 100) % F.col("c.l1d_kb")).alias("exec_lat"),
    )


L_SQL = """l AS (SELECT e.user_id % 8 AS trace_id, c.l1i_kb, c.l1d_kb, c.l2_kb, e.event_id AS idx,
  2 + CAST(floor(e.value * 10) AS BIGINT) % c.l1i_kb AS fetch_lat, 3 + CAST(floor(e.value * 100) AS BIGINT) % c.l1d_kb AS exec_lat
FROM events e CROSS JOIN (SELECT 16 AS l1i_kb, 16 AS l1d_kb, 512 AS l2_kb UNION ALL SELECT 32, 64, 1024 UNION ALL SELECT 256, 128, 4096) c)"""


def window_thr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window throughputs with ties, zeros and negatives."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("trace_id"), (F.col("l_linenumber") % 3).alias("resource"),
        (F.col("l_suppkey") % 8 + 1).alias("p0"), F.col("l_orderkey").alias("window_id"),
        (F.col("l_quantity") - F.lit(5.0) * (F.col("l_linenumber") % 2)).alias("thr"),
    )


W_SQL = """w AS (SELECT l_returnflag AS trace_id, l_linenumber % 3 AS resource, l_suppkey % 8 + 1 AS p0, l_orderkey AS window_id,
  l_quantity - 5.0E0 * (l_linenumber % 2) AS thr FROM lineitem)"""

SWEEP_CONFIG = ["rob_size", "lq_entries", "commit_width", "l1d_size", "l2_size", "branch_predictor", "stride_prefetcher_degree"]
SWEEP_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "lq_entries", "ship"]


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulation sweep rows: configuration, measured CPI and a prediction."""
    li = table(spark, sf_dir, "lineitem")
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    cpi = F.col("l_extendedprice") / F.lit(10000.0)
    return li.select(
        F.concat(F.lit("b"), (s % 9).cast("string")).alias("benchmark"), (F.col("l_orderkey") % 50).alias("region"),
        (F.col("l_partkey") % 1024 + 1).alias("rob_size"), F.col("l_quantity").cast("int").alias("lq_entries"),
        (n % 8 + 1).alias("commit_width"),
        F.when(n % 5 == 0, "16KiB").when(n % 5 == 1, "32KiB").when(n % 5 == 2, "64KiB").when(n % 5 == 3, "128KiB").otherwise("256KiB").alias("l1d_size"),
        F.when(s % 4 == 0, "512KiB").when(s % 4 == 1, "1MiB").when(s % 4 == 2, "2MiB").otherwise("4MiB").alias("l2_size"),
        F.when(F.col("l_linestatus") == "O", "local").otherwise("tage").alias("branch_predictor"),
        F.when(F.col("l_returnflag") == "R", 4).otherwise(0).alias("stride_prefetcher_degree"),
        cpi.alias("cpi"), (cpi * (F.lit(1.0) + F.col("l_discount") - F.lit(0.05))).alias("predicted_cpi"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship"),
    )


S_SQL = """s AS (SELECT 'b' || CAST(l_suppkey % 9 AS VARCHAR) AS benchmark, l_orderkey % 50 AS region,
  l_partkey % 1024 + 1 AS rob_size, CAST(l_quantity AS INT) AS lq_entries, l_linenumber % 8 + 1 AS commit_width,
  CASE l_linenumber % 5 WHEN 0 THEN '16KiB' WHEN 1 THEN '32KiB' WHEN 2 THEN '64KiB' WHEN 3 THEN '128KiB' ELSE '256KiB' END AS l1d_size,
  CASE l_suppkey % 4 WHEN 0 THEN '512KiB' WHEN 1 THEN '1MiB' WHEN 2 THEN '2MiB' ELSE '4MiB' END AS l2_size,
  CASE WHEN l_linestatus = 'O' THEN 'local' ELSE 'tage' END AS branch_predictor,
  CASE WHEN l_returnflag = 'R' THEN 4 ELSE 0 END AS stride_prefetcher_degree,
  l_extendedprice / 10000.0E0 AS cpi, l_extendedprice / 10000.0E0 * (1.0E0 + l_discount - 0.05E0) AS predicted_cpi,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS ship FROM lineitem)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two objectives to minimise, with ties."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("pid"), F.col("l_extendedprice").alias("cost"), (F.lit(51.0) - F.col("l_quantity")).alias("cpi"))


P_SQL = "p AS (SELECT l_orderkey AS pid, l_extendedprice AS cost, 51.0E0 - l_quantity AS cpi FROM lineitem)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metrics, one row per epoch."""
    o = table(spark, sf_dir, "orders").withColumn("run_id", F.col("o_custkey") % 20)
    o = bucketed_rank(o, ["run_id"], F.floor(F.col("o_orderkey") / SEGMENT_ROWS), ["o_orderkey"], "pos")
    return o.select(
        "run_id", (F.col("pos") + 1).cast("int").alias("epoch"), F.col("o_totalprice").alias("eval_loss"),
        (F.col("o_totalprice") / F.lit(1000.0)).alias("percent_error"),
    )


R_SQL = """r AS (SELECT o_custkey % 20 AS run_id, CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS INT) AS epoch,
  o_totalprice AS eval_loss, o_totalprice / 1000.0E0 AS percent_error FROM orders)"""

# Full design-space configurations, one per lineitem row: every search parameter
# takes a grid value picked by the row's own columns.
GRID_DIGITS = {
    "int_reg_issue_width": "l_partkey % 8 + 1",
    "int_mult_div_issue_width": "l_suppkey % 8 + 1",
    "fp_reg_issue_width": "l_orderkey % 8 + 1",
    "fp_mult_div_issue_width": "l_linenumber % 8 + 1",
    "read_port_issue_width": "(l_partkey + l_suppkey) % 8 + 1",
    "rdwr_port_issue_width": "(l_orderkey + l_linenumber) % 8 + 1",
    "fetch_width": "l_partkey % 12 + 1",
    "decode_width": "l_suppkey % 12 + 1",
    "rename_width": "l_orderkey % 12 + 1",
    "commit_width": "(l_partkey + l_orderkey) % 12 + 1",
    "rob_size": "l_partkey % 1024 + 1",
    "lq_entries": "l_orderkey % 256 + 1",
    "sq_entries": "l_suppkey % 256 + 1",
    "max_icache_fills": "l_orderkey % 32 + 1",
}


def _grid_select(string: str) -> str:
    parts = [f"CAST({e} AS INT) AS {c}" for c, e in GRID_DIGITS.items()]
    parts += [
        "CASE WHEN l_linestatus = 'O' THEN 'local' ELSE 'tage' END AS branch_predictor",
        "CASE l_linenumber % 5 WHEN 0 THEN '16KiB' WHEN 1 THEN '32KiB' WHEN 2 THEN '64KiB' WHEN 3 THEN '128KiB' ELSE '256KiB' END AS l1d_size",
        "CASE l_partkey % 5 WHEN 0 THEN '16KiB' WHEN 1 THEN '32KiB' WHEN 2 THEN '64KiB' WHEN 3 THEN '128KiB' ELSE '256KiB' END AS l1i_size",
        "CASE l_suppkey % 4 WHEN 0 THEN '512KiB' WHEN 1 THEN '1MiB' WHEN 2 THEN '2MiB' ELSE '4MiB' END AS l2_size",
        "CASE WHEN l_returnflag = 'R' THEN 4 ELSE 0 END AS stride_prefetcher_degree",
        f"CAST(l_orderkey AS {string}) || '-' || CAST(l_linenumber AS {string}) || '-' || CAST(l_partkey AS {string}) || '-' || CAST(l_suppkey AS {string}) AS cid",
        "l_extendedprice / 10000.0E0 AS cpi", "l_orderkey", "l_linenumber",
    ]
    return ", ".join(parts)


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_split_top(_grid_select("STRING")))


def _split_top(text: str) -> list[str]:
    return text.split(", ")


C_SQL = f"c AS (SELECT {_grid_select('VARCHAR')} FROM lineitem)"
