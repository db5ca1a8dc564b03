"""Round trips through files and streams: the given tables are written in a file format and read back.

Files go to a fresh folder below the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.registry import FIXED_PARAMS
from tracemill.operators import design, skyline, windows
from tracemill.operators.program import PROGRAM_FEATURES
from tracemill.plans import bindings as b
from tracemill.plans.catalog import query, rounded
from tracemill.plans.design_queries import GRID, PRICED, VALID_SQL, _FINAL, final
from tracemill.plans.program_queries import (
    BLOCK_SQL, BRANCH_SQL, DELTA_SQL, DEPS_SQL, DEPSTAT_SQL, DIST_SQL, FAN_SQL, HAZARD_SQL, MEMORY_SQL, MIX_SQL, PAGES_SQL, STRIDE_SQL, SYNC_SQL,
)
from tracemill.plans.sweep_queries import DIMS_SQL, KEY, KEYS, WITH_S, dims
from tracemill.plans.trace_queries import K, THR_SQL, WITH_COUNTS
from tracemill.plans.trace_queries import counts as trace_counts
from tracemill.session import scratch_path
from tracemill.sources import arrays
from tracemill.sources import runs as run_files
from tracemill.sources import sweeps as sweep_files
from tracemill.sources import traces as trace_files
from tracemill.streaming import traces as streams

WITH_T = f"WITH {b.T_SQL}"
_LIST = lambda c: f"array_to_string({c}, ';')"


def _written_trace(spark, sf_dir, compression="none"):
    path = scratch_path(spark, "trace")
    trace_files.write_annotated_trace(b.trace(spark, sf_dir), path, compression)
    return path


def _flat(t):
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ";").alias(c)
    return t.select(F.col("trace_id").cast("bigint").alias("trace_id"), "idx", "ip", "op_class", "branch_type", "taken", "inst_sync", *[join(c) for c in ("read_addrs", "write_addrs", "reg_deps", "mem_deps")])


TRACE_OUT = f"SELECT trace_id, idx, ip, op_class, branch_type, taken, inst_sync, {', '.join(f'{_LIST(c)} AS {c}' for c in ('read_addrs', 'write_addrs', 'reg_deps', 'mem_deps'))} FROM t"


@query("a1_read_traces", f"{WITH_T} {TRACE_OUT}")
def _(spark, sf_dir):
    path = _written_trace(spark, sf_dir)
    return _flat(trace_files.read_traces(spark, path + "/trace_id=*/*.csv", trace_files.TRACE_DIR))


@query("a2_read_compressed_traces", f"{WITH_T} {TRACE_OUT}")
def _(spark, sf_dir):
    path = _written_trace(spark, sf_dir, "gzip")
    return _flat(trace_files.read_traces(spark, path + "/trace_id=*/*.csv.gz", trace_files.TRACE_DIR))


@query("a3_count_rows_per_trace", f"{WITH_T} SELECT trace_id, count(*) AS n_rows FROM t GROUP BY ALL")
def _(spark, sf_dir):
    return trace_files.count_rows_per_trace(b.trace(spark, sf_dir))


_HEX = lambda c: f"array_to_string(list_transform({c}, lambda a: '0x' || printf('%x', a)), ';')"


@query(
    "a14_annotated_rows",
    f"""{WITH_T} SELECT trace_id, idx, '0x' || printf('%x', ip) AS "IP", op_class AS "Category", coalesce(branch_type, '') AS "Branch Type",
      CASE WHEN branch_type IS NULL THEN '' ELSE CAST(taken AS VARCHAR) END AS "Branch Taken", CAST(inst_sync AS VARCHAR) AS "Instruction Sync",
      {_HEX('reg_deps')} AS "Register Dependent IPs", {_HEX('read_addrs')} AS "Read Addresses", {_HEX('write_addrs')} AS "Write Addresses", {_HEX('mem_deps')} AS "Memory Dependent IPs" FROM t""",
)
def _(spark, sf_dir):
    names = ["IP", "Category", "Branch Type", "Branch Taken", "Instruction Sync", "Register Dependent IPs", "Read Addresses", "Write Addresses", "Memory Dependent IPs"]
    return trace_files.annotated_rows(b.trace(spark, sf_dir)).select("trace_id", "idx", *names)


SWEEP_OUT = f"SELECT benchmark, region, rob_size, CAST(lq_entries AS BIGINT) AS lq_entries, l1d_size, l2_size, branch_predictor, round(cpi, 6) AS cpi, {KEYS} FROM s"


@query("a4_read_sweep", f"{WITH_S} {SWEEP_OUT.replace('l_linenumber,', 'CAST(l_linenumber AS BIGINT) AS l_linenumber,')}")
def _(spark, sf_dir):
    path = scratch_path(spark, "sweep")
    cols = ["benchmark", "region", "rob_size", "lq_entries", "l1d_size", "l2_size", "branch_predictor", "cpi", *KEY]
    sweep_files.write_features(b.sweep(spark, sf_dir).select(*cols), path, "csv")
    return rounded(sweep_files.read_sweep(spark, path, ["benchmark", "cpi"]))


def _sidecar_root(spark, sf_dir):
    _, prog, cache, rates = dims(spark, sf_dir)
    root = scratch_path(spark, "sidecars")
    # One text file per benchmark and kind, in folders <benchmark>/features/.
    doc = prog.select("benchmark", F.to_json(F.struct("mean_rob", "mean_lq", "frac_simd")).alias("value"))
    lines = cache.select("benchmark", F.concat_ws(",", *[F.col(c).cast("string") for c in ("l1i_kb", "l1d_kb", "l2_kb", "exec_mean", "exec_p95", "fetch_mean")]).alias("v"))
    table = lines.groupBy("benchmark").agg(F.concat(F.lit("l1i_kb,l1d_kb,l2_kb,exec_mean,exec_p95,fetch_mean\n"), F.array_join(F.array_sort(F.collect_list("v")), "\n")).alias("value"))
    rate = rates.groupBy("benchmark").agg(F.concat(F.lit("bp_type,misprediction_rate\n"), F.array_join(F.collect_list(F.concat_ws(",", "bp_type", F.col("misprediction_rate").cast("string"))), "\n")).alias("value"))
    return root, {"prog": doc, "cache": table, "rate": rate}


def _write_sidecars(spark, sf_dir):
    """Small per-benchmark files; the text sink fixes file names, so the kind is the pattern's folder."""
    root, docs = _sidecar_root(spark, sf_dir)
    for kind, df in docs.items():
        df.repartition("benchmark").withColumn("sub", F.lit("x")).write.partitionBy("benchmark", "sub").text(f"{root}/{kind}")
    return root


@query("a5_program_sidecars", f"{WITH_S}, {DIMS_SQL} SELECT benchmark, round(mean_rob, 6) AS mean_rob, round(mean_lq, 6) AS mean_lq, round(frac_simd, 6) AS frac_simd FROM pr")
def _(spark, sf_dir):
    root = _write_sidecars(spark, sf_dir)
    out = sweep_files.feature_columns(sweep_files.program_maps(spark, f"{root}/prog", "*.txt"), ["mean_rob", "mean_lq", "frac_simd"])
    return rounded(out.withColumn("benchmark", F.regexp_replace("benchmark", "^benchmark=", "")))


@query(
    "a5_cache_sidecars",
    f"""{WITH_S}, {DIMS_SQL} SELECT benchmark, CAST(replace(l1d_size, 'KiB', '') AS BIGINT) AS l1d_kb, round(exec_mean, 6) AS exec_mean, round(exec_p95, 6) AS exec_p95 FROM ca""",
)
def _(spark, sf_dir):
    root = _write_sidecars(spark, sf_dir)
    out = sweep_files.read_cache_sidecars(spark, f"{root}/cache", ["exec_mean", "exec_p95"], "*.txt")
    return rounded(out.select(F.regexp_replace("benchmark", "^benchmark=", "").alias("benchmark"), "l1d_kb", "exec_mean", "exec_p95"))


@query("a5_rate_sidecars", f"{WITH_S}, {DIMS_SQL} SELECT benchmark, branch_predictor AS bp_type, round(misprediction_rate, 6) AS misprediction_rate FROM ra")
def _(spark, sf_dir):
    root = _write_sidecars(spark, sf_dir)
    out = sweep_files.read_rate_sidecars(spark, f"{root}/rate", "*.txt")
    return rounded(out.withColumn("benchmark", F.regexp_replace("benchmark", "^benchmark=", "")))


@query(
    "a8_read_run_metrics",
    """SELECT CAST(o_orderkey // 512 AS VARCHAR) AS run_id, CAST(row_number() OVER (PARTITION BY o_orderkey // 512 ORDER BY o_orderkey) AS INT) AS epoch,
      o_totalprice AS eval_loss, round(o_totalprice / 1000.0E0, 6) AS percent_error FROM orders""",
)
def _(spark, sf_dir):
    # A run holds 512 orders by key, so its document is bounded.
    o = b.table(spark, sf_dir, "orders").withColumn("run_id", F.floor(F.col("o_orderkey") / 512))
    epoch = F.struct("o_orderkey", F.lit(1.0).alias("duration"), F.lit(0.0).alias("train_loss"), F.col("o_totalprice").alias("eval_loss"), (F.col("o_totalprice") / F.lit(1000.0)).alias("percent_error"))
    doc = o.groupBy("run_id").agg(F.array_sort(F.collect_list(epoch)).alias("epochs")).select(
        "run_id", F.to_json(F.struct(F.lit(1.0).alias("total_duration"), F.transform("epochs", lambda e: e.dropFields("o_orderkey")).alias("epochs"))).alias("value")
    )
    path = scratch_path(spark, "runs")
    doc.repartition("run_id").write.partitionBy("run_id").text(path)
    out = run_files.read_run_metrics(spark, path + "/run_id=*/*.txt")
    return rounded(out.select(F.regexp_replace("run_id", "^run_id=", "").alias("run_id"), "epoch", "eval_loss", "percent_error"))


@query("a10_write_features", f"{WITH_S} SELECT {KEYS}, ship, lq_entries, round(cpi, 6) AS cpi FROM s")
def _(spark, sf_dir):
    path = scratch_path(spark, "features") + ".json"
    s = b.sweep(spark, sf_dir).select(*KEY, "ship", "lq_entries", "cpi")
    sweep_files.write_features(s, path)
    return rounded(spark.read.schema(s.schema).json(path))


@query("a11_append_training_rows", f"{WITH_S} SELECT benchmark, {KEYS}, ship, lq_entries FROM s")
def _(spark, sf_dir):
    path = scratch_path(spark, "training")
    s = b.sweep(spark, sf_dir).select("benchmark", *KEY, "ship", "lq_entries")
    sweep_files.append_training_rows(s.filter(F.col("l_orderkey") % 2 == 0), path)
    sweep_files.append_training_rows(s.filter(F.col("l_orderkey") % 2 == 1), path)
    return sweep_files.read_training_rows(spark, path).select("benchmark", *KEY, "ship", "lq_entries")


@query("a12_consolidate", f"{WITH_S} SELECT benchmark, CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, ship FROM s")
def _(spark, sf_dir):
    path = scratch_path(spark, "parts")
    s = b.sweep(spark, sf_dir).select("benchmark", "l_orderkey", "l_partkey", "ship")
    s.filter(F.col("l_orderkey") % 2 == 0).write.option("header", True).csv(path + "/a")
    s.filter(F.col("l_orderkey") % 2 == 1).write.option("header", True).csv(path + "/b")
    return sweep_files.consolidate(spark, [path + "/a", path + "/b"])


@query("a13_materialize_matrix", f"{WITH_S} SELECT {KEYS}, ship, 2 AS n_features, round(CAST(CAST(cpi AS FLOAT) AS DOUBLE), 6) AS cpi, round(CAST(CAST(rob_size AS FLOAT) + CAST(lq_entries AS FLOAT) AS DOUBLE), 6) AS total FROM s")
def _(spark, sf_dir):
    path = scratch_path(spark, "matrix")
    out = sweep_files.materialize_matrix(b.sweep(spark, sf_dir), path, f"{sf_dir}/lineitem.parquet", ["rob_size", "lq_entries"], "cpi", [*KEY, "ship"])
    f = F.col("features")
    return rounded(out.select(*KEY, "ship", F.size(f).alias("n_features"), F.col("cpi").cast("double").alias("cpi"), (f[0] + f[1]).cast("double").alias("total")))


@query("a15_skip_done", f"{WITH_S}, d AS (SELECT DISTINCT benchmark, region FROM s WHERE l_linenumber = 1 AND l_suppkey % 4 = 0 AND l_partkey % 8 = 0) SELECT DISTINCT benchmark, region FROM s ANTI JOIN d USING (benchmark, region)")
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    done = s.filter((F.col("l_linenumber") == 1) & (F.col("l_suppkey") % 4 == 0) & (F.col("l_partkey") % 8 == 0))
    return sweep_files.skip_done(s.select("benchmark", "region").distinct(), done, ["benchmark", "region"])


def _report(spark, sf_dir):
    fixed = {p: F.lit(v) for p, v in FIXED_PARAMS.items()}
    front = skyline.flag_validation(final(spark, sf_dir), 4).withColumns(fixed)
    cheapest = b.configs(spark, sf_dir).withColumn("cost", F.round(design.hardware_cost(), 4)).filter(design.is_valid())
    base = skyline.rank_pick(cheapest.withColumn("_all", F.lit(1)), ["_all"], ["cost", "cid"]).withColumns(fixed)
    return run_files.pareto_report(front.select(*GRID, *FIXED_PARAMS, "cpi", "cost", "validation_candidate"), base)


_FLAGGED = f"""WITH {b.C_SQL}, {PRICED}, {_FINAL}, rk AS (SELECT *, row_number() OVER (ORDER BY cost, cpi) - 1 AS pos, count(*) OVER () AS n FROM ff),
  fl AS (SELECT cpi, cost, pos = 0 OR cpi = (SELECT min(cpi) FROM ff) OR (n >= 2 AND pos IN (SELECT CAST(floor(i * (n - 1) / 3) AS BIGINT) FROM range(1, 3) q(i))) AS validation_candidate FROM rk),
  ba AS (SELECT cpi, cost FROM pc WHERE {VALID_SQL} ORDER BY cost, cid LIMIT 1),
  re AS (SELECT 'point' AS kind, * FROM fl UNION ALL SELECT 'baseline', cpi, cost, false FROM ba)"""
_REPORT_OUT = "SELECT kind, round(cpi, 6) AS predicted_cpi, cost AS predicted_cost, validation_candidate FROM re"


@query("a16_pareto_report", f"{_FLAGGED} {_REPORT_OUT}")
def _(spark, sf_dir):
    table = run_files.tradeoff_table(_report(spark, sf_dir))
    return rounded(table.select("kind", "predicted_cpi", "predicted_cost", "validation_candidate"))


@query("a17_read_pareto_report", f"{_FLAGGED} {_REPORT_OUT} WHERE validation_candidate OR kind = 'baseline'")
def _(spark, sf_dir):
    path = scratch_path(spark, "report")
    run_files.write_pareto_report(_report(spark, sf_dir), path)
    return rounded(run_files.read_pareto_report(spark, path).select("kind", "predicted_cpi", "predicted_cost", "validation_candidate"))


def _round_all(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(
    "k1_ingest_traces_stream",
    f"""{WITH_T}, {DEPS_SQL}, {DIST_SQL}, {DEPSTAT_SQL}, {FAN_SQL}, {BLOCK_SQL}, {DELTA_SQL}, {STRIDE_SQL},
      x AS (SELECT trace_id, {MIX_SQL}, {BRANCH_SQL}, {SYNC_SQL}, {MEMORY_SQL}, {HAZARD_SQL}, {PAGES_SQL} FROM t GROUP BY ALL)
      SELECT CAST(trace_id AS VARCHAR) AS trace_id, {_round_all(PROGRAM_FEATURES)} FROM x JOIN ds USING (trace_id) JOIN fo USING (trace_id) JOIN bb USING (trace_id) JOIN sr USING (trace_id)""",
)
def _(spark, sf_dir):
    # One file per trace: a file is the unit of the stream.
    rows = trace_files.annotated_rows(b.trace(spark, sf_dir))
    path, out = scratch_path(spark, "incoming"), scratch_path(spark, "streamed")
    rows.repartition("trace_id").sortWithinPartitions("trace_id", "idx").drop("idx").write.partitionBy("trace_id").options(header=True, emptyValue="").csv(path)
    q = streams.ingest_traces_stream(spark, path, out + "/features", out + "/windows", out + "/failed", out + "/state", K, id_pattern=trace_files.TRACE_DIR)
    q.awaitTermination()
    return rounded(spark.read.parquet(out + "/features").drop("batch"))


@query(
    "k1_ingest_trace_parts",
    f"""{WITH_T}, {DEPS_SQL}, {DIST_SQL}, {DEPSTAT_SQL}, {FAN_SQL}, {BLOCK_SQL}, {DELTA_SQL}, {STRIDE_SQL},
      x AS (SELECT trace_id, {MIX_SQL}, {BRANCH_SQL}, {SYNC_SQL}, {MEMORY_SQL}, {HAZARD_SQL}, {PAGES_SQL} FROM t GROUP BY ALL)
      SELECT CAST(trace_id AS VARCHAR) AS trace_id, {_round_all(PROGRAM_FEATURES)} FROM x JOIN ds USING (trace_id) JOIN fo USING (trace_id) JOIN bb USING (trace_id) JOIN sr USING (trace_id)""",
)
def _(spark, sf_dir):
    """Traces of three part files each, which arrive in several batches; a manifest tells when a trace is complete."""
    rows = trace_files.annotated_rows(b.trace(spark, sf_dir))
    path, out = scratch_path(spark, "incoming-parts"), scratch_path(spark, "streamed-parts")
    rows.repartitionByRange(3, "idx").sortWithinPartitions("trace_id", "idx").drop("idx").write.partitionBy("trace_id").options(header=True, emptyValue="").csv(path)
    files = spark.read.format("binaryFile").load(path + "/*/*.csv").select(F.regexp_extract("path", trace_files.TRACE_DIR, 1).alias("trace_id"))
    manifest = files.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_parts"))
    q = streams.ingest_trace_parts_stream(
        spark, path, manifest, out + "/staged", out + "/features", out + "/windows", out + "/failed", out + "/late", out + "/state", K,
        files_per_batch=10, id_pattern=trace_files.TRACE_DIR,
    )
    q.awaitTermination()
    return rounded(spark.read.parquet(out + "/features").drop("batch"))


@query("k2_window_counts_stream",f"{WITH_COUNTS} SELECT * FROM g")
def _(spark, sf_dir):
    path, out = scratch_path(spark, "rows"), scratch_path(spark, "counts")
    t = b.trace(spark, sf_dir).select("trace_id", "idx", "op_class", "branch_type", "inst_sync", "read_addrs", "write_addrs")
    t.write.parquet(path)
    counts = streams.window_counts_stream(spark.readStream.schema(t.schema).parquet(path), K)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(out)
    return _latest(updates)


@query("k2_closed_windows", f"{WITH_COUNTS} SELECT * FROM g WHERE size = {K}")
def _(spark, sf_dir):
    """Full windows of rows that arrive in several batches, each given out once."""
    path, out = scratch_path(spark, "rows"), scratch_path(spark, "closed")
    t = b.trace(spark, sf_dir).select("trace_id", "idx", "op_class", "branch_type", "inst_sync", "read_addrs", "write_addrs")
    t.repartition(4, "idx").write.parquet(path)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(path)
    counts = streams.closed_window_counts(stream, K)
    counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)


@query("k2_whole_windows", f"{WITH_COUNTS} SELECT *, 'closed' AS status FROM g")
def _(spark, sf_dir):
    """All windows, the last of each trace included, of rows and end marks that arrive in several batches."""
    path, out = scratch_path(spark, "rows"), scratch_path(spark, "whole")
    t = b.trace(spark, sf_dir).select("trace_id", "idx", "op_class", "branch_type", "inst_sync", "read_addrs", "write_addrs")
    t.repartition(4, "idx").write.parquet(path + "/rows")
    t.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_rows")).repartition(3, "trace_id").write.parquet(path + "/ends")
    read = lambda schema, kind: spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/{kind}")
    counts = streams.whole_window_counts(read(t.schema, "rows"), read("trace_id bigint, n_rows bigint", "ends"), K)
    counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)


def _latest(updates):
    """The last update of each window."""
    cols = [c for c in updates.columns if c != "batch"]
    return updates.groupBy("trace_id", "window_id").agg(F.max_by(F.struct(*cols), "batch").alias("r")).select("r.*")


@query("a6_latency_arrays", f"""WITH {b.L_SQL} SELECT trace_id, l1i_kb, l1d_kb, l2_kb, row_number() OVER (PARTITION BY trace_id, l1i_kb ORDER BY idx) - 1 AS idx, fetch_lat, exec_lat FROM l""")
def _(spark, sf_dir):
    """Latencies as one array file for each trace and configuration, read back."""
    path = scratch_path(spark, "latency-arrays")
    arrays.write_latency_arrays(b.latency(spark, sf_dir), path)
    out = arrays.read_latency_arrays(spark, f"{path}/*/*.npy")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("trace_id", "idx", "fetch_lat", "exec_lat")})


@query("a7_window_throughput_arrays", f"{THR_SQL} SELECT trace_id, resource, p0, p1, window_id, round(thr, 6) AS thr FROM x")
def _(spark, sf_dir):
    """Window throughputs as one matrix file for each trace and resource, read back."""
    path = scratch_path(spark, "throughput-arrays")
    arrays.write_window_throughput(windows.window_throughput(trace_counts(spark, sf_dir)), path)
    out = arrays.read_window_throughput(spark, f"{path}/*/*.npy").drop("cfg_idx")
    return rounded(out.withColumn("trace_id", F.col("trace_id").cast("bigint")))
