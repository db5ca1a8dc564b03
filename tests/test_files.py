"""File formats, connectors and streams on small files."""

from __future__ import annotations

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions.registry import DEFAULT_CONFIG, SEARCH_GRID
from tracemill.operators import program, scoring
from tracemill.sources import arrays, runs, sweeps, traces
from tracemill.streaming import traces as streams

HEADER = ",".join(traces.TRACE_COLUMNS)


def line(ip, op="IntAlu", branch="", taken="", reads="", deps=""):
    return f'0x{ip:x},"add a, b",{op},ADD,{branch},{taken},0x0,false,r1; r2,r3,{deps},{reads},,'


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_read_traces_splits_a_file(spark, tmp_path):
    for name, n in (("big", 4000), ("small", 3)):
        write(tmp_path / f"{name}.trace.csv", "\n".join([HEADER, *[line(i) for i in range(n)]]) + "\n")
    write(tmp_path / "empty.trace.csv", HEADER + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        t = traces.read_traces(spark, str(tmp_path / "*.trace.csv"))
        assert t.filter("ip <> idx").count() == 0
        assert {r["trace_id"]: r["n_rows"] for r in traces.count_rows_per_trace(t).collect()} == {"big": 4000, "small": 3}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    r = t.filter("trace_id = 'small' and idx = 1").first()
    assert (r["assembly"], r["read_regs"], r["write_regs"], r["branch_type"], r["taken"], r["fetch_lat"]) == ("add a, b", ["r1", "r2"], ["r3"], None, False, 0)


def test_row_id_from_path(spark, tmp_path):
    write(tmp_path / "row_17.trace.csv", f"{HEADER}\n{line(5, reads='0xffffffffffffff00(8)')}\n")
    r = traces.read_traces(spark, str(tmp_path), traces.ROW_FILE).first()
    assert (r["trace_id"], r["read_addrs"], r["read_accesses"][0]["size"]) == ("17", [-256], 8)


def test_other_header_fails(spark, tmp_path):
    write(tmp_path / "a.csv", "benchmark,cpi\nx,1.5\n")
    write(tmp_path / "b.csv", "benchmark,cost\nx,1.5\n")
    with pytest.raises(Exception):
        sweeps.read_sweep(spark, str(tmp_path)).collect()


def test_short_row_fails(spark, tmp_path):
    write(tmp_path / "a.csv", "benchmark,cpi,rob_size\nx,1.5,3\ny,2\n")
    with pytest.raises(Exception):
        sweeps.consolidate(spark, str(tmp_path)).collect()


def test_sidecars(spark, tmp_path):
    write(tmp_path / "p" / "features" / "program_features.json", '{"a": 1, "b": 2}')
    write(tmp_path / "q" / "features" / "program_features.csv", "a,b\n3,4\n")
    write(tmp_path / "p" / "features" / "cache_latency_summary.csv", "l1i_kb,l1d_kb,l2_kb,fetch_mean\n16,32,512,1.5\n16,64,512,2.5\n")
    write(tmp_path / "p" / "features" / "bp_rates_summary.csv", "bp_type,misprediction_rate\nlocal,0.1\ntage,0.05\n")
    write(tmp_path / "q" / "features" / "trace_bp.json", '{"local": 0.2}')
    got = {tuple(r) for r in sweeps.feature_columns(sweeps.read_program_sidecars(spark, str(tmp_path)), ["a", "b"]).collect()}
    assert got == {("p", 1.0, 2.0), ("q", 3.0, 4.0)}
    assert {tuple(r) for r in sweeps.read_cache_sidecars(spark, str(tmp_path), ["fetch_mean"]).collect()} == {("p", 16, 32, 512, 1.5), ("p", 16, 64, 512, 2.5)}
    assert {tuple(r) for r in sweeps.read_rate_sidecars(spark, str(tmp_path)).collect()} == {("p", "local", 0.1), ("p", "tage", 0.05), ("q", "local", 0.2)}
    write(tmp_path / "r" / "features" / "program_features.csv", "a,b\n3,4\n5,6\n")
    with pytest.raises(Exception, match="exactly one"):
        sweeps.read_program_sidecars(spark, str(tmp_path)).collect()


def test_arrays(spark, tmp_path):
    d = tmp_path / "tr"
    d.mkdir()
    lat = np.arange(20, dtype=np.uint16).reshape(10, 2)
    np.save(d / "l1i_16_l1d_32_l2_512_cache_latencies.npy", lat)
    np.save(d / "l1i_16_l1d_64_l2_512_cache_latencies.npy", np.zeros(5))  # wrong shape, skipped
    got = arrays.read_latency_arrays(spark, str(d / "*latencies.npy"))
    assert got.count() == 10
    assert tuple(got.filter("idx = 3").first()) == ("tr", 16, 32, 512, 3, 6, 7)
    s = program.latency_summary(got).first()
    assert s["fetch_p95"] == pytest.approx(np.percentile(lat[:, 0], 95)) and s["exec_mean"] == lat[:, 1].mean()

    (d / "config_0003").mkdir()
    np.save(d / "thr_alu_issue.npy", np.array([[1, 4, 1.5, 2.5], [1, 5, 3.5, 4.5]]))
    np.save(d / "config_0003" / "thr_rob.npy", np.array([[2, 4, 7, 1.5, 2.5, 9.0]]))
    rows = {tuple(r) for r in arrays.read_window_throughput(spark, str(d) + "{,/config_*}/thr_*.npy").collect()}
    assert ("tr", "alu_issue", 0, 5, 0, 1, 4.5) in rows and ("tr", "rob", 3, 4, 7, 2, 9.0) in rows and len(rows) == 7

    (d / "bp_rates").mkdir()
    np.save(d / "bp_rates" / "tage_bp_rate.npy", np.float32(0.25))
    assert tuple(arrays.read_rate_arrays(spark, str(d / "bp_rates" / "*.npy")).first()) == ("tr", "tage", 0.25)
    np.save(d / "all.npy", np.arange(12, dtype=np.uint16).reshape(2, 3, 2))
    assert arrays.read_config_latency_arrays(spark, str(d / "all.npy")).filter("cfg_idx = 1 and idx = 2 and fetch_lat = 10 and exec_lat = 11").count() == 1


def test_arrays_are_written_in_segments(spark, tmp_path):
    """Sparse positions, several traces and configurations, segments far smaller than a trace, written twice."""
    rows = [(t, c, 32, 512, 3 * i + 1, i + t, i * c) for t in (1, 2) for c in (16, 64) for i in range(50 * t)]
    lat = spark.createDataFrame(rows, "trace_id long, l1i_kb int, l1d_kb int, l2_kb int, idx long, fetch_lat int, exec_lat int").repartition(7)
    for _ in range(2):
        arrays.write_latency_arrays(lat, f"file:{tmp_path}/lat", segment_rows=16)
    files = sorted(f.name for f in (tmp_path / "lat" / "1").iterdir())
    assert files == sorted(f"seg_{s}_l1i_{c}_l1d_32_l2_512_cache_latencies.npy" for s in (0, 16, 32, 48) for c in (16, 64))
    assert np.load(tmp_path / "lat" / "1" / files[0]).shape == (16, 2)
    got = {tuple(r) for r in arrays.read_latency_arrays(spark, f"{tmp_path}/lat/*/*.npy").collect()}
    assert got == {(str(t), c, a, b, (i - 1) // 3, f, e) for t, c, a, b, i, f, e in rows}

    thr = [("x", r, p, q, w, p + q + w / 8) for r, qs in (("alu", (0,)), ("rob", (0, 5))) for p in (1, 2) for q in qs for w in range(21)]
    df = spark.createDataFrame(thr, "trace_id string, resource string, p0 int, p1 int, window_id long, thr double").repartition(5)
    arrays.write_window_throughput(df, str(tmp_path / "thr"), segment_windows=8)
    assert len(list((tmp_path / "thr" / "x").iterdir())) == 6
    got = {tuple(r) for r in arrays.read_window_throughput(spark, f"{tmp_path}/thr/*/*.npy").drop("path", "cfg_idx").collect()}
    assert got == set(thr)
    empty = tmp_path / "none"
    arrays.write_latency_arrays(lat.limit(0), str(empty))
    assert not empty.exists()



def test_array_names_are_parsed_once_a_file(spark, tmp_path):
    """What a file name says is read before its rows are made, not for each row."""
    for name in ("l1i_16_l1d_32_l2_512_cache_latencies", "thr_alu"):
        np.save(tmp_path / f"{name}.npy", np.ones((3, 2 + ("thr" in name)), np.int32))
    for rows in (arrays.read_latency_arrays(spark, f"{tmp_path}/*latencies.npy"), arrays.read_window_throughput(spark, f"{tmp_path}/thr_*.npy")):
        above = rows._jdf.queryExecution().optimizedPlan().toString().split("MapIn")[0]
        assert "regexp" not in above and rows.count() == 3 and rows.first()["trace_id"] == tmp_path.name


def test_append_checks_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1)], "benchmark string, x int")
    sweeps.append_training_rows(df, path)
    sweeps.append_training_rows(df, path)
    assert sweeps.read_training_rows(spark, path).count() == 2 and sweeps.read_training_rows(spark, path, 0).count() == 1
    with pytest.raises(ValueError, match="columns differ"):
        sweeps.append_training_rows(df.withColumnRenamed("x", "y"), path)
    assert sweeps.read_training_rows(spark, path).schema.names == ["benchmark", "x"]


def test_appends_of_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    first, other = spark.createDataFrame([("1", 1)], "benchmark string, x int"), spark.createDataFrame([("1", 2.0)], "benchmark string, x double")
    plain = sweeps._put_if_absent

    def beaten(*args):
        """Another writer commits between the check and the commit of this one."""
        monkeypatch.setattr(sweeps, "_put_if_absent", plain)
        sweeps.append_training_rows(rival, path)
        return plain(*args)

    rival = first
    monkeypatch.setattr(sweeps, "_put_if_absent", beaten)
    assert sweeps.append_training_rows(first, path) == 1
    assert sorted(r.benchmark for r in sweeps.read_training_rows(spark, path).collect()) == ["1", "1"]
    path = str(tmp_path / "u")
    monkeypatch.setattr(sweeps, "_put_if_absent", beaten)
    with pytest.raises(ValueError, match="columns differ"):
        sweeps.append_training_rows(other, path)
    assert [tuple(r) for r in sweeps.read_training_rows(spark, path).collect()] == [("1", 1)]
    assert len([p for p in (tmp_path / "u").iterdir() if p.name.startswith("append_id=")]) == 1
    write(tmp_path / "foreign" / "x.txt", "x")
    with pytest.raises(ValueError, match="commit"):
        sweeps.append_training_rows(first, str(tmp_path / "foreign"))


def test_matrix_cache_is_reused(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1.5, 2.0)], "benchmark string, x double, cpi double")
    df.write.parquet(src)
    first = sweeps.materialize_matrix(df, out, src, ["x"], "cpi", ["benchmark"])
    assert first.first()["features"] == [1.5]
    again = sweeps.materialize_matrix(df.withColumn("x", F.lit(9.0)), out, src, ["x"], "cpi", ["benchmark"])
    assert again.first()["features"] == [1.5]


def test_run_metrics_and_nested_report(spark, tmp_path):
    write(tmp_path / "mask_01_drop_x" / "metrics.json", json.dumps({"total_duration": 2, "best_percent_error": 3.5, "ablation_flags": {"drop_stale_features": True}, "epochs": [{"duration": 1, "train_loss": 2, "eval_loss": 3, "percent_error": 4}] * 2}, indent=2))
    m = runs.read_run_metrics(spark, str(tmp_path / "*" / "metrics.json"))
    assert [(r["run_id"], r["epoch"], r["eval_loss"]) for r in m.orderBy("epoch").collect()] == [("mask_01_drop_x", 1, 3.0), ("mask_01_drop_x", 2, 3.0)]
    assert runs.read_run_records(spark, str(tmp_path / "*" / "metrics.json")).first()["drop_stale_features"] == 1
    cfg = dict(DEFAULT_CONFIG)
    doc = {"baseline": {"predicted_cpi": 2, "predicted_cost": 9, "config": cfg}, "pareto_front": [
        {"predicted_cpi": 1, "predicted_cost": 5, "validation_candidate": True, "sensitivity": {}, "config": cfg},
        {"predicted_cpi": 1.5, "predicted_cost": 4, "validation_candidate": False, "sensitivity": {}, "config": cfg}], "stats": {"n": 1}}
    write(tmp_path / "report.json", json.dumps(doc, indent=2))
    got = runs.read_pareto_report(spark, str(tmp_path / "report.json"))
    assert [(r["kind"], r["predicted_cost"], r["l2_size"]) for r in got.orderBy("kind").collect()] == [("baseline", 9.0, "512KiB"), ("point", 5.0, "512KiB")]
    del cfg["rob_size"]
    write(tmp_path / "short.json", json.dumps(doc))
    with pytest.raises(Exception, match="misses rob_size"):
        runs.read_pareto_report(spark, str(tmp_path / "short.json")).collect()


def test_run_log_file(spark, tmp_path):
    write(tmp_path / "summary.txt", "intro\nTest regions split: 0.00 - Test configs split: 0.125\n  Final Percent Error: 3.08%\n\nTest regions split: 0.5 - Test configs split: 0.25\n  failed\nTest regions split: 0.5 - Test configs split: 0.5\n  Final Percent Error: 4%\n")
    got = runs.read_run_log(spark, str(tmp_path / "summary.txt"), "splits")
    assert [(r["region_split"], r["config_split"], r["percent_error"]) for r in got.orderBy("pos").collect()] == [(0.0, 0.125, 3.08), (0.5, 0.5, 4.0)]


def test_stream_resumes_and_isolates_bad_traces(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    write(src / "good.trace.csv", "\n".join([HEADER, *[line(i % 5) for i in range(30)]]) + "\n")
    write(src / "bad.trace.csv", f"{HEADER}\n{line(1)}\n{line(2, branch='sideways')}\n")

    def drain():
        q = streams.ingest_traces_stream(spark, str(src), f"{out}/f", f"{out}/w", f"{out}/x", f"{out}/c", k=8)
        q.awaitTermination()
        return {r["trace_id"] for r in spark.read.parquet(f"{out}/f").collect()}, {r["trace_id"] for r in spark.read.parquet(f"{out}/x").collect()}

    assert drain() == ({"good"}, {"bad"})
    write(src / "later.trace.csv", "\n".join([HEADER, *[line(i) for i in range(9)]]) + "\n")
    assert drain() == ({"good", "later"}, {"bad"})
    w = spark.read.parquet(f"{out}/w")
    assert w.filter("trace_id = 'good'").count() == 4 and w.filter("trace_id = 'later'").count() == 2


def test_stream_waits_for_all_parts_of_a_trace(spark, tmp_path):
    """One trace in three batches, out of order; one without its last part; one with a part too many; one not in the manifest."""
    src, out = tmp_path / "in", tmp_path / "out"
    manifest = spark.createDataFrame([("t", 3), ("u", 2), ("v", 1)], "trace_id string, n_parts int")
    text = lambda rows: "\n".join([HEADER, *[line(i % 5) for i in rows]]) + "\n"

    def drain(*files):
        for name, rows in files:
            write(src / name, text(rows))
        streams.ingest_trace_parts_stream(
            spark, str(src), manifest, f"{out}/s", f"{out}/f", f"{out}/w", f"{out}/x", f"{out}/l", f"{out}/c", k=8, files_per_batch=1, id_pattern=r"([^/]+)/[^/]+$",
        ).awaitTermination()
        done = sorted(r["trace_id"] for r in spark.read.parquet(f"{out}/f").collect()) if (out / "f").exists() else []
        return done, [r["_file"].split("/")[-2:] for r in spark.read.parquet(f"{out}/l").collect()]

    assert drain(("t/part-2.csv", range(20, 27)), ("u/part-0.csv", range(4)), ("w/part-0.csv", range(4))) == ([], [])
    assert drain(("t/part-0.csv", range(10)), ("v/part-0.csv", range(3))) == (["v"], [])
    assert drain(("t/part-1.csv", range(10, 20)), ("v/part-1.csv", range(9))) == (["t", "v"], [["v", "part-1.csv"]])
    whole = tmp_path / "whole"
    write(whole / "t.trace.csv", text(range(27)))
    streams.ingest_traces_stream(spark, str(whole), f"{whole}/f", f"{whole}/w", f"{whole}/x", f"{whole}/c", k=8).awaitTermination()
    for kind in ("f", "w"):
        got, want = (spark.read.parquet(f"{d}/{kind}").filter("trace_id = 't'").drop("batch") for d in (out, whole))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == (1 if kind == "f" else 4)


def test_score_mlp_matches_numpy(spark):
    r = np.random.default_rng(0)
    weights = [(r.normal(size=(3, 256)), r.normal(size=256)), (r.normal(size=(256, 128)) / 16, r.normal(size=128)), (r.normal(size=(128, 1)) / 12, r.normal(size=1))]
    x = r.normal(size=(40, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double")
    got = {q["id"]: q["predicted_cpi"] for q in scoring.score_mlp(df, ["a", "b", "c"], weights).collect()}
    h = x
    for i, (w, b) in enumerate(weights):
        h = h @ w + b
        h = np.maximum(h, 0) if i < 2 else h
    for i in range(40):
        assert got[i] == pytest.approx(h[i, 0], rel=1e-3, abs=1e-3)
    with pytest.raises(ValueError):
        scoring.score_mlp(df, ["a"], weights)


def test_boosted_regressor(spark):
    df = spark.createDataFrame([(float(i), float(i % 4) * 2 + 1) for i in range(60)], "x double, cpi double")
    model = scoring.fit_regressor(df, ["x"], kind="gbt")
    assert scoring.predict(model, df).filter("predicted_cpi is null").count() == 0
    assert len(SEARCH_GRID) == 19


def test_whole_windows_report_late_rows(spark, tmp_path):
    """Rows of one trace in three batches, its end mark in the second, a row too many in the last."""
    schema, k = "trace_id string, idx bigint, op_class string, branch_type string, inst_sync boolean, read_addrs array<bigint>, write_addrs array<bigint>", 4
    row = lambda t, i: (t, i, "MemRead" if i % 2 else "IntAlu", None, None, [64] if i % 2 else [], [])
    batches = [([("a", i) for i in (0, 1, 4, 9)] + [("b", 0)], []), ([("a", i) for i in (2, 3, 5, 6)], [("a", 10)]), ([("a", 7), ("a", 8), ("a", 1), ("c", 0)], [("none", 0)]), ([("b", i) for i in range(1, 5)] + [("b", 1)], []), ([("b", 2), ("b", 3)], [])]
    for kind in ("rows", "ends"):
        (tmp_path / kind).mkdir()
    read = lambda kind, s: spark.readStream.schema(s).parquet(str(tmp_path / kind))
    counts = streams.whole_window_counts(read("rows", schema), read("ends", "trace_id string, n_rows bigint"), k)
    for rows, marks in batches:
        spark.createDataFrame([row(*r) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        if marks:
            spark.createDataFrame(marks, "trace_id string, n_rows bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "ends"))
        q = counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    got = sorted((r.trace_id, r.window_id, r.status, r["size"]) for r in spark.read.schema(counts.schema).parquet(str(tmp_path / "out")).collect())
    assert ("a", 0, "closed", 4) in got and ("a", 1, "closed", 4) in got and ("a", 2, "closed", 2) in got
    assert ("b", 0, "closed", 5) in got and not any(t == "c" for t, *_ in got)
    assert [g for g in got if g[2] == "late"] == [("b", 0, "late", 2)]
    assert sum(t == "a" for t, *_ in got) == 3 and len(got) == 5


def test_neighbouring_windows_share_a_state_row(spark, tmp_path):
    """Open windows of a run lie in one state row; each is still given out by itself, when it is full or idle."""
    schema, k = "trace_id string, idx bigint, op_class string, branch_type string, inst_sync boolean, read_addrs array<bigint>, write_addrs array<bigint>", 4
    (tmp_path / "ends").mkdir()
    spark.createDataFrame([("a", i, "IntAlu", None, None, [], []) for i in (0, 1, 2, 3, 4, 5, 9, 4 * 200)], schema).coalesce(1).write.parquet(str(tmp_path / "rows"))
    read = lambda kind, s: spark.readStream.schema(s).parquet(str(tmp_path / kind))
    rows, ends = read("rows", schema), read("ends", "trace_id string, n_rows bigint")
    start = lambda df, name: df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / f"state-{name}"))
    found = lambda df, name: sorted((r.window_id, r["size"], r.n_alu) for r in spark.read.schema(df.schema).parquet(str(tmp_path / name)).collect())
    for name, df in (("closed", streams.closed_window_counts(rows, k)), ("whole", streams.whole_window_counts(rows, ends, k))):
        q = start(df, name).trigger(availableNow=True).start(str(tmp_path / name))
        q.awaitTermination()
        assert found(df, name) == [(0, 4, 4)] and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    for name, df in (("idle", streams.closed_window_counts(rows, k, idle=500)), ("forget", streams.whole_window_counts(rows, ends, k, forget=500))):
        (tmp_path / name).mkdir()
        q, until = start(df, name).start(str(tmp_path / name)), time.time() + 60
        while len(found(df, name)) < 4 and time.time() < until:
            time.sleep(1)
        q.stop()
        assert found(df, name) == [(0, 4, 4), (1, 2, 2), (2, 1, 1), (200, 1, 1)]
    status = {r.window_id: r.status for r in spark.read.schema(df.schema).parquet(str(tmp_path / "forget")).collect()}
    assert status == {0: "closed", 1: "partial", 2: "partial", 200: "partial"}


def test_run_names_are_cut_once_a_file(spark, tmp_path):
    """The name of a run is taken from its path below the explode of epochs, so once a file."""
    for i in range(2):
        (tmp_path / f"run{i}").mkdir()
        (tmp_path / f"run{i}" / "metrics.json").write_text(json.dumps({"total_duration": 1.0, "epochs": [{"eval_loss": i + e / 4} for e in range(3)]}))
    df = runs.read_run_metrics(spark, str(tmp_path / "*" / "*.json"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("regexp_extract")
    assert sorted((r.run_id, r.epoch, r.eval_loss) for r in df.collect()) == [(f"run{i}", e + 1, i + e / 4) for i in range(2) for e in range(3)]


def test_streamed_rows_are_placed_without_a_sort(spark, tmp_path, monkeypatch):
    """Rows of several blocks, files and traces get the places of their files; only the blocks' sums are ordered."""
    folder = tmp_path / "in"
    for trace, parts in (("a", (3, 2)), ("b", (4,))):
        for part, n in enumerate(parts):
            (folder / f"trace_id={trace}").mkdir(parents=True, exist_ok=True)
            (folder / f"trace_id={trace}" / f"part-{part:05d}.csv").write_text("IP,Category\n" + "".join(f"0x{16 * part + i + 1:x},IntAlu\n" for i in range(n)))
    raw = spark.read.schema("IP string, Category string").option("header", True).csv(str(folder) + "/*/*.csv")
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    raw = raw.withColumns({c: F.lit("") for c in streams.STREAM_SCHEMA.names if c not in raw.columns})
    rows, plans, made = streams._placed(raw, r"/trace_id=([^/]+)/[^/]*$").localCheckpoint(), [], []

    def keep(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        made.append(df.localCheckpoint())
        return made[-1]

    monkeypatch.setattr(streams, "cut_lineage", keep)
    out = str(tmp_path)
    streams._process_traces(rows, f"{out}/f", f"{out}/w", f"{out}/x", 0, 8)
    (trace, plan), = ((t, p) for t, p in zip(made, plans) if "reg_deps" in t.columns)
    assert "Window" not in plan
    assert sorted(map(tuple, trace.select("trace_id", "idx", "ip").collect())) == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("a", 3, 17), ("a", 4, 18), *(("b", i, i + 1) for i in range(4))]
    with pytest.raises(Exception, match="rows are missing"):
        streams._process_traces(rows.filter("IP <> '0x2'"), f"{out}/f", f"{out}/w", f"{out}/x", 1, 8)
