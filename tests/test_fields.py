"""Field parsing, mapping, checks and splits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions import opclass, scalars
from tracemill.functions.registry import REGISTRY
from tracemill.operators import encode, matrix, metrics, scoring, splits, sweeps, windows
from tracemill.session import RELEASE_SHUFFLES, cut_lineage


def one(spark, *cols, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"`{n}` string" for n in names))
    return df.select(*cols).first()


@pytest.mark.parametrize("text,kb,size", [("16KiB", 16, 16384), ("1MiB", 1024, 1 << 20), ("1GiB", 1 << 20, 1 << 30), ("64", 64, 64), (" 2 MB ", 2048, 2 << 20), ("1.5MiB", 1536, 1572864)])
def test_parse_size(spark, text, kb, size):
    assert tuple(one(spark, scalars.parse_size("c"), scalars.parse_size("c", "bytes"), c=text)) == (kb, size)


@pytest.mark.parametrize("expr,text", [(scalars.parse_size, "bad"), (scalars.encode_predictor, "other"), (scalars.parse_branch_type, "sideways"), (opclass.fu_group, " ")])
def test_bad_text_fails(spark, expr, text):
    with pytest.raises(Exception):
        one(spark, expr("c"), c=text)


def test_predictor_and_branch(spark):
    assert one(spark, scalars.encode_predictor("a"), scalars.encode_predictor("b"), scalars.encode_predictor("c"), a="LOCAL", b="tage", c="1")[:] == (0, 1, 1)
    r = one(spark, scalars.parse_branch_type("a"), scalars.parse_branch_type("b"), scalars.branch_taken(scalars.parse_branch_type("a"), "t"), a="", b=" indirect ", t="true")
    assert r[:] == (None, "indirect", False)


def test_addresses_above_2_63(spark):
    r = one(spark, scalars.parse_addr_list("a"), scalars.parse_mem_access_list("a"), scalars.long_to_hex(scalars.hex_to_long("h")), a="0xffffffffffffffff(8);; 10", h="0x8000000000000001")
    assert r[0] == [-1, 16]
    assert [tuple(x) for x in r[1]] == [(-1, 8), (16, 0)]
    assert r[2] == "0x8000000000000001"


def test_opcode_dimension(spark):
    masks = spark.createDataFrame([("MOV", 1), ("PCMPGTQ", 4), ("MULPD", 0x40), ("MOVNTDQA", 0x14), ("IDIV", 2), ("ADDSD", 8)], "opcode string, mask int")
    rows = [(i, op, [], []) for i, op in enumerate(["MOV", "PCMPGTQ", "MULPD", "MOVNTDQA", "IDIV", "ADDSD", "NOSUCH", None])]
    df = spark.createDataFrame(rows, "idx int, opcode string, read_addrs array<long>, write_addrs array<long>")
    names = ["is_alu", "is_simd", "is_fp_mult_div", "is_mult_div", "is_fp"]
    got = {r["idx"]: [n for n in names if r[n]] for r in windows.instruction_flags(df, masks).collect()}
    assert got == {0: ["is_alu"], 1: ["is_simd"], 2: ["is_fp_mult_div"], 3: ["is_simd"], 4: ["is_mult_div"], 5: ["is_fp"], 6: [], 7: []}


def test_hex_is_strict(spark):
    r = one(spark, scalars.hex_to_long("a"), scalars.hex_to_long("b"), scalars.hex_to_long("c"), a="0x10", b="", c="000000000000000000ff")
    assert r[:] == (16, None, 255)
    for bad in ("zz", "0x", "11112222333344445", "1 2"):
        if bad != "0x":
            with pytest.raises(Exception, match="not a 64-bit hex number"):
                one(spark, scalars.hex_to_long("a"), a=bad)


def test_op_classes(spark):
    df = spark.createDataFrame([("MemRead",), ("FloatMemWrite",), ("FloatDiv",), ("Bf16Cvt",), ("SimdSha3",), ("Whatever",), ("IntDiv",)], "c string")
    got = [tuple(r) for r in df.select("c", opclass.fu_group("c"), opclass.op_latency("c")).collect()]
    assert got == [("MemRead", "read_port", 1), ("FloatMemWrite", "rdwr_port", 1), ("FloatDiv", "fp_mult_div", 12), ("Bf16Cvt", "fp_alu", 2), ("SimdSha3", "simd_unit", 1), ("Whatever", "other", 1), ("IntDiv", "int_mult_div", 20)]
    assert opclass.op_class_dim(spark).filter("fu_group = 'simd_unit'").count() == 50


def test_registry_counts():
    sizes = {r.name: 1 for r in REGISTRY.resources}
    for r in REGISTRY.resources:
        for p in r.params:
            sizes[r.name] *= REGISTRY.by_name[p].size()
    assert sum(sizes[r.name] for r in REGISTRY.enabled_resources(False)) == 176
    assert sum(sizes[r.name] for r in REGISTRY.enabled_resources(True)) == 1568
    assert len(REGISTRY.enabled_params()) == 21
    assert len(matrix.matrix_names(sizes=list(range(11)))) == 3874
    assert len(matrix.queue_names(list(range(11)))) == 2334


def test_to_config_defaults(spark):
    df = spark.createDataFrame([(3, 5, "tage", "1MiB")], "rdwr_port_issue_width int, read_port_issue_width int, branch_predictor string, l2_size string")
    r = sweeps.to_config(df).first()
    assert (r["ls_issue_width"], r["num_ls_pipes"], r["num_load_pipes"], r["branch_predictor"], r["l2_cache_kb"], r["rob_size"], r["misprediction_percent"]) == (8, 3, 5, 1, 1024, 128, 0.05)


def test_expand_tokens():
    groups = {"spec": ["a", "b"], "adversarial": ["c", "d"]}
    assert sweeps.expand_tokens("spec, adversarial_except_ood,a , x", groups, "c") == ["a", "b", "d", "x"]
    with pytest.raises(ValueError):
        sweeps.expand_tokens("adversarial_except_ood", groups)


def test_unknown_benchmark_is_rejected(spark):
    df = spark.createDataFrame([("a",)], "benchmark string")
    with pytest.raises(ValueError, match="unknown benchmarks"):
        sweeps.whitelist(df, ["a", "zz"], df)


@pytest.mark.parametrize("text", ['{"a": "x"}', '{"a": null}', "[]", "{}", '[1, "NaN"]', "3"])
def test_bad_feature_maps(spark, text):
    df = spark.createDataFrame([(text,)], "j string")
    with pytest.raises(Exception):
        sweeps.coerce_feature_map(df, "j").select("features").collect()


def test_feature_map_shapes(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2.5}',), ('{"features": {"c": -1}}',), ("[4, 5]",)], "j string")
    got = [r["features"] for r in sweeps.coerce_feature_map(df, "j").collect()]
    assert got == [{"a": 1.0, "b": 2.5}, {"c": -1.0}, {"f0": 4.0, "f1": 5.0}]


@pytest.mark.parametrize("mode", ["error", "zero", "drop"])
def test_missing_program_rows(spark, mode):
    sweep = spark.createDataFrame([("a", None), ("b", "7"), ("c", None)], "benchmark string, ff_instructions string")
    prog = spark.createDataFrame([("a", 1.0), ("b_7", 2.0)], "benchmark string, x double")
    out = sweeps.join_program(sweep, prog, on_missing=mode)
    if mode == "error":
        with pytest.raises(Exception, match="no program features for c"):
            out.collect()
    else:
        got = {r["benchmark"]: r["prog_x"] for r in out.collect()}
        assert got == ({"a": 1.0, "b": 2.0, "c": 0.0} if mode == "zero" else {"a": 1.0, "b": 2.0})


def test_lookup_missing_key(spark):
    from tracemill.functions.registry import Param, Registry, Resource
    reg = Registry((Param("a", None, 1, 1, 4),), (Resource("r", ("a",)),))
    thr = spark.createDataFrame([("t", "r", 1, w, float(w)) for w in range(5)], "trace_id string, resource string, p0 int, window_id int, thr double")
    lut = encode.build_lookup(thr)
    cfg = spark.createDataFrame([("t", "c1", 1), ("t", "c2", 3)], "trace_id string, cid string, a int")
    with pytest.raises(Exception, match="lookup key not found"):
        matrix.lookup_features(cfg, lut, ["trace_id", "cid"], reg).collect()
    assert [r["cid"] for r in matrix.lookup_features(cfg, lut, ["trace_id", "cid"], reg, on_missing="drop").collect()] == ["c1"]
    zero = {r["cid"]: sum(r["vec"]) for r in matrix.lookup_features(cfg, lut, ["trace_id", "cid"], reg, on_missing="zero").collect()}
    assert zero["c2"] == 0.0 and zero["c1"] > 0


def test_splits_are_disjoint_and_complete(spark):
    rows = [(i, f"b{i % 3}", i % 20, i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, benchmark string, region int, cfg int")
    for split in [
        splits.random_split(df, ["id"], 0.25, 1), splits.random_split(df, ["id"], 0.25, 1, exact=False), splits.holdout_configs(df, ["cfg"], 0.5, 1),
        splits.holdout_regions(df, 0.25, 1), splits.holdout_benchmark(df, "b1", ["id"], 10, 1), splits.stratified_split(df, "id", 5, 0.2, ["id"], 1),
    ]:
        train, test = splits.parts(split)
        a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
        assert not a & b and len(a | b) == 400 and b
    held = splits.holdout_configs(df, ["cfg"], 0.5, 1)
    splits.assert_no_leak(held, ["cfg"], ["benchmark", "region"], ["shared_configs", "shared_rows"])
    with pytest.raises(ValueError, match="overlap"):
        splits.assert_no_leak(held, ["cfg"], ["benchmark", "region"], ["shared_regions"])


def test_split_errors(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2)], "id int, benchmark string, region int")
    with pytest.raises(Exception, match="no test region"):
        splits.holdout_regions(df, 0.25, 1).collect()
    with pytest.raises(Exception, match="too few rows"):
        splits.holdout_benchmark(df, "a", ["id"], onboard=5).collect()


def test_stratified_sample_size(spark):
    df = spark.createDataFrame([(i, "big" if i < 300 else f"s{i % 7}") for i in range(400)], "id int, benchmark string")
    assert splits.stratified_sample(df, 37, ["id"], 3).count() == 37
    assert splits.stratified_sample(df, 4000, ["id"], 3).count() == 400


def test_scaling_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in metrics.standard_scale(df, df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert [tuple(r) for r in metrics.minmax_scale(df, df, ["a", "b"]).collect()] == [(0.0, 0.0), (1.0, 0.0)]


def test_r2_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)], "x double, cpi double")
    assert metrics.ols_r2(df, ["x"]) > 0.9
    assert metrics.ols_r2(df.withColumn("cpi", F.lit(1.0)), ["x"]) != metrics.ols_r2(df, ["x"])
    with pytest.raises(ValueError):
        metrics.ols_r2(df.limit(1), ["x"])


@pytest.mark.parametrize("segment", [3, None])
def test_early_stop(spark, segment):
    loss = [5, 4, 3] + [3.5] * 12 + [1.0]
    df = spark.createDataFrame([(1, i + 1, float(x), float(x)) for i, x in enumerate(loss)], "run_id int, epoch int, eval_loss double, percent_error double")
    r = metrics.best_epoch(df, segment_rows=segment).first()
    assert (r["best_epoch"], r["stop_epoch"], r["best_eval_loss"]) == (3, 13, 3.0)


def test_r2_of_all_features(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) * [1.0, 1e6, 1e-3, 1.0] + [0.0, 5e7, 0.0, 3.0]
    x[:, 3] = 2.0 * x[:, 0] + 7.0  # depends on another feature
    y = x @ [1.0, 2e-6, 300.0, 0.5] + rng.normal(size=300)
    group = rng.integers(0, 3, 300)
    rows = [(int(g), *map(float, r), float(v), 4.0) for g, r, v in zip(group, x, y)]
    df = spark.createDataFrame([*rows, (9, 1.0, 1.0, 1.0, 1.0, 1.0, 4.0), (0, None, 1.0, 1.0, 1.0, 1.0, 4.0)], "g int, a double, b double, c double, d double, cpi double, k double")

    def brute(take):
        own = np.column_stack([np.ones(take.sum()), x[take]])
        own /= np.abs(own).max(0)
        fit = own @ np.linalg.lstsq(own, y[take], rcond=1e-12)[0]
        return 1 - ((y[take] - fit) ** 2).sum() / ((y[take] - y[take].mean()) ** 2).sum()

    names = ["a", "b", "c", "d", "k"]  # k is constant
    assert metrics.ols_r2(df.where("g < 9"), names) == pytest.approx(brute(group >= 0), abs=1e-8)
    got = {r.g: (r.n, r.r2) for r in metrics.ols_r2_by_group(df, ["g"], names).collect()}
    for g in range(3):
        assert got[g][0] == (group == g).sum() and got[g][1] == pytest.approx(brute(group == g), abs=1e-8)
    assert got[9][0] == 1 and got[9][1] != got[9][1]


def test_least_absolute_deviations(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(1, 9, 41).astype(float)
    y = 3.0 * x - 2.0 + rng.normal(size=41)
    y[:6] += 100.0
    df = spark.createDataFrame([(float(a), 5.0, float(b)) for a, b in zip(x, y)] + [(None, 5.0, 1.0)], "x double, k double, cpi double")
    lines = [((y[i] - y[j]) / (x[i] - x[j]), x[i], y[i]) for i in range(41) for j in range(i) if x[i] != x[j]]
    best = min(np.abs(y - b - s * (x - a)).mean() for s, a, b in lines)  # an optimal line passes through two points
    model = scoring.fit_regressor(df, ["x", "k"], kind="absolute")
    got = scoring.predict(model, df.dropna()).agg(F.avg(F.abs(F.col("cpi") - F.col("predicted_cpi")))).first()[0]
    assert best <= got + 1e-12 and got == pytest.approx(best, rel=2e-3)
    with pytest.raises(ValueError):
        scoring.fit_absolute(df.limit(0), ["x"])


def test_lineage_cut_leaves_its_input_usable(spark):
    """Shuffle files go with the cut, the input keeps its own, and the setting is as before."""
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    first = counts.orderBy("k").collect()
    kept = cut_lineage(counts)
    assert spark.conf.get(RELEASE_SHUFFLES, "false") == "false"
    assert kept.orderBy("k").collect() == first == counts.orderBy("k").collect()
    assert cut_lineage(kept.join(counts, ["k", "count"])).count() == 7
