"""Operators against small sequential restatements, with pieces small enough to force every split."""

from __future__ import annotations

import random
from collections import defaultdict
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions.registry import FIXED_PARAMS, SEARCH_GRID
from tracemill.operators import design, encode, metrics, ordered, program, similarity, skyline, splits, sweeps, windows
from tracemill.operators.ordered import block_product, bucketed_rank, dim_join, hash_rank, last_before, prefix_sum, value_buckets
from tracemill.session import compiled_methods

TRACE_SCHEMA = """trace_id string, idx bigint, ip bigint, op_class string, branch_type string, taken boolean, inst_sync boolean,
  read_addrs array<bigint>, write_addrs array<bigint>, reg_deps array<bigint>, mem_deps array<bigint>"""


def make_trace(seed: int, sizes: dict[str, int]):
    """Random rows; ip 1 is hot: it holds more than a third of all rows."""
    r, rows = random.Random(seed), []
    for name, n in sizes.items():
        for i in range(n):
            ip = 1 if r.random() < 0.4 else r.randint(2, 12)
            kind = r.choice([None, None, "direct_conditional", "direct_unconditional", "indirect"])
            op = r.choice(["MemRead", "MemWrite", "IntAlu", "IntMult", "FloatAdd", "FloatMult", "SimdAdd", "Other"])
            reads = [r.choice([64, 128, 4096, -8, 2**62]) + 8 * r.randint(0, 3)] if op == "MemRead" else []
            writes = [r.randint(0, 3) * 4096] if op == "MemWrite" else []
            deps = [r.choice([1, 2, ip, 99]) for _ in range(r.randint(0, 3))]
            mem = [r.randint(1, 12) for _ in range(r.randint(0, 2))]
            rows.append((name, i, ip, op, kind, bool(kind) and r.random() < 0.5, r.random() < 0.1, reads, writes, deps, mem))
    return rows


SIZES = {"a": 230, "b": 1, "c": 37}


@pytest.fixture(scope="module")
def rows():
    return make_trace(3, SIZES)


@pytest.fixture(scope="module")
def trace(spark, rows):
    return spark.createDataFrame(rows, TRACE_SCHEMA).repartition(5, "ip").cache()


def by_trace(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def pct(x, p):
    return float(np.percentile(x, p)) if len(x) else 0.0


def sequential_program(rows, dep_window=16, crit=10, min_samples=16):
    """The 30 features of one trace, row by row."""
    groups = {"MemRead": "load", "MemWrite": "store", "IntAlu": "int_alu", "IntMult": "int_mult_div", "FloatAdd": "fp_alu", "FloatMult": "fp_mult_div", "SimdAdd": "simd", "Other": "other"}
    n = len(rows)
    count = defaultdict(int)
    seen, dist, uses, indep, ncrit = {}, [], defaultdict(int), 0, 0
    blocks, cur, last, steps, loads, pages = [], 0, {}, defaultdict(lambda: defaultdict(int)), defaultdict(int), (set(), set())
    for _, i, ip, op, kind, taken, sync, reads, writes, deps, mem in rows:
        count[groups[op]] += 1
        count["sync"] += sync
        cur += 1
        if kind:
            count["branch"] += 1
            count[kind] += 1
            if taken:
                blocks.append(cur)
                cur = 0
        known = [i - seen[d] for d in deps if d in seen]
        dist += known
        for d in deps:
            uses[d] += 1
        indep += not known or max(known) > dep_window
        ncrit += bool(known) and max(known) > crit
        seen[ip] = i
        if reads or writes:
            count["mem"] += 1
            count["mdep"] += len(mem) > 0
            count["haz"] += len(mem) > 1
        if reads:
            a = reads[0]
            pages[0].add((a % 2**64) >> 12)
            loads[ip] += 1
            if ip in last:
                steps[ip][a % 2**64 - last[ip] % 2**64] += 1
            last[ip] = a
        if writes:
            pages[1].add((writes[0] % 2**64) >> 12)
    if cur:
        blocks.append(cur)
    scores = [max(s.values()) / sum(s.values()) for ip, s in steps.items() if loads[ip] >= min_samples and s]
    div = lambda a, b: a / b if b else 0.0
    return {
        **{f"frac_{g}": count[g] / n for g in ("int_alu", "int_mult_div", "fp_alu", "fp_mult_div", "simd", "load", "store", "branch", "other")},
        "branch_rate": count["branch"] / n, "mean_basic_block_size": float(np.mean(blocks)), "p50_basic_block_size": pct(blocks, 50), "p95_basic_block_size": pct(blocks, 95),
        "frac_sync_instructions": count["sync"] / n, "frac_indirect_branches": div(count["indirect"], count["branch"]),
        "frac_direct_cond_branches": div(count["direct_conditional"], count["branch"]), "frac_direct_uncond_branches": div(count["direct_unconditional"], count["branch"]),
        "mean_reg_dep_distance": float(np.mean(dist)) if dist else 0.0, "p50_reg_dep_distance": pct(dist, 50), "p95_reg_dep_distance": pct(dist, 95),
        "frac_independent_last_16": indep / n, "crit_path_density_10": ncrit / n, "mean_reg_fan_out": div(sum(uses.values()), len(uses)),
        "memory_instruction_fraction": (count["load"] + count["store"]) / n, "store_to_load_ratio": div(count["store"], count["load"]),
        "unique_load_pages": float(len(pages[0])), "unique_store_pages": float(len(pages[1])), "frac_mem_dependent": div(count["mdep"], count["mem"]),
        "frac_memory_ordering_hazards": div(count["haz"], count["mem"]), "load_stride_regularity": float(np.mean(scores)) if scores else 0.0,
    }


@pytest.mark.parametrize("segment", [7, None])
def test_program_features(trace, rows, segment):
    got = {r["trace_id"]: r.asDict() for r in program.program_features(trace, stride_min_samples=6, segment_rows=segment).collect()}
    assert set(got) == set(SIZES)
    for name, part in by_trace(rows).items():
        want = sequential_program(part, min_samples=6)
        assert list(want) and set(want) == set(program.PROGRAM_FEATURES)
        for k, v in want.items():
            assert got[name][k] == pytest.approx(v, abs=1e-12), (name, k)


@pytest.mark.parametrize("minimum", [15, 16])
def test_stride_sample_threshold(spark, minimum):
    rows = [("t", i, 5, "MemRead", None, False, False, [64 * i], [], [], []) for i in range(15)]
    t = spark.createDataFrame(rows, TRACE_SCHEMA)
    got = program.stride_regularity(t, min_samples=minimum).first()["load_stride_regularity"]
    assert got == (1.0 if minimum == 15 else 0.0)


def test_empty_trace(spark):
    assert program.program_features(spark.createDataFrame([], TRACE_SCHEMA)).count() == 0


@pytest.mark.parametrize("segment", [5, None])
def test_last_seen_distance(trace, rows, segment):
    want = set()
    for name, part in by_trace(rows).items():
        seen = {}
        for r in part:
            for pos, d in enumerate(r[9]):
                want.add((name, r[1], pos, d, r[1] - seen[d] if d in seen else None))
            seen[r[2]] = r[1]
    got = {tuple(r) for r in program.last_seen_distance(trace, segment).collect()}
    assert got == want


def test_resolve_dependencies_uses_last_occurrence(trace, rows):
    for name, part in by_trace(rows).items():
        last = {r[2]: r[1] for r in part}
        want = {r[1]: sorted({last[d] for d in r[9] + r[10] if d in last and last[d] < r[1]}) for r in part}
        got = {r["idx"]: r["deps"] for r in program.resolve_dependencies(trace.filter(F.col("trace_id") == name)).collect()}
        assert got == want


@pytest.mark.parametrize("segment", [4, None])
def test_blocks_and_prefix_sum(trace, rows, segment):
    got = {(r["trace_id"], r["idx"]): r["block_id"] for r in windows.block_id(trace, segment).collect()}
    for name, part in by_trace(rows).items():
        n = 0
        for r in part:
            assert got[(name, r[1])] == n
            n += r[5]
    sizes = program.basic_block_sizes(trace, segment).groupBy("trace_id").agg(F.sum("block_size").alias("s")).collect()
    assert {r["trace_id"]: r["s"] for r in sizes} == SIZES


@pytest.mark.parametrize("segment", [6, None])
def test_outcome_predictability(trace, rows, segment):
    got = {(r["trace_id"], r["ip"]): r for r in windows.outcome_predictability(trace, segment).collect()}
    stats = defaultdict(lambda: [0, 0, 0, 0, None])
    for r in rows:
        if r[4] is None:
            continue
        s = stats[(r[0], r[2])]
        s[0] += 1
        if r[4] == "direct_conditional":
            s[1] += r[5]
            s[2] += not r[5]
            s[3] += s[4] is not None and s[4] != r[5]
            s[4] = r[5]
    assert set(got) == set(stats)
    for k, s in stats.items():
        assert got[k]["majority_miss_rate"] == pytest.approx(min(s[1], s[2]) / s[0])
        assert got[k]["previous_miss_rate"] == pytest.approx(s[3] / s[0])


def test_window_counts_partial_last_window(trace):
    got = windows.window_counts(trace, 50).groupBy("trace_id").agg(F.sum("size").alias("n"), F.count("*").alias("w"), F.min("size").alias("least")).collect()
    assert {(r["trace_id"], r["n"], r["w"], r["least"]) for r in got} == {("a", 230, 5, 30), ("b", 1, 1, 1), ("c", 37, 1, 37)}


def test_pipe_bounds_are_ordered(trace):
    thr = windows.window_throughput(windows.window_counts(trace, 20))
    pair = thr.filter(F.col("resource").startswith("load_ls")).groupBy("trace_id", "window_id", "p0", "p1").pivot("resource", ["load_ls_pipes_lower", "load_ls_pipes_upper"]).agg(F.first("thr"))
    assert pair.filter(F.col("load_ls_pipes_lower") > F.col("load_ls_pipes_upper") + 1e-9).count() == 0
    assert thr.select("resource", "p0", "p1").distinct().count() == 176


def weighted(samples):
    w = np.clip(samples, 0, None)
    ps = np.array(encode.PERCENT_POINTS) / 100
    if w.sum() == 0:
        return np.percentile(samples, encode.PERCENT_POINTS)
    order = np.argsort(samples, kind="stable")
    return np.interp(ps, np.cumsum(w[order]) / w.sum(), samples[order])


@pytest.mark.parametrize("limit", [3, None])
def test_distribution(spark, limit):
    r = np.random.default_rng(5)
    groups = {
        "ties": r.integers(1, 6, 200).astype(float), "mixed": np.round(r.normal(0, 10, 301), 1), "zero": np.zeros(9), "negative": -r.random(20),
        "one": np.array([4.5]), "one_negative": np.array([-2.0]), "wide": r.random(500) * 1e6, "two": np.array([1.0, 3.0]),
    }
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k string, x double").repartition(7)
    got = {row["k"]: row["vec"] for row in encode.cdf_encode(df, ["k"], "x", limit).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert len(got[k]) == encode.VECTOR_LENGTH
        np.testing.assert_allclose(got[k][:50], np.percentile(v, encode.PERCENT_POINTS), rtol=1e-9, atol=1e-9, err_msg=k)
        np.testing.assert_allclose(got[k][50:100], weighted(v), rtol=1e-7, atol=1e-7, err_msg=k)
        assert got[k][100] == pytest.approx(v.mean())
        assert all(a <= b + 1e-12 for a, b in zip(got[k][:49], got[k][1:50]))


def test_last_before_hot_key(spark):
    """One key holds nearly everything and spans many segments."""
    df = spark.range(3000).select((F.col("id") % 100 == 0).cast("int").alias("k"), F.col("id").alias("idx"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    got = {r["idx"]: r["p"] for r in last_before(df, ["k"], ["idx"], "v", "p", 13).collect()}
    last = {}
    for i in range(3000):
        k = int(i % 100 == 0)
        assert got[i] == last.get(k)
        if i % 7 == 0:
            last[k] = i


def test_prefix_sum_and_rank(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("idx"))
    sums = {r["idx"]: r["s"] for r in prefix_sum(df, ["k"], ["idx"], "idx", "s", 17).collect()}
    ranks = {r["idx"]: (r["r"], r["n"]) for r in bucketed_rank(df, ["k"], F.floor(F.col("idx") / 11), ["idx"], "r", "n").collect()}
    acc, pos = defaultdict(int), defaultdict(int)
    for i in range(1000):
        k = int(i % 3 == 0)
        assert sums[i] == acc[k]
        assert ranks[i] == (pos[k], 334 if k else 666)
        acc[k] += i
        pos[k] += 1
    h = hash_rank(df, [], ["idx"], 1, "r").select("r").collect()
    assert sorted(r["r"] for r in h) == list(range(1000))
    keyed = df.withColumn("k", F.col("idx") % 3 == 0)
    few, many = (sorted(map(tuple, hash_rank(keyed, ["k"], ["idx"], 1, "r", "n", bucket_rows=rows).select("idx", "r", "n").collect())) for rows in (1 << 18, 7))
    assert few == many and {n for _, _, n in few} == {334, 666}


def test_dim_join_keeps_rows(spark):
    big = spark.range(900).select(F.when(F.col("id") < 600, 1).otherwise(F.col("id") % 5).cast("int").alias("k"), F.lit("same").alias("x"))
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        assert sorted(map(str, dim_join(big, dim, ["k"], how).collect())) == sorted(map(str, big.join(dim, "k", how).collect()))


def test_block_product(spark):
    a, b = spark.range(3).withColumnRenamed("id", "x"), spark.range(50).withColumnRenamed("id", "y")
    for pairs in (None, 10):
        assert {(r["x"], r["y"]) for r in block_product(a, b, ["y"], pairs).collect()} == {(x, y) for x in range(3) for y in range(50)}


def front(points):
    kept, best = [], float("inf")
    for p in sorted(points):
        if p[1] < best:
            kept.append(p)
            best = p[1]
    return kept


@pytest.mark.parametrize("kind", ["random", "line", "same_f0", "copies", "one"])
def test_pareto_front(spark, kind):
    r = random.Random(1)
    pts = {
        "random": [(r.randint(0, 60), r.randint(0, 60)) for _ in range(700)],
        "line": [(i, 400 - i) for i in range(400)],           # every point is on the front
        "same_f0": [(5, r.randint(0, 99)) for _ in range(300)] + [(1, 200), (9, -1)],
        "copies": [(2, 2)] * 300 + [(1, 3), (3, 1), (3, 2)],
        "one": [(1, 1)],
    }[kind]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, a double, b double")
    got = sorted((x["a"], x["b"]) for x in skyline.pareto_front(df, "a", "b", ["id"], buckets=8).collect())
    assert got == front([(float(a), float(b)) for a, b in pts])


def test_pareto_layers(spark):
    r = random.Random(2)
    pts = [(float(r.randint(0, 40)), float(r.randint(0, 40))) for _ in range(400)] + [(0.0, 0.0)] * 12
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pts)], "id int, a double, b double")
    got = skyline.pareto_layers(df, "a", "b", ["id"], 40, buckets=16).collect()
    rest, want, layer = sorted(zip(pts, range(len(pts)))), [], 0
    while len(want) < 40:
        kept, left, best = [], [], float("inf")
        for (a, b), i in rest:
            if b < best:
                kept.append((layer, i))
                best = b
            else:
                left.append(((a, b), i))
        want, rest, layer = want + kept, left, layer + 1
    assert sorted((x["layer"], x["id"]) for x in got) == sorted(want)


def loop_repair(c):
    """Row-by-row repair with the one-step trimming loop."""
    c = dict(c)
    for p in ("fetch_width", "decode_width", "rename_width"):
        c[p] = max(c[p], 3)
    c["decode_width"] = min(c["decode_width"], c["fetch_width"])
    c["rename_width"] = min(c["rename_width"], c["decode_width"])
    c["commit_width"] = min(c["commit_width"], c["rename_width"])
    c["rob_size"] = max(c["rob_size"], min(8 * c["commit_width"], 1024))
    while sum(c[p] for p in design.ISSUE_WIDTHS) > 2 * c["rename_width"]:
        widest = max(design.ISSUE_WIDTHS, key=lambda p: (c[p], -design.ISSUE_WIDTHS.index(p)))
        c[widest] -= 1
    ports = c["read_port_issue_width"] + c["rdwr_port_issue_width"]
    c["lq_entries"], c["sq_entries"] = max(c["lq_entries"], ports), max(c["sq_entries"], ports)
    return c


def test_repair(spark):
    r = random.Random(4)
    configs = [{p: r.choice(v) for p, v in SEARCH_GRID.items()} for _ in range(1500)]
    df = spark.createDataFrame([(i, *[c[p] for p in SEARCH_GRID]) for i, c in enumerate(configs)], ["id", *SEARCH_GRID])
    fixed = design.repair(df)
    assert fixed.filter(~design.is_valid()).count() == 0
    got = {x["id"]: x.asDict() for x in fixed.collect()}
    for i, c in enumerate(configs):
        want = loop_repair(c)
        assert {p: got[i][p] for p in want} == want
    assert design.repair(fixed).select(*fixed.columns).exceptAll(fixed).count() == 0
    assert {x["branch_predictor"] for x in design.repair(df, "tage").collect()} == {"tage"}


def test_cost_of_unknown_predictor_fails(spark):
    df = spark.createDataFrame([tuple("16KiB" if p.endswith("size") and p != "rob_size" else ("gshare" if p == "branch_predictor" else 4) for p in SEARCH_GRID)], list(SEARCH_GRID))
    with pytest.raises(Exception, match="unknown branch predictor"):
        df.select(design.hardware_cost()).collect()


def test_samples(spark):
    n = 500
    s = design.sample_grid(spark, n, 9)
    assert s.count() == n and s.drop("draw").distinct().count() == n
    small = {"a": [1, 2, 3], "b": ["x", "y"]}
    assert design.sample_grid(spark, 6, 9, small).select("a", "b").distinct().count() == 6
    assert design.sample_grid(spark, 5, 9, small).select("a", "b").distinct().count() == 5
    with pytest.raises(ValueError):
        design.sample_grid(spark, 10**21, 9)
    every = design.permute_grid(spark.range(6), "id", 9, small).select("a", "b").distinct()
    assert every.count() == 6
    with pytest.raises(Exception, match="only 6 points"):
        design.permute_grid(spark.range(7), "id", 9, small).collect()
    h = design.latin_hypercube(spark.range(80), "id", 3, {"fetch_width": SEARCH_GRID["fetch_width"], "int_reg_issue_width": list(range(1, 9))})
    counts = [x["count"] for x in h.groupBy("int_reg_issue_width").count().collect()]
    assert counts == [10] * 8  # 80 strata over 8 values


@pytest.mark.parametrize("blocks", [(2, 3), (2048, 1 << 18)])
def test_neighbor_density(spark, blocks):
    r = random.Random(8)
    t = [(r.randint(1, 5), r.randint(1, 9), r.choice("ab")) for _ in range(40)]
    q = [(i, r.randint(1, 5), r.randint(1, 9), r.choice("ab")) for i in range(7)]
    train = spark.createDataFrame(t + t[:10], "x int, y int, c string")
    got = {x["id"]: tuple(x)[1:] for x in similarity.neighbor_density(spark.createDataFrame(q, "id int, x int, y int, c string"), train, "id", ["x", "y"], ["c"], 1, 0.5, *blocks).collect()}
    uniq = sorted(set(t))
    lo, span = [min(u[i] for u in uniq) for i in (0, 1)], [max(u[i] for u in uniq) - min(u[i] for u in uniq) for i in (0, 1)]
    for i, x, y, c in q:
        ham = [(u[0] != x) + (u[1] != y) + (u[2] != c) for u in uniq]
        near = [u[2] == c and (((u[0] - x) / span[0]) ** 2 + ((u[1] - y) / span[1]) ** 2) ** 0.5 <= 0.5 for u in uniq]
        assert lo and got[i] == (min(ham), sum(h <= 1 for h in ham), sum(near))


def test_neighbor_density_at_the_radius(spark):
    """Distances of exactly l2_r count, wherever the two values lie; runs of equal leading columns give the same counts."""
    train = spark.createDataFrame([(x, y, c) for x in range(11) for y in range(40) for c in "ab"], "x int, y int, c string")
    q = spark.createDataFrame([(x, x, 7, "a") for x in range(11)], "id int, x int, y int, c string")
    got = {x["id"]: tuple(x)[1:] for x in similarity.neighbor_density(q, train, "id", ["x", "y"], ["c"], 1, 0.3).collect()}
    for x in range(11):
        near = sum((((x - a) / 10) ** 2 + ((7 - b) / 39) ** 2) ** 0.5 <= 0.3 for a in range(11) for b in range(40))
        assert got[x] == (0, 1 + 10 + 39 + 1, near)


def test_sensitivity_at_the_grid_edge(spark):
    c = {p: v[0] for p, v in SEARCH_GRID.items()} | {"fetch_width": 12, "decode_width": 6, "rename_width": 5, "rob_size": 100, "lq_entries": 50, "sq_entries": 50}
    row = [(1, 1.0, 10.0, *c.values(), *FIXED_PARAMS.values())]
    point = spark.createDataFrame(row, ["pid", "cpi", "cost", *c, *FIXED_PARAMS])

    def evaluate(df, key):
        return df.withColumn("cpi", F.col("_cpi") + F.col("fetch_width") * 0.5).withColumn("cost", F.lit(0.0))

    got = design.sensitivity(point, "pid", evaluate).first()["sensitivity"]
    assert got["fetch_width"]["max_abs_dcpi"] == pytest.approx(5.5)
    assert got["commit_width"]["max_abs_dcost"] == 10.0
    assert "branch_predictor" in got and set(got) <= set(SEARCH_GRID)


def test_required_traces_do_not_shuffle_the_sweep(spark):
    sweep = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 0)], "benchmark string, i int")
    present, missing = sweeps.require_traces(sweep, spark.createDataFrame([("a",), ("a",), (None,)], "benchmark string"), ["benchmark"])
    assert "BroadcastHashJoin" in present._jdf.queryExecution().sparkPlan().toString() and present.count() == 50
    assert [tuple(x) for x in missing.collect()] == [("b", 1)]


def test_value_buckets_of_several_levels(spark):
    """More pieces than one level can make; hot values, nulls and groups that stay whole."""
    values = [float(v) for v in range(5000)] + [7.0] * 300 + [float("nan")] * 9
    rows = [("big", v) for v in values] + [("small", 1.0), ("same", 2.0), ("same", 2.0), ("same", 2.0), (None, 1.0), (None, 2.0), (None, 3.0), ("big", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = value_buckets(df, ["g"], "x", "b", limit=2, fan=8).collect()
    assert len(got) == len(rows)
    assert {r.b for r in got if r.g != "big"} == {0}
    big = sorted(((r.x != r.x, r.x), r.b) for r in got if r.g == "big" and r.x is not None)
    assert [b for _, b in big] == sorted(b for _, b in big)
    pieces = defaultdict(set)
    for x, b in big:
        pieces[b].add(str(x))
    assert len(pieces) > 4096 // 2 and all(len(p) <= 2 for p in pieces.values())
    assert sum(len(p) for p in pieces.values()) == 5001  # equal values are in one piece


def test_first_rows_by_hash_are_those_of_the_ranking(spark):
    """Ranges of the hash that hold no wanted row are dropped before the ranking, in one key, hot keys and none."""
    rows = [(f"b{0 if i % 10 else i % 7}", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "benchmark string, id long").repartition(4)
    for keys, wanted in ((["benchmark"], F.rint(F.col("_size") * 0.03)), ([], F.lit(137)), ([], F.lit(0)), (["benchmark"], F.col("_size"))):
        got = ordered.hash_first(df, keys, ["id"], 5, wanted, 16)
        want = ordered.hash_rank(df, keys, ["id"], 5, "_rank", "_size").filter(F.col("_rank") < wanted)
        assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*df.columns).collect()))
    near = ordered.hash_first(df, [], ["id"], 5, F.lit(137), 16)
    assert "Join" in near._jdf.queryExecution().optimizedPlan().toString().split("Window")[-1]  # ranges are dropped below the window
    whole = [(f"b{i % 3}", i) for i in range(20)]
    sample = splits.stratified_sample(spark.createDataFrame(whole, "benchmark string, id long"), 11, ["id"], 5)
    assert sample.count() == sample.distinct().count() == 11


def test_latin_hypercube_deals_no_row_by_its_dimension(spark, monkeypatch):
    """Hash ranges of a few rows give the strata of one whole ranking, and no shuffle or join goes by the 2 dimensions."""
    grid = {"fetch_width": list(range(1, 8)), "rob_size": list(range(1, 41))}
    ids = [i * 7 for i in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1)
    monkeypatch.setattr(design, "DEALT_ROWS", 100)
    wide = design.latin_hypercube(df, "id", 3, grid, 16)
    digits = lambda i, p: md5(f"{i}|3|{p}".encode()).hexdigest()
    for name, choices in grid.items():
        place = {i: r for r, i in enumerate(sorted(ids, key=lambda i: digits(i, name)))}
        drawn = {i: choices[int((place[i] + int(digits(i, f"{name}|u")[:13], 16) / 2**52) / len(ids) * len(choices))] for i in ids}
        assert {r["id"]: r[name] for r in wide.collect()} == drawn
    plan = design.latin_hypercube(df, "id", 3, grid)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_dim" not in plan and "RoundRobinPartitioning" in plan
    assert design.latin_hypercube(df.filter("id < 0"), "id", 3, grid).count() == 0


def test_held_out_configurations_are_told_without_a_join(spark):
    """The hash of the last chosen configuration decides; a null is in no chosen configuration; the report counts as by hand."""
    rng = random.Random(4)
    rows = [(rng.choice([*range(40), None]), rng.choice("xyz"), f"b{rng.randrange(3)}", rng.randrange(4)) for _ in range(900)]
    df = spark.createDataFrame(rows, "rob int, l2 string, benchmark string, region int")
    distinct = sorted({r[:2] for r in rows}, key=lambda c: md5("|".join([*(str(x) for x in c if x is not None), "9"]).encode()).hexdigest())
    for frac in (0.0, 0.25, 1.0):
        chosen = {c for c in distinct[:int(frac * len(distinct))] if c[0] is not None}
        split = splits.holdout_configs(df, ["rob", "l2"], frac, 9)
        want = sorted([(*r, "test" if r[:2] in chosen else "train") for r in rows], key=str)
        assert sorted(map(tuple, split.select(*df.columns, "part").collect()), key=str) == want
        plan, names = split._jdf.queryExecution().optimizedPlan(), []
        while plan.children().size():  # without what only the scalar needs
            names.append(plan.nodeName())
            plan = plan.children().head()
        assert set(names) <= {"Project"}
    mixed = [(1, "x", "a", 1, "train"), (1, "x", "a", 1, "train"), (1, "x", "a", 1, "test"), (1, "x", "b", 1, "test"), (2, "x", "b", 1, "train"), (3, "y", "c", 2, "test"), (3, "y", "c", 2, "test"), (3, "y", "c", 2, "test")]
    report = splits.leak_report(spark.createDataFrame(mixed, "rob int, l2 string, benchmark string, region int, part string"), ["rob", "l2"], ["benchmark", "region"])
    assert tuple(report.first()) == (1, 2, 1, 1, 2)
    assert "_train_twice" in report._jdf.queryExecution().optimizedPlan().toString()  # rows are added up, not grouped again
    assert tuple(splits.leak_report(split.filter("rob < 0"), ["rob", "l2"], ["benchmark", "region"]).first()) == (0, 0, 0, 0, 0)


def test_sums_of_products_run_as_compiled_methods_in_any_session(spark):
    """The sums of all groups are made under the method limit of this library, whatever the session's own is, which stays."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "65535")
    try:
        df = spark.createDataFrame([(i % 2, float(i), float(i * i % 7), 3.0 * i + i * i % 7) for i in range(40)], "g int, a double, b double, y double")
        out = metrics.ols_r2_by_group(df, ["g"], ["a", "b"], "y")
        assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()  # made already, one row a group
        assert {(r["g"], r["n"], round(r["r2"], 9)) for r in out.collect()} == {(0, 20, 1.0), (1, 20, 1.0)}
        with compiled_methods(spark):
            assert spark.conf.get(limit) == "8000"
        assert spark.conf.get(limit) == "65535"
    finally:
        spark.conf.set(limit, before)


def _joins(spark, df):
    """Physical joins of a plan made while Spark itself may broadcast nothing."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = df._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return text.count("BroadcastHashJoin"), text.count("SortMergeJoin")


def test_lookups_do_not_deal_rows_by_few_keys(spark):
    """A dimension of a few keys is broadcast whatever sizes Spark guesses: no task gets all rows of a benchmark."""
    s = spark.createDataFrame([("a", "16KiB", "32KiB", "1MiB", "tage", 1), ("b", "16KiB", "32KiB", "1MiB", "local", 2)],
                              "benchmark string, l1i_size string, l1d_size string, l2_size string, branch_predictor string, row int")
    prog = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "benchmark string, x double")
    cache = spark.createDataFrame([("a", 16, 32, 1024, 7.0), ("b", 16, 32, 1024, 8.0)], "benchmark string, l1i_kb int, l1d_kb int, l2_kb int, exec_mean double")
    rates = spark.createDataFrame([("a", "tage", 0.1), ("b", "local", 0.2)], "benchmark string, bp_type string, misprediction_rate double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out, n in (
            (sweeps.build_training(s, prog, cache, rates), 3),
            (sweeps.join_predictor_rate(s, rates.filter("bp_type = 'tage'"), default=0.05), 1),
        ):
            assert _joins(spark, out) == (n, 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {r["row"]: (r["misprediction_rate"], r["prog_x"], r["cache_exec_mean"]) for r in sweeps.build_training(s, prog, cache, rates).collect()}
    assert got == {1: (0.1, 1.5, 7.0), 2: (0.2, 2.5, 8.0)}


def _inference_tables(spark):
    configs = spark.createDataFrame(
        [(i, size, "32KiB", "1MiB", bp, 4 * (i % 2), 8, 8, 64) for i, (size, bp) in enumerate([("16KiB", "TAGE"), ("32KiB", "local"), ("16KiB", "none")])],
        "cid int, l1i_size string, l1d_size string, l2_size string, branch_predictor string, stride_prefetcher_degree int, lq_entries int, sq_entries int, rob_size int")
    program = spark.createDataFrame([(t, 10.0 * t) for t in range(3)], "trace_id int, mean_value double")
    names = ", ".join(f"{c} double" for c in design.CACHE_COLUMNS)
    cache = spark.createDataFrame([(t, l1i, 32, 1024, *[float(t + l1i)] * 8) for t in range(3) for l1i in (16, 32)], f"trace_id int, l1i_kb int, l1d_kb int, l2_kb int, {names}")
    rates = spark.createDataFrame([(t, bp, 0.1 * t) for t in range(3) for bp in ("Tage", "local")], "trace_id int, bp_type string, misprediction_rate double")
    return configs, program, cache, rates


def test_inference_rows_are_not_dealt_by_trace(spark):
    configs, program, cache, rates = _inference_tables(spark)
    features = ["rob_size", "prog_mean_value", "cache_exec_mean", "bp_misprediction_rate"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = design.assemble_inference(configs, program, cache, rates, "cid", features)
        assert _joins(spark, out) == (2, 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = sorted(tuple(r) for r in out.collect())
    # A predictor without rates has no rows.
    assert got == sorted((c, t, 64.0, 10.0 * t, float(t + l1i), 0.1 * t) for c, l1i in ((0, 16), (1, 32)) for t in range(3))
    with pytest.raises(Exception, match="cache latency rows are missing"):
        design.assemble_inference(configs, program, cache.filter("trace_id < 2 OR l1i_kb = 32"), rates, "cid", features).collect()


def test_final_front_drops_infeasible_rows_before_copies(spark, monkeypatch):
    """Only feasible rows are compared for copies; the front is the one of the feasible configurations' best rows."""
    r = random.Random(4)
    rows = [(r.randint(0, 9), r.randint(0, 5), float(r.randint(0, 30)), float(r.randint(0, 30))) for _ in range(200)]
    seen, dedup = [], skyline.dedup_rows

    def counted(df, *args):
        seen.append(df.count())
        return dedup(df, *args)

    monkeypatch.setattr(skyline, "dedup_rows", counted)
    df = spark.createDataFrame(rows, "a int, b int, cpi double, cost double")
    got = skyline.final_front([df.filter("b < 3"), df.filter("b >= 3")], ["a", "b"], F.col("a") > 6)
    best = {}
    for a, b, cpi, cost in rows:
        if a > 6:
            best[a, b] = min(best.get((a, b), (cpi, cost)), (cpi, cost))
    points = set(best.values())
    want = sorted(((cpi, cost) for cpi, cost in points if not any(q != (cpi, cost) and q[0] <= cpi and q[1] <= cost for q in points)), key=lambda p: p[1])
    assert [(x.cpi, x.cost) for x in got.collect()] == want
    assert seen == [sum(a > 6 for a, *_ in rows)]
