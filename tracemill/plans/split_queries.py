"""Queries over splits, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import splits
from tracemill.plans import bindings as b
from tracemill.plans.catalog import query, rounded

WITH_S = f"WITH {b.S_SQL}"
KEY = b.SWEEP_KEY
KEYS = ", ".join(KEY)
CFG = b.SWEEP_CONFIG
CFGS = ", ".join(CFG)
SEED = 42


def md5(cols: list[str], seed) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + f", '{seed}'))"


@query(
    "h6_random_split",
    f"""{WITH_S}, r AS (SELECT {KEYS}, row_number() OVER (ORDER BY {md5(KEY, SEED)}, {KEYS}) - 1 AS rk, count(*) OVER () AS n FROM s)
      SELECT {KEYS}, CASE WHEN rk < ceil(0.25E0 * n) THEN 'test' ELSE 'train' END AS part FROM r""",
)
def _(spark, sf_dir):
    return splits.random_split(b.sweep(spark, sf_dir), KEY, 0.25, SEED).select(*KEY, "part")


@query(
    "h6_threshold_split",
    f"""{WITH_S} SELECT {KEYS}, CASE WHEN CAST(('0x' || substr({md5(KEY, SEED)}, 1, 13)) AS BIGINT) / 4503599627370496.0E0 < 0.25E0 THEN 'test' ELSE 'train' END AS part FROM s""",
)
def _(spark, sf_dir):
    return splits.random_split(b.sweep(spark, sf_dir), KEY, 0.25, SEED, exact=False).select(*KEY, "part")


HELD_CFG = f"""hc AS (SELECT {CFGS} FROM (SELECT *, row_number() OVER (ORDER BY {md5(CFG, SEED)}, {CFGS}) - 1 AS rk, count(*) OVER () AS n
  FROM (SELECT DISTINCT {CFGS} FROM s)) WHERE rk < floor(0.25E0 * n))"""
HELD_REG = f"""hr AS (SELECT benchmark, region FROM (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY {md5(['benchmark', 'region'], SEED)}) - 1 AS rk,
  count(*) OVER (PARTITION BY benchmark) AS n FROM (SELECT DISTINCT benchmark, region FROM s)) WHERE rk < floor(0.25E0 * n))"""


@query("h7_holdout_configs", f"{WITH_S}, {HELD_CFG} SELECT {KEYS}, 'test' AS part FROM s SEMI JOIN hc USING ({CFGS}) UNION ALL SELECT {KEYS}, 'train' FROM s ANTI JOIN hc USING ({CFGS})")
def _(spark, sf_dir):
    return splits.holdout_configs(b.sweep(spark, sf_dir), CFG, 0.25, SEED).select(*KEY, "part")


@query("h8_holdout_regions", f"{WITH_S}, {HELD_REG} SELECT {KEYS}, 'test' AS part FROM s SEMI JOIN hr USING (benchmark, region) UNION ALL SELECT {KEYS}, 'train' FROM s ANTI JOIN hr USING (benchmark, region)")
def _(spark, sf_dir):
    return splits.holdout_regions(b.sweep(spark, sf_dir), 0.25, SEED).select(*KEY, "part")


@query(
    "h8_holdout_both",
    f"""{WITH_S}, {HELD_CFG}, {HELD_REG} SELECT {KEYS}, 'test' AS part FROM s SEMI JOIN hr USING (benchmark, region) SEMI JOIN hc USING ({CFGS})
      UNION ALL SELECT {KEYS}, 'train' FROM s ANTI JOIN hr USING (benchmark, region) ANTI JOIN hc USING ({CFGS})""",
)
def _(spark, sf_dir):
    return splits.holdout_both(b.sweep(spark, sf_dir), CFG, 0.25, 0.25, SEED).select(*KEY, "part")


@query(
    "h9_holdout_benchmark",
    f"""{WITH_S}, r AS (SELECT {KEYS}, row_number() OVER (ORDER BY {md5(KEY, SEED)}, {KEYS}) - 1 AS rk FROM s WHERE benchmark = 'b3')
      SELECT {KEYS}, 'train' AS part FROM s WHERE benchmark <> 'b3' UNION ALL SELECT {KEYS}, CASE WHEN rk < 100 THEN 'train' ELSE 'test' END FROM r""",
)
def _(spark, sf_dir):
    return splits.holdout_benchmark(b.sweep(spark, sf_dir), "b3", KEY, onboard=100, seed=SEED).select(*KEY, "part")


@query(
    "h10_single_benchmark_split",
    f"""{WITH_S}, r AS (SELECT {KEYS}, row_number() OVER (ORDER BY {md5(KEY, SEED)}, {KEYS}) - 1 AS rk, count(*) OVER () AS n FROM s WHERE benchmark = 'b3')
      SELECT {KEYS}, 'train' AS part FROM s WHERE benchmark IN ('b1', 'b2') UNION ALL SELECT {KEYS}, CASE WHEN rk < ceil(0.25E0 * n) THEN 'test' ELSE 'train' END FROM r""",
)
def _(spark, sf_dir):
    return splits.single_benchmark_split(b.sweep(spark, sf_dir), "b3", KEY, 0.25, SEED, others=["b1", "b2", "b3"]).select(*KEY, "part")


@query("h11_one_config_per_region", f"{WITH_S} SELECT benchmark, region, {KEYS} FROM s QUALIFY row_number() OVER (PARTITION BY benchmark, region ORDER BY {md5(KEY, SEED)}, {KEYS}) = 1")
def _(spark, sf_dir):
    return splits.one_config_per_region(b.sweep(spark, sf_dir), KEY, SEED).select("benchmark", "region", *KEY)


@query(
    "h12_one_region_per_benchmark",
    f"""{WITH_S}, r AS (SELECT benchmark, region FROM (SELECT DISTINCT benchmark, region FROM s) QUALIFY row_number() OVER (PARTITION BY benchmark ORDER BY {md5(['benchmark', 'region'], SEED)}) = 1)
      SELECT benchmark, region, {KEYS} FROM s SEMI JOIN r USING (benchmark, region)""",
)
def _(spark, sf_dir):
    return splits.one_region_per_benchmark(b.sweep(spark, sf_dir), SEED).select("benchmark", "region", *KEY)


@query(
    "h13_stratified_sample",
    f"""{WITH_S}, r AS (SELECT benchmark, {KEYS}, row_number() OVER (PARTITION BY benchmark ORDER BY {md5(KEY, SEED)}, {KEYS}) - 1 AS rk,
        count(*) OVER (PARTITION BY benchmark) AS n, least(1.0E0, 1003.0E0 / count(*) OVER ()) AS share FROM s),
      f AS (SELECT *, rk < round_even(share * n, 0) AS picked FROM r),
      u AS (SELECT *, row_number() OVER (ORDER BY {md5(KEY, SEED + 1)}, {KEYS}) - 1 AS rr FROM f WHERE NOT picked)
      SELECT benchmark, {KEYS} FROM f WHERE picked UNION ALL SELECT benchmark, {KEYS} FROM u WHERE rr < 1003 - (SELECT count(*) FROM f WHERE picked)""",
)
def _(spark, sf_dir):
    return splits.stratified_sample(b.sweep(spark, sf_dir), 1003, KEY, SEED).select("benchmark", *KEY)


BINS = 8
_EDGES = f"ed AS (SELECT list_distinct(quantile_cont(cpi, [{', '.join(str(i / BINS) + 'E0' for i in range(BINS + 1))}])) AS e FROM s)"
BIN_SQL = f"{_EDGES}, bn AS (SELECT *, greatest(len(list_filter((SELECT e FROM ed), lambda x: x < cpi)) - 1, 0) AS bin FROM s)"


@query("e11_quantile_bins", f"{WITH_S}, {BIN_SQL} SELECT {KEYS}, CAST(bin AS INT) AS bin FROM bn")
def _(spark, sf_dir):
    return splits.quantile_bins(b.sweep(spark, sf_dir), "cpi", BINS).select(*KEY, "bin")


@query("e11_quantile_edges", f"{WITH_S}, {_EDGES} SELECT round(unnest(e), 4) AS edge FROM ed")
def _(spark, sf_dir):
    return rounded(splits.quantile_edges(b.sweep(spark, sf_dir), "cpi", BINS).select(F.explode("edges").alias("edge")), 4)


@query(
    "h14_stratified_split",
    f"""{WITH_S}, {BIN_SQL}, r AS (SELECT {KEYS}, row_number() OVER (PARTITION BY bin ORDER BY {md5(KEY, SEED)}, {KEYS}) - 1 AS rk, count(*) OVER (PARTITION BY bin) AS n FROM bn)
      SELECT {KEYS}, CASE WHEN rk < ceil(0.25E0 * n) THEN 'test' ELSE 'train' END AS part FROM r""",
)
def _(spark, sf_dir):
    return splits.stratified_split(b.sweep(spark, sf_dir), "cpi", BINS, 0.25, KEY, SEED).select(*KEY, "part")


def _dups(rows: str) -> str:
    return f"(SELECT count(*) - count(DISTINCT ({CFGS}, benchmark, region)) FROM {rows})"


@query(
    "h15_leak_report",
    f"""{WITH_S}, {HELD_CFG}, te AS (SELECT s.* FROM s SEMI JOIN hc USING ({CFGS})), tr AS (SELECT s.* FROM s ANTI JOIN hc USING ({CFGS}))
      SELECT {_dups('tr')} AS train_duplicates, {_dups('te')} AS test_duplicates,
        (SELECT count(*) FROM (SELECT {CFGS}, benchmark, region FROM tr INTERSECT SELECT {CFGS}, benchmark, region FROM te)) AS shared_rows,
        (SELECT count(*) FROM (SELECT {CFGS} FROM tr INTERSECT SELECT {CFGS} FROM te)) AS shared_configs,
        (SELECT count(*) FROM (SELECT benchmark, region FROM tr INTERSECT SELECT benchmark, region FROM te)) AS shared_regions""",
)
def _(spark, sf_dir):
    return splits.leak_report(splits.holdout_configs(b.sweep(spark, sf_dir), CFG, 0.25, SEED), CFG, ["benchmark", "region"])


@query(
    "h16_ablation_runs",
    f"""{WITH_S}, bm AS (SELECT DISTINCT benchmark FROM s), g AS (SELECT * FROM (VALUES (0, 'keep_all', 0), (1, 'drop_cache_cdf_features', 1), (2, 'drop_stale_features', 1),
        (3, 'drop_cache_cdf_features+stale_features', 2)) v(mask, label, n_dropped))
      SELECT benchmark, mask, label, n_dropped, tts, onboard FROM bm, g, (VALUES (0.25E0), (0.5E0), (0.9E0)) t(tts), (VALUES (0), (128), (1024)) o(onboard)""",
)
def _(spark, sf_dir):
    base = b.sweep(spark, sf_dir).select("benchmark").distinct()
    runs = splits.run_matrix(base, {"tts": [0.25, 0.5, 0.9], "onboard": [0, 128, 1024]}, ["cache_cdf_features", "stale_features"])
    return runs.withColumn("n_dropped", F.size("dropped")).drop("dropped")


@query(
    "h16_conflict_pairs",
    f"""{WITH_S} SELECT DISTINCT x.benchmark, y.benchmark AS partner FROM s x JOIN s y ON x.l_suppkey = y.l_suppkey + 1 AND x.l_orderkey = y.l_orderkey""",
)
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    y = s.select(F.col("benchmark").alias("partner"), (F.col("l_suppkey") + 1).alias("l_suppkey"), "l_orderkey")
    pairs = s.join(y, ["l_suppkey", "l_orderkey"]).select("benchmark", "partner").distinct()
    return splits.conflict_pairs(s, pairs)


@query("g1_union", f"{WITH_S} SELECT {KEYS}, 'low' AS origin FROM s WHERE region < 25 UNION ALL SELECT {KEYS}, 'high' FROM s WHERE region >= 10")
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    low = s.filter(F.col("region") < 25).select(*KEY, F.lit("low").alias("origin"))
    return splits.stack([low, s.filter(F.col("region") >= 10).select(*KEY, F.lit("high").alias("origin"))])


@query("g2_distinct", f"{WITH_S} SELECT DISTINCT {CFGS} FROM s")
def _(spark, sf_dir):
    return b.sweep(spark, sf_dir).select(*CFG).distinct()


@query("g3_intersect", f"{WITH_S} SELECT {CFGS} FROM s WHERE region < 25 INTERSECT SELECT {CFGS} FROM s WHERE region >= 25")
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    return splits.intersect_keys(s.filter(F.col("region") < 25), s.filter(F.col("region") >= 25), CFG)


@query("g4_except", f"{WITH_S}, {HELD_REG} SELECT {KEYS} FROM s ANTI JOIN hr USING (benchmark, region)")
def _(spark, sf_dir):
    s = b.sweep(spark, sf_dir)
    return splits.except_rows(s, splits.chosen_regions(s, 0.25, SEED), ["benchmark", "region"]).select(*KEY)


@query("f5_first_rows", "SELECT o_orderkey + 1 AS row_id, o_custkey FROM orders WHERE o_orderkey < 500")
def _(spark, sf_dir):
    from tracemill.operators.skyline import first_rows
    orders = b.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("row_id"), "o_custkey")
    return first_rows(orders, "row_id", 500)
