"""Queries over training runs and their logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import metrics
from tracemill.plans import bindings as b
from tracemill.plans.catalog import query, rounded
from tracemill.sources import runs

WITH_R = f"WITH {b.R_SQL}"


@query(
    "d31_best_epoch",
    f"""{WITH_R}, i AS (SELECT *, min(eval_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
      g AS (SELECT *, epoch - max(CASE WHEN before IS NULL OR eval_loss < before THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS gap FROM i),
      st AS (SELECT run_id, min(epoch) FILTER (gap >= 10) AS stop_epoch FROM g GROUP BY ALL)
      SELECT r.run_id, arg_min(epoch, (eval_loss, epoch)) AS best_epoch, min(eval_loss) AS best_eval_loss, round(arg_min(percent_error, (eval_loss, epoch)), 6) AS best_percent_error,
        round(arg_max(percent_error, epoch), 6) AS final_percent_error, any_value(stop_epoch) AS stop_epoch FROM r JOIN st USING (run_id) WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY r.run_id""",
)
def _(spark, sf_dir):
    return rounded(metrics.best_epoch(b.runs(spark, sf_dir)))


@query(
    "d32_error_grid",
    f"""{WITH_R}, x AS (SELECT run_id % 5 AS region_split, epoch % 4 AS config_split, avg(percent_error) AS e FROM r WHERE (run_id + epoch) % 7 <> 0 OR run_id % 5 <> 2 GROUP BY ALL)
      SELECT region_split, round(max(e) FILTER (config_split = 0), 4) AS "0", round(max(e) FILTER (config_split = 1), 4) AS "1", round(max(e) FILTER (config_split = 2), 4) AS "2", round(max(e) FILTER (config_split = 3), 4) AS "3"
      FROM x GROUP BY ALL""",
)
def _(spark, sf_dir):
    r = b.runs(spark, sf_dir).filter(((F.col("run_id") + F.col("epoch")) % 7 != 0) | (F.col("run_id") % 5 != 2))
    e = r.groupBy((F.col("run_id") % 5).alias("region_split"), (F.col("epoch") % 4).alias("config_split")).agg(F.avg("percent_error").alias("e"))
    return rounded(metrics.error_grid(e, "region_split", "config_split", "e", [0, 1, 2, 3]), 4)


def _records(spark, sf_dir):
    """Run records with output paths, derived from the orders."""
    r = b.runs(spark, sf_dir)
    per = r.groupBy("run_id", (F.col("epoch") % 4).alias("q")).agg(F.min("eval_loss").alias("best_eval_loss"), F.min("percent_error").alias("best_percent_error"), F.count(F.lit(1)).cast("int").alias("num_features"))
    label = F.when(F.col("run_id") % 3 == 0, "keep_all").when(F.col("run_id") % 3 == 1, "drop_stale_features").otherwise("drop_cache_cdf_features+stale_features")
    folder = F.when(F.col("run_id") % 5 == 4, F.lit("extra_drop_all_features")).otherwise(F.concat(F.lit("mask_"), F.lpad(F.col("run_id").cast("string"), 2, "0"), F.lit("_"), label))
    tts = F.when(F.col("q") == 0, "").otherwise(F.concat(F.lit("/tts_0."), F.col("q").cast("string")))
    return per.select("best_eval_loss", "best_percent_error", "num_features", F.concat(F.lit("/out/sweep/"), folder, tts, F.lit("/metrics.json")).alias("path"))


_SUMMARY = f"""{WITH_R}, pe AS (SELECT run_id, epoch % 4 AS q, min(eval_loss) AS best_eval_loss, min(percent_error) AS best_percent_error, CAST(count(*) AS INT) AS num_features FROM r GROUP BY ALL),
  rs AS (SELECT CASE WHEN run_id % 5 = 4 THEN 'extra' ELSE lpad(CAST(run_id AS VARCHAR), 2, '0') END AS mask,
    CASE WHEN run_id % 5 = 4 THEN 'drop_all_features' WHEN run_id % 3 = 0 THEN 'keep_all' WHEN run_id % 3 = 1 THEN 'drop_stale_features' ELSE 'drop_cache_cdf_features+stale_features' END
      || CASE q WHEN 0 THEN '' ELSE '_tts0.' || CAST(q AS VARCHAR) END AS label, CASE q WHEN 0 THEN '' ELSE '0.' || CAST(q AS VARCHAR) END AS tts, num_features, best_eval_loss, best_percent_error FROM pe)"""


@query("d35_run_summary", f"{_SUMMARY} SELECT mask, label, tts, num_features, best_eval_loss, round(best_percent_error, 6) AS best_percent_error FROM rs")
def _(spark, sf_dir):
    return rounded(metrics.run_summary(_records(spark, sf_dir)))


@query(
    "i5_ablation_report",
    f"""{_SUMMARY} SELECT string_split(label, '_tts0.')[1] AS label_group, CAST(floor((SELECT count(*) FROM lineitem) * (1.0E0 - CAST(tts AS DOUBLE)) + 1e-9) AS BIGINT) AS training_size, round(min(best_percent_error), 6) AS best_percent_error
      FROM rs WHERE tts <> '' GROUP BY ALL""",
)
def _(spark, sf_dir):
    s = metrics.run_summary(_records(spark, sf_dir)).filter(F.col("tts") != "")
    return rounded(metrics.ablation_report(s, b.table(spark, sf_dir, "lineitem").select(F.count(F.lit(1)).alias("n")).scalar()))


# Run summaries as text in each of the five block layouts. A log holds 64 orders by
# key, so its text is bounded whatever the distribution of the orders.
def _log(spark, sf_dir, block):
    o = b.table(spark, sf_dir, "orders").withColumn("run", F.floor(F.col("o_orderkey") / 64))
    lines = o.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("t")))).alias("x"))
    return lines.select("run", F.array_join(F.transform("x", lambda s: s["t"]), "\n").alias("value"))



def _pct():
    return (F.col("o_orderkey") % 9973).cast("string")


_FIELDS = "CAST(o_orderkey % 9973 AS DOUBLE) AS percent_error"
_POS = "CAST(row_number() OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) - 1 AS INT) AS pos, CAST(o_orderkey // 64 AS BIGINT) AS run"
_BENCH = "'b' || CAST(o_orderkey % 9 AS VARCHAR) AS benchmark"


def _bench():
    return F.concat(F.lit("b"), (F.col("o_orderkey") % 9).cast("string"))


@query("a9_log_splits", f"SELECT {_POS}, CAST('0.' || CAST(o_orderkey % 8 AS VARCHAR) AS DOUBLE) AS region_split, CAST('0.' || CAST(o_custkey % 8 AS VARCHAR) AS DOUBLE) AS config_split, {_FIELDS} FROM orders")
def _(spark, sf_dir):
    block = F.concat(
        F.lit("Test regions split: 0."), (F.col("o_orderkey") % 8).cast("string"), F.lit(" - Test configs split: 0."), (F.col("o_custkey") % 8).cast("string"),
        F.lit("\n  Final Percent Error: "), _pct(), F.lit("%\n"),
    )
    return runs.parse_run_log(_log(spark, sf_dir, block), "splits", keep=["run"])


@query("a9_log_out_of_distribution", f"SELECT {_POS}, {_BENCH}, {_FIELDS} FROM orders")
def _(spark, sf_dir):
    block = F.concat(F.lit("Out-of-distribution benchmark: "), _bench(), F.lit("\n  Final Percent Error: "), _pct(), F.lit("%"))
    return runs.parse_run_log(_log(spark, sf_dir, block), "out_of_distribution", keep=["run"])


@query("a9_log_onboarding", f"SELECT {_POS}, {_BENCH}, CAST(o_custkey AS INT) AS train_size, {_FIELDS} FROM orders")
def _(spark, sf_dir):
    block = F.concat(F.lit("Out-of-distribution benchmark: "), _bench(), F.lit(" | OOD train size: "), F.col("o_custkey").cast("string"), F.lit("\n  Final Percent Error: "), _pct(), F.lit("%"))
    return runs.parse_run_log(_log(spark, sf_dir, block), "onboarding", keep=["run"])


@query("a9_log_single", f"SELECT {_POS}, {_BENCH}, {_FIELDS} FROM orders")
def _(spark, sf_dir):
    block = F.concat(F.lit("Benchmark: "), _bench(), F.lit("\n  Final Percent Error: "), _pct(), F.lit("%"))
    return runs.parse_run_log(_log(spark, sf_dir, block), "single", keep=["run"])


@query("a9_log_experiment", f"SELECT {_POS}, 'e' || CAST(o_orderkey % 3 AS VARCHAR) AS experiment, {_BENCH}, CAST(o_custkey AS INT) AS train_size, {_FIELDS} FROM orders")
def _(spark, sf_dir):
    block = F.concat(
        F.lit("Run out/experiment_e"), (F.col("o_orderkey") % 3).cast("string"), F.lit("/x\n  status: ok\n  ood_benchmark: "), _bench(), F.lit("\n  ood_train_size: "),
        F.col("o_custkey").cast("string"), F.lit("\n  epochs: 5\n  percent_error: "), _pct(),
    )
    return runs.parse_run_log(_log(spark, sf_dir, block), "experiment", keep=["run"])
