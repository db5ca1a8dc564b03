"""Error reports, variance, regression and run-log summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import percent_error
from tracemill.operators.ordered import dim_join, last_before, prefix_min
from tracemill.session import compiled_methods, cut_lineage

PATIENCE = 10  # fixed value: epochs without improvement before training stops


def error_report(df: DataFrame, params: list[str], pred: str = "predicted_cpi", actual: str = "cpi") -> DataFrame:
    """Mean percent error and accuracy: overall, per benchmark, per parameter value, per value and benchmark.

    One pass: each row is unpivoted into its parameters (plus one `overall` entry) and
    partially aggregated before the shuffle.
    """
    entries = F.array(
        F.struct(F.lit("overall").alias("param"), F.lit("").alias("value")),
        *[F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("value")) for p in params],
    )
    long = df.select("benchmark", percent_error(pred, actual).alias("e"), F.explode(entries).alias("p")).select("benchmark", "e", "p.*")
    by_benchmark = long.groupBy("param", "value", "benchmark").agg(F.sum("e").alias("s"), F.count(F.lit(1)).alias("n"))
    report = by_benchmark.groupingSets([["param", "value"], ["param", "value", "benchmark"]], "param", "value", "benchmark").agg(
        (F.sum("s") / F.sum("n")).alias("percent_error"), F.sum("n").alias("n")
    )
    return report.withColumn("accuracy", F.lit(100.0) - F.col("percent_error"))


def variance_decomposition(df: DataFrame, x: str = "cpi", group: str = "benchmark") -> DataFrame:
    """Total, between-group and within-group sum of squares and their shares (NaN where nothing varies)."""
    g = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(x)).alias("ss"))
    mean = g.agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("m")).scalar()
    between = F.sum(F.col("n") * F.pow(F.col("m") - mean, F.lit(2.0)))
    out = g.agg(F.sum("n").alias("n"), F.sum("ss").alias("ss_within"), between.alias("ss_between"))
    out = out.withColumn("ss_total", F.col("ss_within") + F.col("ss_between"))
    share = lambda c: F.when(F.col("ss_total") > 0, F.col(c) / F.col("ss_total")).otherwise(F.lit(float("nan")))
    return out.withColumn("between_share", share("ss_between")).withColumn("within_share", share("ss_within"))


def gram(df: DataFrame, columns: list[str], group: list[str] = (), weight: Column | None = None) -> DataFrame:
    """group -> n, gram: all sums of w * a * b over the columns and a constant 1, as one native mergeable aggregate.

    The upper triangle by rows, the constant first; rows with a null in a column are left out. Combined before the shuffle,
    so a group of any size is one row a task.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    one = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    sums = [F.coalesce(F.sum(w * x * y), F.lit(0.0)) for i, x in enumerate(one) for y in one[i:]]
    return df.dropna(subset=list(columns)).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("gram"))


def gram_matrix(values: Sequence[float], size: int) -> np.ndarray:
    """The symmetric matrix of (constant, columns...) from its upper triangle."""
    upper = np.zeros((size + 1, size + 1))
    upper[np.triu_indices(size + 1)] = values
    return upper + np.triu(upper, 1).T


def least_squares(values: Sequence[float], features: int) -> tuple[np.ndarray, float, float]:
    """Coefficients, intercept and R² from the gram of (features..., label).

    Features that depend on others share their effect (the solution of least norm), which leaves R² defined. NaN for a
    constant label.
    """
    full = gram_matrix(values, features + 1)
    mean = full[0, 1:] / full[0, 0]
    centred = full[1:, 1:] - full[0, 0] * np.outer(mean, mean)
    xx, xy, yy = centred[:-1, :-1], centred[:-1, -1], centred[-1, -1]
    scale = np.sqrt(np.clip(np.diag(xx), 0.0, None))
    scale[scale <= 1e-9 * np.sqrt(np.abs(np.diag(full)[1:-1]) + 1e-300)] = np.inf  # a constant feature has no effect
    beta = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=1e-10)[0] / scale
    r2 = float(beta @ xy / yy) if yy > 1e-12 * abs(full[-1, -1]) else float("nan")
    return beta, float(mean[-1] - beta @ mean[:-1]), r2


def _spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns around their mean in units of their deviation, which keeps sums of squares exact enough."""
    moments = df.dropna(subset=list(columns)).agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    with compiled_methods(df.sparkSession):
        stats = moments.first()
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(stats[f"m{i}"] or 0.0)) / F.lit(stats[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def ols_r2(df: DataFrame, features: list[str], label: str = "cpi") -> float:
    """R² of a linear regression with intercept over all features, from one Gram matrix.

    Too few complete rows fail; a constant label gives NaN; dependent features are allowed.
    """
    columns = [*features, label]
    sums = gram(_spread(df.select(*columns), columns), columns)
    with compiled_methods(df.sparkSession):
        row = sums.first()
    if row is None or row["n"] < len(features) + 1:
        raise ValueError(f"{row['n'] if row else 0} rows are too few for {len(features)} features")
    return least_squares(row["gram"], len(features))[2]


def ols_r2_by_group(df: DataFrame, group: list[str], features: list[str], label: str = "cpi") -> DataFrame:
    """group -> n, r2 of a regression over all features in each group; NaN where rows are too few or the label is constant."""
    columns, least = [*features, label], len(features) + 1

    @F.pandas_udf("double")
    def r2(n: pd.Series, grams: pd.Series) -> pd.Series:
        return pd.Series([least_squares(g, len(features))[2] if rows >= least else float("nan") for rows, g in zip(n, grams, strict=True)], dtype="float64")

    with compiled_methods(df.sparkSession):
        sums = cut_lineage(gram(_spread(df.select(*group, *columns), columns), columns, group))
    return sums.select(*group, "n", F.coalesce(r2("n", "gram"), F.lit(float("nan"))).alias("r2"))  # one small matrix a group goes to Python


def r2_by_group(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """R² of a one-feature regression per group, as a built-in aggregate."""
    return df.groupBy(*group).agg(F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def dataset_profile(df: DataFrame, config: list[str], region: str = "region") -> dict[str, DataFrame]:
    """Rows per configuration (histogram), regions and rows per benchmark, number of configurations."""
    per_config = df.groupBy(*config).agg(F.count(F.lit(1)).alias("n_rows"))
    per_region = df.groupBy("benchmark", region).agg(F.count(F.lit(1)).alias("n"))
    return {
        "config_histogram": per_config.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_configs")),
        "benchmarks": per_region.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n_regions"), F.sum("n").alias("n_rows")),
        "configs": per_config.agg(F.count(F.lit(1)).alias("n_configs")),
    }


def mean_by_config(df: DataFrame, config: list[str], x: str = "cpi") -> DataFrame:
    return df.groupBy(*config).agg(F.avg(x).alias(x))


def _one_row_stats(df: DataFrame, aggs: list[Column]) -> Column:
    return df.agg(F.struct(*aggs).alias("s")).scalar()


def minmax_scale(fit: DataFrame, apply: DataFrame, cols: list[str]) -> DataFrame:
    """[0, 1] by the ranges of `fit`; a constant column is divided by 1."""
    aggs = [f(c).cast("double").alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]
    out = apply.withColumn("_s", _one_row_stats(fit, aggs))
    scaled = {}
    for c in cols:
        lo, hi = F.col(f"_s.lo_{c}"), F.col(f"_s.hi_{c}")
        scaled[c] = (F.col(c) - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return out.withColumns(scaled).drop("_s")


def standard_scale(fit: DataFrame, apply: DataFrame, cols: list[str]) -> DataFrame:
    """Zero mean and unit population deviation by `fit`; a constant column is divided by 1.

    The statistics are one row, so they enter as a scalar subquery and nothing is shuffled.
    """
    aggs = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("d", F.stddev_pop))]
    out = apply.withColumn("_s", _one_row_stats(fit, aggs))
    scaled = {}
    for c in cols:
        dev = F.col(f"_s.d_{c}")
        scaled[c] = (F.col(c) - F.col(f"_s.m_{c}")) / F.when(dev > 0, dev).otherwise(F.lit(1.0))
    return out.withColumns(scaled).drop("_s")


def best_epoch(metrics: DataFrame, patience: int = PATIENCE, segment_rows: int | None = None) -> DataFrame:
    """Per run: best epoch, its loss and error, and the epoch at which training stops early."""
    seen = prefix_min(metrics, ["run_id"], ["epoch"], "eval_loss", "_before", segment_rows)
    improved = F.col("_before").isNull() | (F.col("eval_loss") < F.col("_before"))
    marked = seen.withColumn("_imp", F.when(improved, F.col("epoch"))).drop("_before")
    gaps = last_before(marked, ["run_id"], ["epoch"], "_imp", "_last", segment_rows)
    gap = F.col("epoch") - F.coalesce("_imp", "_last")
    stops = gaps.groupBy("run_id").agg(F.min(F.when(gap >= patience, F.col("epoch"))).alias("stop_epoch"), F.max("epoch").alias("n_epochs"))
    within = dim_join(metrics, stops, ["run_id"], "inner").filter(F.col("epoch") <= F.coalesce("stop_epoch", "n_epochs"))
    order = F.struct("eval_loss", "epoch")
    return within.groupBy("run_id").agg(
        F.min_by("epoch", order).alias("best_epoch"), F.min("eval_loss").alias("best_eval_loss"),
        F.min_by("percent_error", order).alias("best_percent_error"),
        F.max_by("percent_error", "epoch").alias("final_percent_error"), F.first("stop_epoch").alias("stop_epoch"),
    )


def error_grid(df: DataFrame, rows: str, columns: str, value: str, column_values: list) -> DataFrame:
    """Row split x column split -> error; missing cells are NULL."""
    return df.groupBy(rows).pivot(columns, column_values).agg(F.first(value, ignorenulls=True)).orderBy(rows)


def compare_runs(a: DataFrame, b: DataFrame, on: list[str] = ("benchmark",), value: str = "percent_error") -> DataFrame:
    """Errors of two runs side by side; a benchmark missing from one side gets NaN."""
    nan = F.lit(float("nan"))
    left = a.select(*on, F.col(value).alias("a_error"))
    right = b.select(*on, F.col(value).alias("b_error"))
    return left.join(right, list(on), "full").select(*on, F.coalesce("a_error", nan).alias("a_error"), F.coalesce("b_error", nan).alias("b_error"))


def run_summary(metrics: DataFrame) -> DataFrame:
    """One row per run from its metrics record and output path, best error first and missing last.

    The path ends in `mask_<bits>_<label>[/tts_<share>]` or `extra_<label>[...]`.
    """
    path = F.regexp_replace("path", r"/[^/]*\.json$", "")
    tts = F.regexp_extract(path, r"/tts_([^/]+)$", 1)
    run = F.regexp_extract(F.regexp_replace(path, r"/tts_[^/]+$", ""), r"([^/]+)$", 1)
    masked = run.startswith("mask_")
    mask = F.when(masked, F.regexp_extract(run, r"^mask_([^_]*)", 1)).otherwise(F.lit("extra"))
    label = F.when(masked, F.regexp_extract(run, r"^mask_[^_]*_(.*)$", 1)).otherwise(F.regexp_replace(run, "^extra_", ""))
    label = F.when(tts != "", F.concat(label, F.lit("_tts"), tts)).otherwise(label)
    keep = [c for c in ("num_features", "best_eval_loss", "best_percent_error", "drop_cache_cdf_features", "drop_stale_features", "drop_all_features") if c in metrics.columns]
    known = metrics.filter(run.startswith("mask_") | run.startswith("extra_"))
    return known.select(mask.alias("mask"), label.alias("label"), tts.alias("tts"), *keep).orderBy(F.asc_nulls_last("best_percent_error"), "label")


def ablation_report(runs: DataFrame, n_rows: int | Column) -> DataFrame:
    """Training size and best error per label group: the label before its split suffix."""
    group = F.split("label", "_tts0.")[0]
    size = F.floor((n_rows if isinstance(n_rows, Column) else F.lit(n_rows)) * (F.lit(1.0) - F.col("tts").cast("double")) + F.lit(1e-9)).cast("bigint")
    return runs.withColumn("label_group", group).withColumn("training_size", size).groupBy("label_group", "training_size").agg(
        F.min("best_percent_error").alias("best_percent_error")
    )


def compare_pareto(predicted: DataFrame, results: DataFrame, config: list[str]) -> DataFrame:
    """Predicted points with their mean simulated CPI and the percent error."""
    actual = mean_by_config(results, config)
    joined = dim_join(predicted, actual, config, "left")
    return joined.withColumn("error", F.abs(F.col("predicted_cpi") - F.col("cpi")) / F.col("cpi") * 100.0)


def append_predictions(df: DataFrame, prediction: Column, name: str = "Predicted CPI") -> DataFrame:
    return df.withColumn(name, prediction)


def predictions_table(df: DataFrame, ids: list[str], actual: str = "cpi", predicted: str = "predicted_cpi") -> DataFrame:
    return df.select(*ids, F.col(actual).alias("actual_cpi"), F.col(predicted).alias("predicted_cpi"))


