"""Run metrics, run logs and design-space reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.registry import FIXED_PARAMS, SEARCH_GRID
from tracemill.functions.scalars import must

RUN_SCHEMA = """total_duration double, num_features int, best_eval_loss double, best_percent_error double,
  ablation_flags struct<drop_cache_cdf_features: boolean, drop_stale_features: boolean, drop_all_features: boolean>,
  epochs array<struct<duration: double, train_loss: double, eval_loss: double, percent_error: double>>"""


def read_run_records(spark: SparkSession, glob: str) -> DataFrame:
    """One row per metrics file: its path, totals and ablation flags as 0/1."""
    raw = spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(glob).select("*", F.col("_metadata.file_path").alias("path"))
    flags = ["drop_cache_cdf_features", "drop_stale_features", "drop_all_features"]
    return raw.select(
        "path", "total_duration", "num_features", "best_eval_loss", "best_percent_error",
        *[F.coalesce(F.col(f"ablation_flags.{f}").cast("int"), F.lit(0)).alias(f) for f in flags], "epochs",
    )


def read_run_metrics(spark: SparkSession, glob: str) -> DataFrame:
    """(path, run_id, epoch from 1, duration, train_loss, eval_loss, percent_error)."""
    # The name is cut out of the path once a file, below the explode, not once an epoch.
    records = read_run_records(spark, glob).select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run_id"), "epochs")
    rows = records.select("path", "run_id", F.posexplode("epochs").alias("pos", "e"))
    return rows.select("path", "run_id", (F.col("pos") + 1).alias("epoch"), "e.*")


# The five block layouts of run summaries. Field name -> capture group.
_ERROR = r"[^\n]*: ([0-9.eE+-]+)%?[^\n]*"
LOG_LAYOUTS: dict[str, tuple[str, list[str]]] = {
    "splits": (r"Test regions split: ([0-9.]+) - Test configs split: ([0-9.]+)\n  Final Percent Error: ([0-9.]+)%", ["region_split", "config_split", "percent_error"]),
    "onboarding": (r"Out-of-distribution benchmark: ([^|\n]+?) *\| OOD train size: (\d+)[^\n]*\n" + _ERROR, ["benchmark", "train_size", "percent_error"]),
    "out_of_distribution": (r"Out-of-distribution benchmark: ([^|\n]+?) *\n" + _ERROR, ["benchmark", "percent_error"]),
    "single": (r"(?<!distribution b)(?<!distribution )Benchmark: ([^\n]+?) *\n[^\n]*Final Percent Error: ([0-9.]+)%", ["benchmark", "percent_error"]),
    "experiment": (
        r"Run[^\n]*experiment_([^/\n]+)/[^\n]*\n[^\n]*\n[^\n]*?: ([^\n]+?) *\n[^\n]*?: (\d+)[^\n]*\n[^\n]*\n[^\n]*?: ([0-9.eE+-]+)[^\n]*",
        ["experiment", "benchmark", "train_size", "percent_error"],
    ),
}
LOG_TYPES = {"percent_error": "double", "region_split": "double", "config_split": "double", "train_size": "int"}


def parse_run_log(logs: DataFrame, layout: str, text: str = "value", keep: list[str] = ()) -> DataFrame:
    """Blocks of a run summary (one text per row) -> one row per block, in text order."""
    pattern, fields = LOG_LAYOUTS[layout]
    body = F.regexp_replace(F.col(text), "\r\n", "\n")
    arrays = [F.regexp_extract_all(body, F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(fields)]
    blocks = logs.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "b"))
    return blocks.select(*keep, "pos", *[F.col(f"b.{n}").cast(LOG_TYPES.get(n, "string")).alias(n) for n in fields])


def read_run_log(spark: SparkSession, path: str, layout: str) -> DataFrame:
    logs = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return parse_run_log(logs, layout, keep=["path"])


CONFIG_KEYS = [*SEARCH_GRID, *FIXED_PARAMS]


def pareto_report(front: DataFrame, baseline: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Report rows: the baseline, one row per point with nested config and sensitivity, and the run statistics."""
    config = F.struct(*CONFIG_KEYS).alias("config")
    sens = "map<string,struct<max_abs_dcpi:double,max_abs_dcost:double>>"

    def rows(df: DataFrame, kind: str) -> DataFrame:
        flag = F.col("validation_candidate") if "validation_candidate" in df.columns else F.lit(False)
        nested = F.col("sensitivity").cast(sens) if "sensitivity" in df.columns else F.lit(None).cast(sens)
        return df.select(
            F.lit(kind).alias("kind"), F.col("cpi").alias("predicted_cpi"), F.col("cost").alias("predicted_cost"),
            flag.alias("validation_candidate"), nested.alias("sensitivity"), config, F.lit(None).cast("string").alias("stats"),
        )

    out = rows(baseline, "baseline").unionByName(rows(front, "point"))
    if stats is not None:
        line = stats.select(F.lit("stats").alias("kind"), F.to_json(F.struct("*")).alias("stats"))
        out = out.unionByName(line, allowMissingColumns=True)
    return out


def tradeoff_table(report: DataFrame) -> DataFrame:
    """Points and baseline as a flat table in cost order."""
    c = lambda n: F.col(f"config.{n}")
    rows = report.filter(F.col("kind") != "stats")
    return rows.select(
        "kind", "predicted_cpi", "predicted_cost", "validation_candidate", c("branch_predictor").alias("branch_predictor"),
        F.concat_ws("/", c("l1d_size"), c("l1i_size"), c("l2_size")).alias("caches"),
        F.concat_ws("/", *[c(n).cast("string") for n in ("fetch_width", "decode_width", "rename_width", "commit_width")]).alias("widths"),
    ).orderBy("predicted_cost")


def write_pareto_report(report: DataFrame, path: str) -> None:
    """JSON lines; the front may be large, so it is not gathered into one document."""
    report.write.json(path)


def read_pareto_report(spark: SparkSession, path: str, candidates_only: bool = True) -> DataFrame:
    """Baseline and (candidate) points with flat configurations, from JSON lines or one nested document.

    A point that misses a parameter fails the job.
    """
    types = {p: "int" if isinstance((SEARCH_GRID.get(p) or [FIXED_PARAMS.get(p)])[0], int) else "string" for p in CONFIG_KEYS}
    config = "struct<" + ",".join(f"{p}:{t}" for p, t in types.items()) + ">"
    point = f"predicted_cpi double, predicted_cost double, validation_candidate boolean, config {config}"
    nested = point.replace(" double", ":double").replace(" boolean", ":boolean").replace("config struct", "config:struct").replace(", ", ",")
    doc = spark.read.schema(f"baseline struct<{nested}>, pareto_front array<struct<{nested}>>, kind string, {point}").option("multiLine", _is_document(spark, path)).json(path)
    lines = doc.filter(F.col("kind").isin("baseline", "point")).select("kind", "predicted_cpi", "predicted_cost", "validation_candidate", "config")
    base = doc.filter(F.col("baseline").isNotNull()).select(F.lit("baseline").alias("kind"), "baseline.*")
    front = doc.select(F.explode("pareto_front").alias("p")).select(F.lit("point").alias("kind"), "p.*")
    rows = lines.unionByName(base).unionByName(front)
    if candidates_only:
        rows = rows.filter((F.col("kind") == "baseline") | F.col("validation_candidate"))
    flat = []
    for p in CONFIG_KEYS:
        value = F.col(f"config.{p}")
        flat.append(must(value.isNotNull(), f"report point misses {p}", value).alias(p))
    return rows.select("kind", "predicted_cpi", "predicted_cost", F.coalesce("validation_candidate", F.lit(False)).alias("validation_candidate"), *flat)


def _is_document(spark: SparkSession, path: str) -> bool:
    """A nested document names its front; JSON lines name a kind on every line."""
    first = spark.read.text(path).filter(F.trim("value") != "").take(1)
    return not (first and '"kind"' in first[0][0])
