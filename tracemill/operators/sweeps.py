"""Sweep rows: configuration mapping, feature preparation, checks and dimension joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.registry import REGISTRY, Registry
from tracemill.functions.scalars import all_of, encode_predictor, must, parse_size, require_columns
from tracemill.operators.ordered import dim_join, small_broadcast

ON_MISSING = ("error", "zero", "drop")

# Categories and column groups of the prepared training features.
PREFETCH_DEGREES = [0, 4]
PREDICTORS = ["local", "tage"]
SIZE_COLUMNS = ["l1d_size", "l1i_size", "l2_size"]
QUEUE_COLUMNS = ["lq_entries", "sq_entries", "rob_size"]
ID_COLUMNS = ["benchmark", "checkpoint", "fast_forward", "ff_instructions", "region"]
FEATURE_GROUPS = {
    "cache_cdf_features": [
        "cache_fetch_p50", "cache_fetch_p75", "cache_fetch_p95", "cache_exec_p50", "cache_exec_p75", "cache_exec_p95",
    ],
    "stale_features": ["prog_frac_simd", "prog_frac_branch", "prog_frac_other"],
}


def to_config(df: DataFrame, registry: Registry = REGISTRY, keep: list[str] = ()) -> DataFrame:
    """Sweep columns -> configuration fields: copied, size-parsed, summed or left at the default."""
    fields = []
    for p in registry.enabled_params():
        if p.source is None:
            value = F.col(p.name) if p.name in df.columns else F.lit(p.default)
        elif isinstance(p.source, tuple):
            require_columns(df, list(p.source), "sweep")
            value = sum((F.col(c).cast("int") for c in p.source[1:]), F.col(p.source[0]).cast("int"))
        elif p.source not in df.columns:
            value = F.lit(p.default)
        elif p.name == "branch_predictor":
            value = encode_predictor(p.source)
        elif p.name.endswith("_kb"):
            value = parse_size(p.source)
        else:
            value = F.col(p.source)
        fields.append(value.cast("double" if p.kind == "float" else "int").alias(p.name))
    return df.select(*keep, *fields)


def config_feature_columns(registry: Registry = REGISTRY) -> list[Column]:
    """All enabled parameters as scalars, then predictor and prefetcher one-hots."""
    scalars = [F.col(p.name) for p in registry.enabled_params()]
    bp, pf = F.col("branch_predictor"), F.col("l1d_stride_prefetch")
    flags = [
        (bp == 0).cast("int").alias("bp_is_simple"), (bp == 1).cast("int").alias("bp_is_tage"),
        (pf == 0).cast("int").alias("prefetcher_off"), (pf != 0).cast("int").alias("prefetcher_on"),
    ]
    return [*scalars, *flags]


def config_features(configs: DataFrame, registry: Registry = REGISTRY, keep: list[str] = ()) -> DataFrame:
    return configs.select(*keep, *config_feature_columns(registry))


def one_hot(c: str, values: list, prefix: str | None = None) -> list[Column]:
    """0/1 columns from a fixed category list, so train and test always get the same columns."""
    return [(F.col(c) == v).cast("double").alias(f"{prefix or c}_{v}") for v in values]


def prepare_features(df: DataFrame, label: str = "cpi", drop: list[str] = ()) -> DataFrame:
    """Numeric feature columns: ids, label and predictor dropped, prefetcher one-hot, sizes in bytes, queue reciprocals."""
    gone = {label, "branch_predictor", "stride_prefetcher_degree", *ID_COLUMNS, *drop}
    plain = [
        (parse_size(c, "bytes") if c in SIZE_COLUMNS else F.col(c)).cast("double").alias(c)
        for c in df.columns if c not in gone
    ]
    hot = one_hot("stride_prefetcher_degree", PREFETCH_DEGREES) if "stride_prefetcher_degree" in df.columns else []
    reciprocal = [(F.lit(1.0) / F.col(c)).alias(f"reciprocal_{c}") for c in QUEUE_COLUMNS if c in df.columns]
    return df.select(*plain, *hot, *reciprocal)


def prepare_features_onehot(df: DataFrame, benchmarks: list[str], label: str = "cpi", drop: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Variant without analytical columns: benchmark, predictor and prefetcher one-hot.

    Also returns the continuous columns, the only ones to scale. Sizes are in KB.
    """
    gone = {label, "benchmark", "branch_predictor", "stride_prefetcher_degree", *drop}
    continuous = [c for c in df.columns if c not in gone]
    plain = [(parse_size(c) if c in SIZE_COLUMNS else F.col(c)).cast("double").alias(c) for c in continuous]
    hot = [*one_hot("benchmark", benchmarks), *one_hot("branch_predictor", PREDICTORS), *one_hot("stride_prefetcher_degree", PREFETCH_DEGREES)]
    return df.select(*plain, *hot), continuous


def drop_feature_group(df: DataFrame, groups: list[str], benchmarks: list[str] | None = None) -> DataFrame:
    """Ablations: named column groups, or every analytical column in favour of benchmark one-hots."""
    out = df
    for g in groups:
        if g == "all_features":
            analytical = [c for c in out.columns if c.startswith(("prog_", "cache_"))]
            kept = [F.col(c) for c in out.columns if c not in analytical]
            out = out.select(*kept, *one_hot("benchmark", benchmarks or []))
        elif g in FEATURE_GROUPS:
            out = out.drop(*FEATURE_GROUPS[g])
        else:
            raise ValueError(f"unknown feature group {g!r}")
    return out


def expand_tokens(tokens: str, groups: dict[str, list[str]], ood: str | None = None) -> list[str]:
    """Benchmark list from comma-separated names and group tokens; `<group>_except_ood` drops `ood`."""
    names: list[str] = []
    for token in filter(None, (t.strip() for t in tokens.split(","))):
        base = re.sub("_except_ood$", "", token)
        if token in groups:
            names += groups[token]
        elif base != token and base in groups:
            if not ood:
                raise ValueError(f"{token} needs the held-out benchmark")
            names += [n for n in groups[base] if n != ood]
        else:
            names.append(token)
    return list(dict.fromkeys(names))


def whitelist(df: DataFrame, names: list[str], known: DataFrame | None = None) -> DataFrame:
    """Rows of the named benchmarks; with `known`, names missing there are rejected."""
    if known is not None:
        asked = df.sparkSession.createDataFrame([(n,) for n in names], "benchmark string")
        unknown = [r[0] for r in asked.join(known.select("benchmark").distinct(), "benchmark", "left_anti").collect()]
        if unknown:
            raise ValueError(f"unknown benchmarks: {sorted(unknown)}")
    return df.filter(F.col("benchmark").isin(names))


def drop_benchmarks(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(~F.col("benchmark").isin(names))


def require_traces(sweep: DataFrame, traces: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose trace exists, and a count per missing trace."""
    known = small_broadcast(traces.select(*on).distinct())
    present, missing = (dim_join(sweep, known, on, how) for how in ("left_semi", "left_anti"))
    return present, missing.groupBy(*on).agg(F.count(F.lit(1)).alias("n_rows"))


def validated(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Fails the job on the first row that breaks a named check."""
    ok = [must(cond, f"check failed: {name}", F.lit(True)) for name, cond in checks.items()]
    return df.filter(all_of(ok))


def _fill(df: DataFrame, cols: list[str], on: list[str], on_missing: str, what: str, matched: str) -> DataFrame:
    if on_missing not in ON_MISSING:
        raise ValueError(f"on_missing must be one of {ON_MISSING}")
    if on_missing == "drop":
        return df.filter(F.col(matched).isNotNull()).drop(matched)
    if on_missing == "zero":
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}).drop(matched)
    key = F.concat_ws(",", *[F.col(k).cast("string") for k in on])
    found = must(F.col(matched).isNotNull(), F.concat(F.lit(f"no {what} for "), key), F.lit(True))
    return df.filter(found).drop(matched)


def _lookup(sweep: DataFrame, dim: DataFrame, on: list[str], on_missing: str, what: str) -> DataFrame:
    cols = [c for c in dim.columns if c not in on]
    joined = dim_join(sweep, small_broadcast(dim.withColumn("_hit", F.lit(True))), on, "left")
    return _fill(joined, cols, on, on_missing, what, "_hit")


def _trace_key(sweep: DataFrame) -> Column:
    """benchmark, or benchmark_ff where a fast-forward column is populated."""
    if "ff_instructions" not in sweep.columns:
        return F.col("benchmark")
    ff = F.col("ff_instructions").cast("string")
    return F.when(ff.isNull() | (ff == ""), F.col("benchmark")).otherwise(F.concat_ws("_", "benchmark", ff))


def join_program(sweep: DataFrame, program: DataFrame, prefix: str = "prog_", on_missing: str = "error") -> DataFrame:
    names = sorted(c for c in program.columns if c != "benchmark")
    dim = program.select(F.col("benchmark").alias("_key"), *[F.col(c).alias(f"{prefix}{c}") for c in names])
    return _lookup(sweep.withColumn("_key", _trace_key(sweep)), dim, ["_key"], on_missing, "program features").drop("_key")


def join_cache(sweep: DataFrame, cache: DataFrame, prefix: str = "cache_", on_missing: str = "error") -> DataFrame:
    keys = ["l1i_kb", "l1d_kb", "l2_kb"]
    names = sorted(c for c in cache.columns if c not in ("benchmark", "config_idx", *keys))
    dim = cache.select(
        F.col("benchmark").alias("_key"), *[F.col(k).cast("bigint").alias(f"_{k}") for k in keys],
        *[F.col(c).alias(f"{prefix}{c}") for c in names],
    )
    keyed = sweep.withColumns({"_key": _trace_key(sweep), **{f"_{level}_kb": parse_size(f"{level}_size") for level in ("l1i", "l1d", "l2")}})
    on = ["_key", *[f"_{k}" for k in keys]]
    return _lookup(keyed, dim, on, on_missing, "cache latency row").drop(*on)


def join_predictor_rate(
    sweep: DataFrame, rates: DataFrame, out: str = "misprediction_rate", on_missing: str = "error",
    default: float | None = None,
) -> DataFrame:
    """The rate of the row's own predictor; a default keeps rows whose rate is unknown."""
    dim = rates.select(
        F.col("benchmark").alias("_key"), encode_predictor("bp_type").alias("_bp"), F.col("misprediction_rate").alias(out)
    )
    keyed = sweep.withColumn("_key", _trace_key(sweep)).withColumn("_bp", encode_predictor("branch_predictor"))
    if default is not None:
        joined = dim_join(keyed, small_broadcast(dim), ["_key", "_bp"], "left")
        return joined.withColumn(out, F.coalesce(out, F.lit(float(default)))).drop("_key", "_bp")
    return _lookup(keyed, dim, ["_key", "_bp"], on_missing, "predictor rate").drop("_key", "_bp")


def build_training(
    sweep: DataFrame, program: DataFrame, cache: DataFrame, rates: DataFrame,
    program_prefix: str = "prog_", cache_prefix: str = "cache_", on_missing: str = "error",
) -> DataFrame:
    """Sweep columns, predictor rate, sorted program columns, sorted cache columns."""
    with_rate = join_predictor_rate(sweep, rates, on_missing=on_missing)
    with_prog = join_program(with_rate, program, program_prefix, on_missing)
    out = join_cache(with_prog, cache, cache_prefix, on_missing)
    prog_cols = [c for c in with_prog.columns if c not in with_rate.columns]
    cache_cols = [c for c in out.columns if c not in with_prog.columns]
    return out.select(*sweep.columns, "misprediction_rate", *prog_cols, *cache_cols)


def cache_config_idx(df: DataFrame, configs_json: DataFrame, on_missing: str = "error") -> DataFrame:
    """(l1i, l1d, l2) -> position in the trace's JSON list of cache configurations.

    `configs_json` holds trace_id and the text {"configs": [[l1i, l1d, l2], ...]}.
    """
    parsed = F.from_json("configs_json", "configs ARRAY<ARRAY<INT>>")["configs"]
    dim = configs_json.select("trace_id", F.posexplode(parsed).alias("cfg_idx", "_c")).select(
        "trace_id", "cfg_idx", *[F.get("_c", F.lit(i)).alias(k) for i, k in enumerate(("l1i_cache_kb", "l1d_cache_kb", "l2_cache_kb"))]
    ).groupBy("trace_id", "l1i_cache_kb", "l1d_cache_kb", "l2_cache_kb").agg(F.min("cfg_idx").alias("cfg_idx"))
    return _lookup(df, dim, ["trace_id", "l1i_cache_kb", "l1d_cache_kb", "l2_cache_kb"], on_missing, "cache configuration")


def join_cpi(sweep: DataFrame, results: DataFrame, on: list[str], row_id: str, file_order: str, row_limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """CPI of each sweep row by equality (null-safe) on every configuration column.

    Of duplicate results the last in file order counts. Returns the matched rows and
    a one-row count of unmatched ones. `row_limit` keeps the first rows by id.
    """
    latest = results.groupBy(*on).agg(F.max_by("cpi", file_order).alias("cpi"))
    rows = sweep.filter(F.col(row_id) <= row_limit) if row_limit else sweep
    left = rows.withColumn("_key", F.xxhash64(*on))
    right = latest.select(F.xxhash64(*on).alias("_key"), *[F.col(c).alias(f"_r_{c}") for c in on], "cpi")
    match = (left["_key"] == right["_key"])
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    joined = left.join(right, match, "left").drop("_key", *[f"_r_{c}" for c in on])
    return joined.filter(F.col("cpi").isNotNull()), joined.agg(F.count_if(F.col("cpi").isNull()).alias("n_missing"))


def semi_configs(df: DataFrame, held_out: DataFrame, config: list[str]) -> DataFrame:
    return dim_join(df, held_out.select(*config).distinct(), config, "left_semi")


def anti_configs(df: DataFrame, held_out: DataFrame, config: list[str]) -> DataFrame:
    return dim_join(df, held_out.select(*config).distinct(), config, "left_anti")


def pick_rows(df: DataFrame, ids: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows at the requested 1-based positions, in id-list order; a missing position fails the job."""
    wanted = ids.select(row_id, "pick_order")
    found = wanted.join(df.withColumn("_hit", F.lit(True)), row_id, "left")
    text = F.concat(F.lit("row id not found: "), F.col(row_id).cast("string"))
    return found.filter(must(F.col("_hit").isNotNull(), text, F.lit(True))).drop("_hit").orderBy("pick_order")


def parse_row_ids(lines: DataFrame, column: str = "value") -> DataFrame:
    """`row_<id>` lines -> ids; other non-blank text fails the job."""
    text = F.trim(column)
    digits = F.regexp_extract(text, r"^row_(\d+)$", 1)
    return lines.filter(text != "").select(
        must(digits != "", F.concat(F.lit("unexpected row id: "), text), digits).cast("bigint").alias("row_id")
    )


def coerce_feature_map(df: DataFrame, json_col: str, out: str = "features") -> DataFrame:
    """JSON object, {"features": object} or number list -> map of finite doubles; anything else fails."""
    text = F.trim(F.col(json_col))
    as_list = F.from_json(text, "array<double>")
    listed = F.map_from_entries(F.transform(as_list, lambda v, i: F.struct(F.concat(F.lit("f"), i.cast("string")), v)))
    inner = F.get_json_object(text, "$.features")
    body = F.when(inner.startswith("{"), inner).otherwise(text)
    # Text values first: a non-numeric value must fail, not become NULL.
    entries = F.from_json(body, "map<string,string>")
    numeric = F.transform_values(entries, lambda k, v: v.try_cast("double"))
    fmap = F.when(text.startswith("["), listed).otherwise(numeric)
    bad = F.map_filter(fmap, lambda k, v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(F.size(fmap) > 0, F.lit(False)) & (F.size(bad) == 0)
    return df.withColumn(out, must(good, F.concat(F.lit("not a map of finite numbers: "), text), fmap))


def common_features(df: DataFrame, column: str = "features", key: str = "benchmark") -> DataFrame:
    """Feature names present in every benchmark, sorted."""
    n = df.select(F.count_distinct(key).alias("n"))
    counts = df.select(key, F.explode(F.map_keys(column)).alias("feature")).groupBy("feature").agg(F.count_distinct(key).alias("_k"))
    return counts.filter(F.col("_k") == n.scalar()).select("feature").orderBy("feature")
