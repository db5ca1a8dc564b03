"""Sweep files, per-benchmark sidecar files, feature sinks and caches."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.scalars import must, require_columns
from tracemill.operators.ordered import dim_join
from tracemill.operators.sweeps import coerce_feature_map

# Text columns of a sweep file; cpi is a double and the others are whole numbers.
SWEEP_TEXT = ["benchmark", "branch_predictor", "l1d_size", "l1i_size", "l2_size"]


def read_sweep(spark: SparkSession, path: str | list[str], needed: list[str] = ("benchmark",)) -> DataFrame:
    """Sweep rows; columns are typed by name, a missing column or a bad number fails the job."""
    raw = consolidate(spark, path)
    require_columns(raw, list(needed), "sweep file")
    kinds = {"cpi": "double", **{c: "string" for c in SWEEP_TEXT}}
    return raw.select(*[F.col(c).cast(kinds.get(c, "bigint")).alias(c) for c in raw.columns])


def consolidate(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Many CSV files as one table: every header must equal the first, every row must have its width."""
    names = spark.read.option("header", True).csv(path).schema
    return (
        spark.read.schema(names)
        .options(header=True, enforceSchema=False, mode="FAILFAST", columnPruning=False)
        .csv(path)
    )


def _sidecar(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(benchmark, value): the small file `name` of every benchmark folder that has it."""
    files = spark.read.options(recursiveFileLookup=True, pathGlobFilter=name).text(root, wholetext=True)
    # root/<benchmark>/<subfolder>/<file>
    return files.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("benchmark"), "value")


def _small_csv(df: DataFrame) -> DataFrame:
    """(benchmark, row): one map from header to value per line of a small numeric CSV text."""
    lines = F.filter(F.split("value", "\r?\n"), lambda s: F.trim(s) != "")
    header = F.transform(F.split(F.get("_lines", F.lit(0)), ","), lambda s: F.trim(s))
    body = F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0)))
    out = df.withColumn("_lines", lines).withColumn("_header", header).withColumn("_n", F.size("_lines") - 1)
    return out.select("benchmark", "_n", "_header", F.explode(body).alias("_line")).select(
        "benchmark", "_n", F.map_from_arrays("_header", F.transform(F.split("_line", ","), lambda s: F.trim(s))).alias("row")
    )


def program_maps(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(benchmark, features map) from JSON files."""
    return coerce_feature_map(_sidecar(spark, root, name), "value").select("benchmark", "features")


def read_program_sidecars(spark: SparkSession, root: str, stem: str = "program_features") -> DataFrame:
    """(benchmark, features map) from JSON or one-row CSV; another row count fails the job."""
    from_json = program_maps(spark, root, f"{stem}.json")
    table = _small_csv(_sidecar(spark, root, f"{stem}.csv"))
    text = F.concat(F.lit("expected exactly one program feature row for "), F.col("benchmark"))
    one = table.filter(must(F.col("_n") == 1, text, F.lit(True)))
    from_csv = one.select("benchmark", F.transform_values("row", lambda k, v: v.cast("double")).alias("features"))
    # A benchmark with both files uses the JSON one.
    return from_json.unionByName(from_csv.join(from_json.select("benchmark"), "benchmark", "left_anti"))


def read_cache_sidecars(spark: SparkSession, root: str, columns: list[str], name: str = "cache_latency_summary.csv") -> DataFrame:
    rows = _small_csv(_sidecar(spark, root, name))
    keys = [F.try_element_at("row", F.lit(k)).cast("bigint").alias(k) for k in ("l1i_kb", "l1d_kb", "l2_kb")]
    return rows.select("benchmark", *keys, *[F.try_element_at("row", F.lit(c)).cast("double").alias(c) for c in columns])


def read_rate_sidecars(spark: SparkSession, root: str, name: str = "bp_rates_summary.csv") -> DataFrame:
    """(benchmark, bp_type, misprediction_rate) from CSV and from `trace_bp.json` objects."""
    rows = _small_csv(_sidecar(spark, root, name)).select(
        "benchmark", F.try_element_at("row", F.lit("bp_type")).alias("bp_type"),
        F.try_element_at("row", F.lit("misprediction_rate")).cast("double").alias("misprediction_rate"),
    )
    objects = _sidecar(spark, root, "trace_bp.json").select("benchmark", F.explode(F.from_json("value", "map<string,double>")).alias("bp_type", "misprediction_rate"))
    return rows.unionByName(objects)


def feature_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Named columns from the features map; a missing name fails the job."""
    cols = []
    for n in names:
        value = F.try_element_at("features", F.lit(n))
        cols.append(must(value.isNotNull(), f"feature {n} is missing", value).alias(n))
    return df.select("benchmark", *cols)


def write_features(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> None:
    """csv, json or parquet by argument or path ending (parquet stands in for pickled frames)."""
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    fmt = {"pkl": "parquet", "pickle": "parquet"}.get(fmt, fmt)
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown feature format {fmt!r}")
    options = {"header": True} if fmt == "csv" else {}
    df.write.mode(mode).options(**options).format(fmt).save(path)


COMMITS = "_commits"


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, file) of every commit of a table, in order."""
    files, log = _files(spark, path), _path(spark, f"{path}/{COMMITS}")
    if not files.exists(log):
        if files.exists(_path(spark, path)) and len(files.listStatus(_path(spark, path))):
            raise ValueError(f"{path} holds files, but none of them is a commit")
        return []
    names = [str(f.getPath().getName()) for f in files.listStatus(log)]
    return sorted((int(n.removesuffix(".json")), f"{path}/{COMMITS}/{n}") for n in names if n[0].isdigit())


def _schema_of(spark: SparkSession, commit: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(spark.read.text(commit, wholetext=True).first()[0])["schema"])


def _check_columns(want: T.StructType, have: T.StructType) -> None:
    old, new = ({f.name: f.dataType.simpleString() for f in schema.fields} for schema in (have, want))
    if old != new:
        raise ValueError(f"columns differ from the existing table: {sorted(set(old.items()) ^ set(new.items()))}")


def _put_if_absent(spark: SparkSession, path: str, version: int, text: str) -> bool:
    """Publishes a commit file under its version; False if another writer has that version. A file appears whole or not at all."""
    jvm, files = spark._jvm, _files(spark, path)
    staged, final = _path(spark, f"{path}/{COMMITS}/.{uuid.uuid4().hex}"), _path(spark, f"{path}/{COMMITS}/{version:020d}.json")
    out = files.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE  # does not replace an existing file
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri() if staged.toUri().getScheme() else files.getUri(), spark._jsc.hadoopConfiguration()).rename(staged, final, options)
    except Py4JJavaError as e:
        files.delete(staged, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def append_training_rows(df: DataFrame, path: str, partition: str = "benchmark") -> int:
    """Appends rows when their columns and types equal the existing table's; returns the version.

    Rows are staged in a folder of their own that no reader looks into, then a commit file with the folder and the schema
    is put under the next version, if no other writer has it. A writer that loses checks the winner's schema and tries the
    next version; if the schemas differ it removes its folder and fails. Readers (`read_training_rows`) see whole commits
    only, and a failed or repeated job leaves at most an unread folder.
    """
    spark, schema = df.sparkSession, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    commits = _commits(spark, path)
    if commits:
        _check_columns(schema, _schema_of(spark, commits[-1][1]))
    folder = f"append_id={uuid.uuid4().hex}"
    text = json.dumps({"folder": folder, "partition": partition, "schema": schema.jsonValue()})
    _files(spark, path).mkdirs(_path(spark, f"{path}/{COMMITS}"))
    df.write.partitionBy(partition).parquet(f"{path}/{folder}")
    while True:
        commits = _commits(spark, path)
        try:
            if commits:
                _check_columns(schema, _schema_of(spark, commits[-1][1]))
        except ValueError:
            _files(spark, path).delete(_path(spark, f"{path}/{folder}"), True)
            raise
        version = commits[-1][0] + 1 if commits else 0
        if _put_if_absent(spark, path, version, text):
            return version


def read_training_rows(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows of the commits up to a version (default: the latest). The log is one small file for each append."""
    commits = [file for number, file in _commits(spark, path) if version is None or number <= version]
    if not commits:
        raise ValueError(f"{path} has no commit")
    schema = _schema_of(spark, commits[-1])
    texts = [r[0] for r in spark.read.text(commits, wholetext=True).collect()]
    folders = [f"{path}/{json.loads(t)['folder']}" for t in texts]
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.names)


def _newest(spark: SparkSession, path: str):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.max("modificationTime")).first()[0]  # listing only, contents are pruned


def materialize_matrix(df: DataFrame, path: str, source: str, features: list[str], label: str, ids: list[str]) -> DataFrame:
    """Single-precision (ids, features[], label) table; reused while newer than its source."""
    spark = df.sparkSession
    try:
        fresh = _newest(spark, path) >= _newest(spark, source)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = False
    if not fresh:
        vec = F.array(*[F.col(c).cast("float") for c in features]).alias("features")
        df.select(*ids, vec, F.col(label).cast("float").alias(label)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def skip_done(todo: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key has no output yet."""
    return dim_join(todo, done.select(*on).distinct(), on, "left_anti")
