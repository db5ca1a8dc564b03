"""Binary array files as long tables. Each file is decoded by one task, in bounded batches."""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.ordered import bucketed_rank

BATCH_ROWS = 1 << 16
SEGMENT_ROWS = 1 << 20     # rows of one written latency file
SEGMENT_WINDOWS = 1 << 12  # windows of one written throughput file
LATENCY_FILE = r"([^/]+)/[^/]*l1i_(\d+)_l1d_(\d+)_l2_(\d+)_cache_latencies\.npy$"


def _files(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path", "content")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The files one by one: what their names say is read before, once a file and not for each row."""
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _batch(file: dict, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows of a file: what holds for the file, repeated, then the columns."""
    n = len(next(iter(columns.values())))
    types = {int: pa.int32(), str: pa.string()}
    same = [pa.repeat(pa.scalar(v, types.get(type(v), pa.int32())), n) for v in file.values()]
    return pa.RecordBatch.from_arrays([*same, *(pa.array(np.ascontiguousarray(c)) for c in columns.values())], names=[*file, *columns])


def read_latency_arrays(spark: SparkSession, glob: str, pattern: str = LATENCY_FILE) -> DataFrame:
    """(trace_id, l1i_kb, l1d_kb, l2_kb, idx, fetch_lat, exec_lat) from (N, 2) arrays.

    The trace is the folder name, the sizes come from the file name, and so does the position of a segment's first row.
    Files of another shape are skipped.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in _rows(batches):
            a = np.load(io.BytesIO(file.pop("content")), allow_pickle=False)
            first = file.pop("first")
            if a.ndim != 2 or a.shape[1] != 2:
                continue
            for i in range(0, len(a), BATCH_ROWS):
                part = a[i:i + BATCH_ROWS].astype(np.int32)
                yield _batch(file, {"idx": np.arange(first + i, first + i + len(part)), "fetch_lat": part[:, 0], "exec_lat": part[:, 1]})

    sizes = [F.regexp_extract("path", pattern, i).cast("int").alias(n) for i, n in ((2, "l1i_kb"), (3, "l1d_kb"), (4, "l2_kb"))]
    files = _files(spark, glob).select(F.regexp_extract("path", pattern, 1).alias("trace_id"), *sizes, _first().alias("first"), "content")
    return files.mapInArrow(decode, "trace_id string, l1i_kb int, l1d_kb int, l2_kb int, idx bigint, fetch_lat int, exec_lat int")


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path inside it, as an executor sees them."""
    plain = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", plain)) if "://" in plain else (fs.LocalFileSystem(), os.path.abspath(plain))


def _save(folder: str, trace: str, name: str, array: np.ndarray) -> None:
    """Written under another name and renamed, so that a repeated task leaves whole files."""
    files, root = _filesystem(folder)
    files.create_dir(f"{root}/{trace}", recursive=True)
    part, file = f"{root}/{trace}/.{uuid.uuid4().hex}.part", f"{root}/{trace}/{name}"
    whole = io.BytesIO()
    np.save(whole, array)
    with files.open_output_stream(part) as out:
        out.write(whole.getbuffer())
    if not isinstance(files, fs.LocalFileSystem) and files.get_file_info(file).type != fs.FileType.NotFound:
        files.delete_file(file)  # of an earlier attempt; only local renames replace a file
    files.move(part, file)


def write_latency_arrays(latency: DataFrame, path: str, segment_rows: int = SEGMENT_ROWS) -> None:
    """(n, 2) arrays of each trace and cache configuration, rows in idx order, in the layout that is read below.

    A file holds `segment_rows` rows and names the position of its first one, so a hot trace is written by many tasks, each
    of a fixed size. Positions are dense: an idx that is missing leaves no row.
    """
    keys = ["trace_id", "l1i_kb", "l1d_kb", "l2_kb"]
    ranked = bucketed_rank(latency.select(*keys, "idx", "fetch_lat", "exec_lat"), keys, F.floor(F.col("idx") / F.lit(segment_rows)), ["idx"], "pos")
    cut = ranked.select(*keys, "pos", "fetch_lat", "exec_lat", F.floor(F.col("pos") / F.lit(segment_rows)).alias("segment"))

    def save(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        trace, l1i, l1d, l2, segment = key
        start = int(segment) * segment_rows
        array = np.empty((len(pdf), 2), np.int32)
        array[pdf["pos"].to_numpy() - start] = pdf[["fetch_lat", "exec_lat"]].to_numpy(np.int32)
        _save(path, trace, f"seg_{start}_l1i_{l1i}_l1d_{l1d}_l2_{l2}_cache_latencies.npy", array)
        return pd.DataFrame({"rows": [len(array)]})

    cut.groupBy(*keys, "segment").applyInPandas(save, "rows bigint").agg(F.sum("rows")).collect()


def write_window_throughput(throughput: DataFrame, path: str, segment_windows: int = SEGMENT_WINDOWS) -> None:
    """Parameter-by-window matrices of each trace and resource, in the layout of read_window_throughput.

    A file holds the columns of `segment_windows` windows and names the first one, so the size of a task follows from the
    number of swept parameters alone. Windows without a value of a parameter are NaN.
    """
    cut = throughput.select("trace_id", "resource", "p0", "p1", "window_id", "thr", F.floor(F.col("window_id") / F.lit(segment_windows)).alias("segment"))

    def save(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        trace, resource, segment = key
        start = int(segment) * segment_windows
        params, row = np.unique(pdf[["p0", "p1"]].to_numpy(), axis=0, return_inverse=True)
        place = pdf["window_id"].to_numpy() - start
        values = np.full((len(params), place.max() + 1), np.nan)
        values[row.reshape(-1), place] = pdf["thr"].to_numpy()
        head = [np.full(len(params), 2.0), params] if params[:, 1].any() else [np.full(len(params), 1.0), params[:, :1]]
        _save(path, trace, f"seg_{start}_thr_{resource}.npy", np.column_stack([*head, values]))
        return pd.DataFrame({"rows": [len(params)]})

    cut.groupBy("trace_id", "resource", "segment").applyInPandas(save, "rows bigint").agg(F.sum("rows")).collect()


def _first() -> Column:
    """Position of a segment's first row or window, from the file name; 0 for a whole array."""
    return F.coalesce(F.nullif(F.regexp_extract("path", r"/seg_(\d+)_[^/]*$", 1), F.lit("")).cast("bigint"), F.lit(0))


def read_config_latency_arrays(spark: SparkSession, glob: str) -> DataFrame:
    """(trace_id, cfg_idx, idx, fetch_lat, exec_lat) from (configs, N, 2) arrays."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim != 3 or a.shape[2] != 2:
                    continue
                for c in range(a.shape[0]):
                    for i in range(0, a.shape[1], BATCH_ROWS):
                        part = a[c, i:i + BATCH_ROWS].astype(np.int32)
                        yield pd.DataFrame({"path": path, "cfg_idx": c, "idx": np.arange(i, i + len(part)), "fetch_lat": part[:, 0], "exec_lat": part[:, 1]})

    rows = _files(spark, glob).mapInPandas(decode, "path string, cfg_idx int, idx bigint, fetch_lat int, exec_lat int")
    return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("trace_id"), "cfg_idx", "idx", "fetch_lat", "exec_lat")


def read_window_throughput(spark: SparkSession, glob: str) -> DataFrame:
    """(trace_id, resource, cfg_idx, p0, p1, window_id, thr) from parameter-by-window matrices.

    Row layout: parameter count, one or two parameters, then one column per window. The
    count column tells whether a second parameter is present; a missing one is 0.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in _rows(batches):
            a = np.load(io.BytesIO(file.pop("content")), allow_pickle=False)
            start, path = file.pop("first"), file.pop("path")
            two = a.ndim == 2 and bool((a[:, 0].astype(int) >= 2).any())
            first = 3 if two else 2
            if a.ndim != 2 or a.shape[1] <= first:
                raise ValueError(f"{path}: not a throughput matrix, shape {a.shape}")
            step = max(1, BATCH_ROWS // (a.shape[1] - first))
            for i in range(0, len(a), step):
                part = a[i:i + step]
                n = part.shape[1] - first
                yield _batch(file, {
                    "p0": np.repeat(part[:, 1].astype(np.int32), n),
                    "p1": np.repeat(part[:, 2].astype(np.int32) if two else np.zeros(len(part), np.int32), n),
                    "window_id": np.tile(np.arange(start, start + n), len(part)),
                    "thr": part[:, first:].reshape(-1).astype(np.float64),
                })

    cfg = F.nullif(F.regexp_extract("path", r"/config_(\d+)/", 1), F.lit("")).cast("int")
    trace = F.regexp_extract(F.regexp_replace("path", r"/config_\d+/", "/"), r"([^/]+)/(?:seg_\d+_)?thr_[^/]+$", 1)
    files = _files(spark, glob).select(
        trace.alias("trace_id"), F.regexp_extract("path", r"thr_([^/]+)\.npy$", 1).alias("resource"),
        F.coalesce(cfg, F.lit(0)).alias("cfg_idx"), _first().alias("first"), "path", "content",
    )
    return files.mapInArrow(decode, "trace_id string, resource string, cfg_idx int, p0 int, p1 int, window_id bigint, thr double")


def read_rate_arrays(spark: SparkSession, glob: str) -> DataFrame:
    """(benchmark, bp_type, misprediction_rate) from scalar `<type>_bp_rate.npy` files."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rates = [float(np.load(io.BytesIO(c), allow_pickle=False).reshape(-1)[0]) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "misprediction_rate": rates})

    rows = _files(spark, glob).mapInPandas(decode, "path string, misprediction_rate double")
    return rows.select(
        F.regexp_extract("path", r"([^/]+)/(?:bp_rates/)?[^/]+$", 1).alias("benchmark"),
        F.regexp_extract("path", r"([^/]+)_bp_rate\.npy$", 1).alias("bp_type"), "misprediction_rate",
    )
