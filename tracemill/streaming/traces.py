"""Structured Streaming over arriving trace files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.functions.scalars import must, parse_name_list
from tracemill.operators.ordered import small_broadcast
from tracemill.operators.program import program_features
from tracemill.operators.windows import COUNTED, WINDOW_ROWS, count_columns, instruction_flags, ordinal_windows, window_counts
from tracemill.sources.traces import LATENCY_COLUMNS, TRACE_COLUMNS, TRACE_FILE, file_place, typed_trace
from tracemill.session import cut_lineage

STREAM_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in [*TRACE_COLUMNS, *LATENCY_COLUMNS]])


def _bad_row():
    """Rows the typed reader would reject."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    known = text("Branch Type").isin("", "direct_conditional", "direct_unconditional", "indirect")
    address = lambda c: c.rlike("^(0[xX])?0*[0-9a-fA-F]{1,16}$")
    bad = ~known | (text("Category") == "") | ~address(text("IP"))
    bad |= (text("Branch Target Address") != "") & ~address(text("Branch Target Address"))
    for c in ("Register Dependent IPs", "Read Addresses", "Write Addresses", "Memory Dependent IPs"):
        bad |= F.exists(parse_name_list(c), lambda x: ~address(F.trim(F.split_part(x, F.lit("("), F.lit(1)))))
    for c in LATENCY_COLUMNS:
        bad |= (text(c) != "") & text(c).try_cast("int").isNull()
    return bad


def ingest_traces_stream(
    spark: SparkSession, source: str, features: str, windows: str, failed: str, checkpoint: str,
    k: int = WINDOW_ROWS, files_per_batch: int = 1000, id_pattern: str = TRACE_FILE,
) -> StreamingQuery:
    """Processes every new trace file once and stops when the folder is drained; restart to resume.

    A file is the atomic unit, so a micro-batch holds whole traces and the batch operators
    apply. Each batch writes its own output folders, overwritten on replay, so results are
    exactly once. Traces with unreadable rows go to `failed` and do not stop the rest.
    """
    raw = (
        spark.readStream.schema(STREAM_SCHEMA).options(header=True, maxFilesPerTrigger=files_per_batch, recursiveFileLookup=True)
        .csv(source)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    )

    def process(batch: DataFrame, batch_id: int) -> None:
        _process_traces(cut_lineage(_placed(batch, id_pattern)), features, windows, failed, batch_id, k)

    return raw.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _placed(batch: DataFrame, id_pattern: str) -> DataFrame:
    """Adds the trace of each row and its place within its file block."""
    return batch.withColumn("trace_id", F.regexp_extract("_file", id_pattern, 1)).withColumn("_mid", F.monotonically_increasing_id())


def _process_traces(rows: DataFrame, features: str, windows: str, failed: str, batch_id: int, k: int) -> None:
    """Program features and window counts of whole traces, one output folder a batch; traces with unreadable rows go to `failed`.

    `rows` must be kept ones. Rows of a file block are numbered one after another where they are read, so the first number of
    each block and the rows of earlier blocks place them: one small row a block is broadcast, and no row is moved or sorted.
    """
    first, last, n = F.min("_mid"), F.max("_mid"), F.count(F.lit(1))
    placed = must(last - first + 1 == n, F.concat(F.lit("rows are missing in a block of "), F.first("_file")), n)
    blocks = cut_lineage(rows.groupBy("trace_id", "_file", "_start").agg(F.count_if(_bad_row()).alias("bad_rows"), placed.alias("n_rows"), first.alias("_first")))
    status = blocks.groupBy("trace_id").agg(F.sum("bad_rows").alias("bad_rows"), F.sum("n_rows").alias("n_rows"))
    broken = status.filter(F.col("bad_rows") > 0)
    broken.write.mode("overwrite").parquet(f"{failed}/batch={batch_id}")
    earlier = F.sum("n_rows").over(W.partitionBy("trace_id").orderBy(file_place()).rowsBetween(W.unboundedPreceding, -1))
    shifts = blocks.join(broken, "trace_id", "left_anti").select("_file", "_start", (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift"))
    ranked = rows.join(small_broadcast(shifts), ["_file", "_start"])
    trace = cut_lineage(typed_trace(ranked, ["trace_id", (F.col("_mid") + F.col("_shift")).alias("idx")]))
    program_features(trace, kept=True).write.mode("overwrite").parquet(f"{features}/batch={batch_id}")
    window_counts(trace, k).write.mode("overwrite").parquet(f"{windows}/batch={batch_id}")


def ingest_trace_parts_stream(
    spark: SparkSession, source: str, manifest: DataFrame, staged: str, features: str, windows: str, failed: str, late: str,
    checkpoint: str, k: int = WINDOW_ROWS, files_per_batch: int = 1000, id_pattern: str = TRACE_FILE,
) -> StreamingQuery:
    """As `ingest_traces_stream`, for traces of several part files that arrive in any order and in different batches.

    `manifest` has (trace_id, n_parts). A batch keeps its rows and the names of its files below `staged`; a trace is processed
    once, as a whole, in the batch that brings the last of its parts. Which traces those are follows from the names kept so
    far, and every folder of a batch is overwritten on replay, so results are exactly once without other state. Traces that
    the manifest does not list, or whose parts are missing, wait for a later run with their rows kept. Files that come for a
    trace after it was complete are listed in `late` and change nothing. Staged rows are never deleted here.
    """
    raw = (
        spark.readStream.schema(STREAM_SCHEMA).options(header=True, maxFilesPerTrigger=files_per_batch, recursiveFileLookup=True)
        .csv(source)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    )
    expected = manifest.select(F.col("trace_id").cast("string").alias("trace_id"), "n_parts")

    def process(batch: DataFrame, batch_id: int) -> None:
        rows = _placed(batch, id_pattern)
        rows.write.mode("overwrite").parquet(f"{staged}/rows/batch={batch_id}")
        spark.read.schema(rows.schema).parquet(f"{staged}/rows/batch={batch_id}").select("trace_id", "_file").distinct().write.mode("overwrite").parquet(f"{staged}/files/batch={batch_id}")
        files = spark.read.schema("trace_id string, _file string, batch bigint").parquet(f"{staged}/files").filter(F.col("batch") <= batch_id)
        earlier = F.when(F.col("batch") < batch_id, F.col("_file"))
        parts = files.groupBy("trace_id").agg(F.count_distinct("_file").alias("parts"), F.count_distinct(earlier).alias("before")).join(expected, "trace_id")
        parts = cut_lineage(parts.filter(F.col("parts") >= F.col("n_parts")))
        ready, closed = (parts.filter(c).select("trace_id") for c in (F.col("before") < F.col("n_parts"), F.col("before") >= F.col("n_parts")))
        files.filter(F.col("batch") == batch_id).join(closed, "trace_id", "left_semi").drop("batch").write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        needed = [r["batch"] for r in files.join(ready, "trace_id", "left_semi").select("batch").distinct().collect()]  # one number a batch
        if needed:
            kept = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{staged}/rows").filter(F.col("batch").isin(needed))
            _process_traces(kept.drop("batch").join(small_broadcast(ready), "trace_id", "left_semi"), features, windows, failed, batch_id, k)

    return raw.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts_stream(stream: DataFrame, k: int = WINDOW_ROWS) -> DataFrame:
    """Window counts kept incrementally; rows may arrive in any order because each carries its `idx`.

    For update or complete output mode. State is one row of counters per open window.
    """
    flagged = stream if "is_load" in stream.columns else instruction_flags(stream)
    return ordinal_windows(flagged, k).groupBy("trace_id", "window_id").agg(*count_columns())


COUNT_NAMES = ["size", *COUNTED]
BLOCK_WINDOWS = 128  # windows that share a state row


def _blocked(rows: DataFrame) -> DataFrame:
    """Adds the number of the run of windows that share a state row: Python is called once a run, not once a window."""
    return rows.withColumn("_block", F.call_function("div", F.col("window_id"), F.lit(BLOCK_WINDOWS)))


BLOCK_STATE = T.StructType([T.StructField("windows", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.LongType()))])


def _held(state: GroupState, columns: list[str]) -> pd.DataFrame:
    """The windows of a state row, one line each."""
    windows, values = state.get if state.exists else ([], [])
    return pd.DataFrame(np.array(values, np.int64).reshape(-1, len(columns)), pd.Index(windows, dtype="int64", name="window_id"), columns)


def _keep(state: GroupState, held: pd.DataFrame, wait: int | None, now: int) -> None:
    """Puts back the windows that stay; with `wait` the next call comes when the first of them has waited that long."""
    if len(held):
        state.update((held.index.tolist(), held.to_numpy(np.int64).ravel().tolist()))
        if wait:
            state.setTimeoutDuration(max(int(held["last"].min()) + wait - now, 1))
    elif state.exists:
        state.remove()


def closed_window_counts(stream: DataFrame, k: int = WINDOW_ROWS, idle: int | None = None) -> DataFrame:
    """Window counts in append mode: a window is given out once, when its k rows have come, and its state goes with it.

    Rows may arrive in any order and over any number of batches. The last window of a trace may never fill: with `idle`
    milliseconds it is given out as it is when no row has come for that long. State is one row of counters per open window,
    in one state row for BLOCK_WINDOWS neighbouring windows.
    """
    flagged = ordinal_windows(stream if "is_load" in stream.columns else instruction_flags(stream), k)
    rows = _blocked(flagged.select("trace_id", "window_id", F.lit(1).cast("bigint").alias("size"), *[F.coalesce(c().cast("bigint"), F.lit(0).cast("bigint")).alias(n) for n, c in COUNTED.items()]))
    out = T.StructType([rows.schema["trace_id"], rows.schema["window_id"], *(T.StructField(n, T.LongType()) for n in COUNT_NAMES)])

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if idle else 0
        found = [_held(state, [*COUNT_NAMES, "last"])]
        for part in () if state.hasTimedOut else parts:
            found.append(part.groupby("window_id")[COUNT_NAMES].sum().assign(last=now))
        found = pd.concat(found).groupby(level=0).agg({**dict.fromkeys(COUNT_NAMES, "sum"), "last": "max"})
        done = found["size"] >= k
        if idle:
            done |= found["last"] + idle <= now
        if done.any():
            given = found.loc[done, COUNT_NAMES].reset_index()
            given.insert(0, "trace_id", [key[0]] * len(given))
            yield given
        _keep(state, found[~done], idle, now)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.groupBy("trace_id", "_block").applyInPandasWithState(count, out, BLOCK_STATE, "append", timeout)


def whole_window_counts(stream: DataFrame, ends: DataFrame, k: int = WINDOW_ROWS, forget: int | None = None) -> DataFrame:
    """All windows of traces whose end is told: (trace_id, window_id, status, counts...) in append mode.

    `ends` is a stream of (trace_id, n_rows), one mark for each finished trace, that may come before, between or after its
    rows. A window is given out once, with status `closed`, when all its rows have come: k of them, or fewer for the last
    window of a marked trace. Rows that come for a window given out before are reported as `late` with their counts, and
    change nothing else. Marks are spread over the windows of their trace, so state is one row of counters per window,
    BLOCK_WINDOWS of them in a state row, and a hot trace is spread over all tasks.

    The state of a closed window stays as its record until the mark of its trace has come, or, with `forget` milliseconds,
    until nothing has come for it for that long. With `forget`, a window that nothing has come for is given out as it is,
    with status `partial`, so state ends empty even where a mark is lost. Marks of traces without rows add nothing.
    """
    flagged = ordinal_windows(stream if "is_load" in stream.columns else instruction_flags(stream), k)
    rows = flagged.select("trace_id", "window_id", F.lit(1).cast("bigint").alias("size"), *[F.coalesce(c().cast("bigint"), F.lit(0).cast("bigint")).alias(n) for n, c in COUNTED.items()], F.lit(0).cast("bigint").alias("expected"))
    id_type, window_type = rows.schema["trace_id"].dataType, rows.schema["window_id"].dataType
    total = F.col("n_rows").cast("bigint")
    marks = ends.where(total > 0).select(F.col("trace_id").cast(id_type), total.alias("n_rows"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", total - 1, F.lit(k)))).alias("w"))
    marks = marks.select("trace_id", F.col("w").cast(window_type).alias("window_id"), *[F.lit(0).cast("bigint").alias(n) for n in COUNT_NAMES], F.least(F.lit(k).cast("bigint"), F.col("n_rows") - F.col("w") * k).alias("expected"))
    out = T.StructType([rows.schema["trace_id"], rows.schema["window_id"], T.StructField("status", T.StringType()), *(T.StructField(n, T.LongType()) for n in COUNT_NAMES)])
    brought = {**dict.fromkeys(COUNT_NAMES, "sum"), "expected": "max"}

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if forget else 0
        held = _held(state, [*brought, "given", "last"])
        fresh = [held.iloc[:0][[*brought]], *(part.groupby("window_id")[[*brought]].agg(brought) for part in (() if state.hasTimedOut else parts))]
        fresh = pd.concat(fresh).groupby(level=0).agg(brought)
        found = held.reindex(held.index.union(fresh.index), fill_value=0)
        touched = found.index.isin(fresh.index)
        fresh = fresh.reindex(found.index, fill_value=0)
        given = found["given"] > 0
        found["expected"] = np.maximum(found["expected"], fresh["expected"])
        found.loc[~given, COUNT_NAMES] += fresh.loc[~given, COUNT_NAMES]
        closed = ~given & touched & (found["size"] > 0) & (found["size"] >= found["expected"].where(found["expected"] > 0, k))
        stale = ~touched & (found["last"] + forget <= now) if forget else pd.Series(False, found.index)
        for status, rows_of, which in (("late", fresh, given & (fresh["size"] > 0)), ("closed", found, closed), ("partial", found, stale & ~given & (found["size"] > 0))):
            if which.any():
                told = rows_of.loc[which, COUNT_NAMES].reset_index()
                told.insert(0, "trace_id", [key[0]] * len(told))
                told.insert(2, "status", status)
                yield told
        found["given"] = (given | closed).astype("int64")
        found.loc[touched, "last"] = now
        gone = stale if forget else (found["given"] > 0) & (found["expected"] > 0)
        _keep(state, found[~gone], forget, now)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return _blocked(rows.unionByName(marks)).groupBy("trace_id", "_block").applyInPandasWithState(count, out, BLOCK_STATE, "append", timeout)
