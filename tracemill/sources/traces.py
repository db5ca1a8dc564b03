"""Trace files: reading, row counts and the annotated writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.scalars import (
    branch_taken,
    hex_to_long,
    long_to_hex,
    parse_addr_list,
    parse_bool,
    parse_branch_type,
    parse_mem_access_list,
    parse_name_list,
    require_columns,
)
from tracemill.operators.ordered import bucketed_rank

# Column names of a trace file; the last two are optional.
TRACE_COLUMNS = [
    "IP", "Assembly", "Category", "Opcode", "Branch Type", "Branch Taken", "Branch Target Address",
    "Instruction Sync", "Read Registers", "Write Registers", "Register Dependent IPs", "Read Addresses",
    "Write Addresses", "Memory Dependent IPs",
]
LATENCY_COLUMNS = ["Fetch Latency", "Execution Latency"]
REQUIRED_COLUMNS = ["IP", "Category"]

TRACE_FILE = r"([^/]+?)(?:/trace)?(?:\.trace)?\.csv(?:\.gz)?$"  # file name without its endings; of <trace>/trace.csv the folder
ROW_FILE = r"row_(\d+)(?:_[^/]*)?\.trace\.csv(?:\.gz)?$"  # row id of a sampled trace
TRACE_DIR = r"/trace_id=([^/]+)/[^/]*$"                  # folder written by the annotated writer


def typed_trace(raw: DataFrame, keep: list[str]) -> DataFrame:
    """Text columns of a trace file -> typed columns, by name.

    Only the address and the category are required: other missing columns read as blank
    (no branch, empty lists, latency 0), columns of other names are ignored.
    """
    require_columns(raw, REQUIRED_COLUMNS, "trace file")
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in TRACE_COLUMNS if c not in raw.columns})

    def latency(name: str) -> Column:
        if name not in raw.columns:
            return F.lit(0)
        return F.coalesce(F.nullif(F.trim(name), F.lit("")).cast("int"), F.lit(0))

    kind = parse_branch_type("Branch Type")
    target = F.coalesce(F.nullif(F.trim("Branch Target Address"), F.lit("")), F.lit("0x0"))
    return raw.select(
        *keep,
        hex_to_long("IP").alias("ip"), F.col("Assembly").alias("assembly"), F.trim("Category").alias("op_class"),
        F.trim(F.coalesce("Opcode", F.lit(""))).alias("opcode"), kind.alias("branch_type"),
        branch_taken(kind, "Branch Taken").alias("taken"), hex_to_long(target).alias("branch_target"),
        parse_bool("Instruction Sync").alias("inst_sync"),
        parse_name_list("Read Registers").alias("read_regs"), parse_name_list("Write Registers").alias("write_regs"),
        parse_addr_list("Register Dependent IPs").alias("reg_deps"),
        parse_addr_list("Read Addresses").alias("read_addrs"), parse_addr_list("Write Addresses").alias("write_addrs"),
        parse_mem_access_list("Read Addresses").alias("read_accesses"), parse_mem_access_list("Write Addresses").alias("write_accesses"),
        parse_addr_list("Memory Dependent IPs").alias("mem_deps"),
        latency("Fetch Latency").alias("fetch_lat"), latency("Execution Latency").alias("exec_lat"),
    )


def file_place() -> Column:
    """Order of file blocks inside a trace: part files by number, then by name, then by offset."""
    part = F.coalesce(F.regexp_extract("_file", r"/part-(\d+)[^/]*$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))
    return F.struct(part.alias("part"), "_file", "_start")


def read_traces(spark: SparkSession, path: str | list[str], id_pattern: str = TRACE_FILE) -> DataFrame:
    """Typed trace rows with `trace_id` (from the path) and `idx`, the row's position in its trace.

    Plain files are split over tasks; a position is the rank inside the file block plus
    the rows of earlier blocks, so a huge trace is never ordered in one task. Compressed
    files are one block each. All files must have the same header.
    """
    names = spark.read.option("header", True).csv(path).schema
    raw = spark.read.schema(names).option("header", True).option("enforceSchema", False).csv(path)
    placed = raw.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mid"),
    ).withColumn("trace_id", F.regexp_extract("_file", id_pattern, 1))
    ranked = bucketed_rank(placed, ["trace_id"], file_place(), ["_mid"], "idx")
    return typed_trace(ranked, ["trace_id", F.col("idx").cast("bigint").alias("idx")])


def count_rows_per_trace(trace: DataFrame) -> DataFrame:
    return trace.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_rows"))


def annotated_rows(trace: DataFrame) -> DataFrame:
    """Text columns of the file format: lists joined with `;`, addresses in hex, latencies last."""
    def hexes(c: str) -> Column:
        return F.array_join(F.transform(c, lambda a: long_to_hex(a)), ";")

    def optional(c: str, default: Column) -> Column:
        return F.col(c) if c in trace.columns else default

    none = F.array().cast("array<string>")
    branch = F.col("branch_type").isNotNull()
    return trace.select(
        "trace_id", "idx",
        long_to_hex("ip").alias("IP"), optional("assembly", F.lit("")).alias("Assembly"), F.col("op_class").alias("Category"),
        optional("opcode", F.lit("")).alias("Opcode"), F.coalesce("branch_type", F.lit("")).alias("Branch Type"),
        F.when(branch, F.col("taken").cast("string")).otherwise("").alias("Branch Taken"),
        F.when(branch, long_to_hex(optional("branch_target", F.lit(0)))).otherwise("").alias("Branch Target Address"),
        F.col("inst_sync").cast("string").alias("Instruction Sync"),
        F.array_join(optional("read_regs", none), ";").alias("Read Registers"),
        F.array_join(optional("write_regs", none), ";").alias("Write Registers"),
        hexes("reg_deps").alias("Register Dependent IPs"), hexes("read_addrs").alias("Read Addresses"),
        hexes("write_addrs").alias("Write Addresses"), hexes("mem_deps").alias("Memory Dependent IPs"),
        optional("fetch_lat", F.lit(0)).alias("Fetch Latency"), optional("exec_lat", F.lit(0)).alias("Execution Latency"),
    )


def write_annotated_trace(trace: DataFrame, path: str, compression: str = "none") -> None:
    """One folder per trace; part files hold consecutive rows, so file order is row order."""
    rows = annotated_rows(trace).repartitionByRange("trace_id", "idx").sortWithinPartitions("trace_id", "idx").drop("idx")
    rows.write.partitionBy("trace_id").options(header=True, emptyValue="", compression=compression).csv(path)
