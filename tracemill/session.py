"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins from measured sizes and splits skewed shuffle partitions.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Generated methods above 8000 bytes are not compiled by the JVM; Spark then uses
    # smaller per-expression methods, several times faster for wide arithmetic rows.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Checkpoint files go away with the DataFrames that use them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}

METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"

# Read when a plan is made; releases the plan's shuffle files at the end of its first job.
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, app: str = "tracemill", conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a temporary one only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        own = tempfile.mkdtemp(prefix="tracemill-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)  # scratch tables below it go too
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local one.

    The shuffle files behind it are released once it is written, so that jobs of many steps hold those of one step. The
    projection has a plan of its own: `df` keeps its shuffle files, if it has any, and can be used again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(RELEASE_SHUFFLES, "false")
    spark.conf.set(RELEASE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(RELEASE_SHUFFLES, before)


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """For jobs that run inside: rows of hundreds of sums get methods that the JVM compiles, in any session (see DEFAULTS)."""
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, DEFAULTS[METHOD_LIMIT])
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
