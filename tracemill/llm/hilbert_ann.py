"""Nearest neighbours by cosine: windows on shifted Hilbert curves, then the curve's blocks that could still hold nearer ones."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import cut_lineage

CURVES, AXES, BITS, REACH = 4, 8, 6, 128
BLOCK_ROWS, MOST_BLOCKS, PROBES_AT_ONCE = 1024, 1 << 16, 4096
SLACK = 1e-9


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer points (points x axes, each 0 to 2^bits - 1) on the Hilbert curve."""
    x = cells.T.astype(np.int64).copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            invert = (x[i] & q) != 0
            swap = np.where(invert, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(invert, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] >> bit & 1)
    return index


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit vectors on one curve: an own random projection, shifted by a random part of a cell grid."""
    dim = unit.shape[1]
    rng = np.random.default_rng(1000 + curve)
    axes = np.linalg.qr(rng.normal(size=(dim, min(AXES, dim))))[0]
    spread = 3 / np.sqrt(dim)
    scaled = (unit @ axes / spread + 1) / 2 + rng.uniform(-0.25, 0.25, axes.shape[1])
    return hilbert_index(np.clip(scaled * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def normed(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector to others in double precision; a row's value does not depend on the other rows."""
    return (rows * q).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((q * q).sum()))


def _best(q: np.ndarray, rows: np.ndarray, near: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and cosines of the `take` nearest rows, all that tie with the last included; near: approximate cosines."""
    if len(near) > take:
        last = np.partition(near, len(near) - take)[len(near) - take]
        chosen = np.flatnonzero(near >= last - SLACK)
    else:
        chosen = np.arange(len(near))
    return chosen, cosines(q, rows[chosen])


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    found = list(batches)
    return pa.Table.from_batches(found).combine_chunks() if sum(map(len, found)) else None


def _distinct(rows: DataFrame, take: int) -> DataFrame:
    """Distinct vectors (key, vec, ids, is_query) with their `take` smallest ids, which is all that a result can need.

    Ranks are limited before the shuffle, so that copies of one vector do not meet.
    """
    order = Window.partitionBy("key", "vec").orderBy("vec_id")
    ids = rows.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= take)
    ids = ids.groupBy("key", "vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    asked = rows.where("is_query").select("key").distinct().withColumn("is_query", F.lit(True))
    return ids.join(asked, "key", "left").withColumn("is_query", F.coalesce("is_query", F.lit(False)))


def _on_curve(distinct: DataFrame, curve: int, parts: int) -> DataFrame:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = curve_keys(normed(vectors_of(batch.column("vec"))), curve)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*batch.schema.names, "place"])

    placed = distinct.select("key", "vec", "is_query").mapInArrow(keyed, "key string, vec array<double>, is_query boolean, place long")
    return placed.repartitionByRange(parts, "place", "key").sortWithinPartitions("place", "key")


def _windows(ordered: DataFrame, take: int) -> DataFrame:
    """Nearest rows among the REACH neighbours on both sides of each query on a curve: (query, candidate, score)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        x, keys = vectors_of(table.column("vec").chunk(0)), table.column("key").to_pylist()
        unit = normed(x)
        out: tuple[list, list, list] = ([], [], [])
        for i in np.flatnonzero(table.column("is_query").to_numpy(zero_copy_only=False)):
            low, high = max(i - REACH, 0), min(i + REACH + 1, len(x))
            chosen, score = _best(x[i], x[low:high], unit[low:high] @ unit[i], take)
            out[0].extend([keys[i]] * len(chosen))
            out[1].extend(keys[low + c] for c in chosen)
            out[2].extend(score.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["query", "candidate", "score"])

    return ordered.mapInArrow(search, "query string, candidate string, score double")


def _blocks(ordered: DataFrame) -> DataFrame:
    """One row for each range of a curve: its vectors, their direction and the least cosine to it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        x = vectors_of(table.column("vec").chunk(0))
        unit = normed(x)
        centre = unit.sum(0)
        length = np.sqrt((centre * centre).sum())
        centre = centre / length if length > 0 else unit[0]
        yield pa.RecordBatch.from_arrays([
            pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float((unit @ centre).min())]),
            pa.array([x.tobytes()], pa.binary()), pa.array([table.column("key").to_pylist()], pa.list_(pa.string())),
        ], names=["block", "centre", "least", "packed", "keys"])

    return ordered.mapInArrow(pack, "block long, centre array<double>, least double, packed binary, keys array<string>")


def _probes(queries: DataFrame, summaries: list, chunks: int) -> DataFrame:
    """The blocks that may hold a vector at least as near as the worst one found so far: (block, chunk, query, vec, worst)."""
    shared = queries.sparkSession.sparkContext.broadcast((np.array([s["block"] for s in summaries]), np.array([s["centre"] for s in summaries]), np.array([s["least"] for s in summaries])))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, centres, least = shared.value
        radius = np.arccos(np.clip(least, -1, 1))
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                unit = normed(vectors_of(part.column("vec")))
                angle = np.arccos(np.clip(unit @ centres.T, -1, 1)) - radius
                worst = part.column("worst").to_numpy()
                q, b = np.nonzero(np.cos(np.maximum(angle, 0)) >= worst[:, None] - 1e-6)
                yield pa.RecordBatch.from_arrays([pa.array(blocks[b])] + [part.column(c).take(pa.array(q)) for c in ("chunk", "key", "vec", "worst")], names=["block", "chunk", "query", "vec", "worst"])

    chunked = queries.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)))
    return chunked.select("chunk", "key", "vec", "worst").mapInArrow(route, "block long, chunk long, query string, vec array<double>, worst double")


def _complete(probes: DataFrame, blocks: DataFrame, chunks: int, take: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                asked = batch.column("asked")[row]
                x = np.frombuffer(batch.column("packed")[row].as_py()).reshape(len(batch.column("keys")[row]), -1)
                keys, unit = batch.column("keys")[row].as_py(), normed(x)
                out: tuple[list, list, list] = ([], [], [])
                q = vectors_of(asked.values.field("vec"))
                near = normed(q) @ unit.T
                for i, (name, worst) in enumerate(zip(asked.values.field("query").to_pylist(), asked.values.field("worst").to_pylist(), strict=True)):
                    close = np.flatnonzero(near[i] >= worst - 1e-6)
                    chosen, score = _best(q[i], x[close], near[i][close], take)
                    out[0].extend([name] * len(chosen))
                    out[1].extend(keys[close[c]] for c in chosen)
                    out[2].extend(score.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["query", "candidate", "score"])

    asked = probes.groupBy("block", "chunk").agg(F.collect_list(F.struct("query", "vec", "worst")).alias("asked"))
    held = blocks.select("block", "packed", "keys", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    return asked.join(held, ["block", "chunk"]).select("asked", "packed", "keys").mapInArrow(search, "query string, candidate string, score double")


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5, complete: bool = True) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest other rows by cosine, nearest first, ties to the smaller id.

    Four Hilbert curves order the projected vectors, each with its own projection and shift. On each, ranges of about 1024
    rows are sorted and every query is compared with its 128 neighbours on both sides. With `complete`, the worst of the k+1
    found then decides which ranges of the first curve may hold nearer vectors (angle to the range's direction less the
    range's radius), and these are searched as blocks: the result is exact. Without it, it is the windows' alone.

    Null ids, and vectors that are null, zero, or hold null or non-finite components take no part; nor do those whose length
    is not the most frequent one. Equal vectors are searched once and listed by their ids; a row that is repeated with its id
    counts once. Other columns are ignored; without queries or with a single vector there are no rows. Directions of
    65,536 ranges at most are broadcast.
    """
    take = k + 1
    vec = F.transform("embedding", lambda v: v.cast("double"))
    rows = embeddings.select("vec_id", vec.alias("vec"), is_query.alias("is_query")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = rows.where(fine)
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    none = embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if length is None:
        return none
    rows = rows.where(F.size("vec") == length["n"])
    rows = rows.withColumn("key", F.concat(F.hex(F.xxhash64("vec")), F.lit("-"), F.hex(F.hash("vec"))))
    distinct = cut_lineage(_distinct(rows, take))
    n = distinct.count()
    parts = ceil(n / max(BLOCK_ROWS, ceil(n / MOST_BLOCKS)))
    curves = [_on_curve(distinct, c, parts) for c in range(CURVES)]
    found = _windows(curves[0], take)
    for ordered in curves[1:]:
        found = found.unionByName(_windows(ordered, take))
    found = cut_lineage(found.distinct())
    if complete:
        blocks = cut_lineage(_blocks(curves[0]))
        queries = found.groupBy("query").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
        queries = queries.select(F.col("query").alias("key"), F.coalesce(F.get("scores", F.lit(take - 1)), F.lit(-1.0)).alias("worst")).join(distinct.select("key", "vec"), "key")
        queries = cut_lineage(queries)
        chunks = ceil(max(queries.count(), 1) / PROBES_AT_ONCE)
        probes = _probes(queries, blocks.select("block", "centre", "least").collect(), chunks)
        found = found.unionByName(_complete(probes, blocks, chunks, take)).distinct()
    ids = distinct.select(F.col("key").alias("candidate"), "ids")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    found = found.join(ids, "candidate").withColumn("place", F.row_number().over(best)).where(F.col("place") <= take)
    listed = found.select("query", "score", F.explode("ids").alias("vec_id"))
    asked = rows.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("key").alias("query")).distinct()
    pairs = asked.join(listed, "query").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
