"""Similarity of benchmarks, configurations and response curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import must
from tracemill.operators.ordered import dim_join
from tracemill.session import cut_lineage

QUERY_BLOCK = 1 << 14       # queries compared by one task at a time
TRAIN_BLOCK = 1 << 18       # training configurations compared by one task at a time
RUN_ROWS = 16               # training configurations that agree in the leading columns, on average, to be compared once
EQUAL = 1e-9                # scaled values this near are equal


def pairwise_distance(vectors: DataFrame, name: str = "benchmark", vector: str = "vector") -> DataFrame:
    """Euclidean distance of every two benchmarks after scaling each vector to unit length.

    One vector per benchmark, a small dimension. Pairs meet on the vector position, so the
    sum of squared differences is an ordinary grouped aggregation. A zero vector or a
    single benchmark fails the job.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    text = F.concat(F.lit("zero vector of benchmark "), F.col(name).cast("string"))
    unit = vectors.withColumn("_norm", norm).withColumn("_norm", must(F.col("_norm") > 0, text, F.col("_norm")))
    n = vectors.select(F.count(F.lit(1)).alias("n")).scalar()
    cells = unit.select(F.col(name), F.col("_norm"), F.posexplode(vector).alias("pos", "v")).select(
        name, "pos", (F.col("v").cast("double") / F.col("_norm")).alias("v")
    )
    a = cells.select(F.col(name).alias("a"), "pos", F.col("v").alias("va"))
    b = cells.select(F.col(name).alias("b"), "pos", F.col("v").alias("vb"))
    diff = F.col("va") - F.col("vb")
    enough = must(n >= 2, "a distance matrix needs at least two benchmarks", F.lit(True))
    return a.join(b, "pos").groupBy("a", "b").agg(F.sqrt(F.sum(diff * diff)).alias("distance")).filter(enough)


def response_curves(df: DataFrame, params: list[str], numeric: dict[str, Column], cpi: str = "cpi", tie_break: list[str] = ()) -> DataFrame:
    """One-factor-at-a-time curves: (param, benchmark, value, cpi).

    Rows that agree on every other parameter form a group; per (param, benchmark) the
    largest group with at least two points is the curve, of equal ones that with the earliest
    row. Rows are first counted by configuration, and only configurations are repeated for
    every parameter; the rows of the chosen ones are joined back once.
    `numeric` gives the numeric value of each parameter.
    """
    text = lambda names: F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(o).cast("string"), F.lit("\x00")) for o in names]))
    entries = F.explode(F.array(*[
        F.struct(F.lit(p).alias("param"), text([o for o in params if o != p]).alias("others"), numeric.get(p, F.col(p)).cast("double").alias("value"))
        for p in params
    ]))
    order = F.struct(*tie_break) if tie_break else F.lit(0)
    rows = df.withColumn("_config", text(params))
    configs = rows.groupBy("benchmark", "_config", *params).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    long = configs.select("benchmark", "_config", "_n", "_first", entries.alias("e")).select("benchmark", "_config", "_n", "_first", "e.*")
    groups = long.groupBy("param", "benchmark", "others").agg(F.sum("_n").alias("n"), F.min("_first").alias("_first")).filter(F.col("n") >= 2)
    chosen = groups.groupBy("param", "benchmark").agg(F.min_by("others", F.struct(-F.col("n"), F.col("_first"), F.col("others"))).alias("others"))
    picked = long.join(chosen, ["param", "benchmark", "others"]).select("param", "benchmark", "_config", "value")
    points = rows.select("benchmark", "_config", F.col(cpi).alias("cpi"), order.alias("_o"))
    return points.join(picked, ["benchmark", "_config"]).select("param", "benchmark", "value", "cpi", "_o")


def curve_points(curves: DataFrame) -> DataFrame:
    """One CPI per (param, benchmark, value): the last point of a repeated value."""
    return curves.groupBy("param", "benchmark", "value").agg(F.max_by("cpi", F.struct("_o", "cpi")).alias("cpi"))


def curve_distance(curves: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(param, a, b) -> L2 distance over the common values; NULL without overlap, 0 to itself.

    Curves meet on (param, value); the benchmark grid is the small dimension of names.
    """
    pts = curve_points(curves)
    a = pts.select("param", "value", F.col("benchmark").alias("a"), F.col("cpi").alias("ca"))
    b = pts.select("param", "value", F.col("benchmark").alias("b"), F.col("cpi").alias("cb"))
    d = F.col("ca") - F.col("cb")
    met = a.join(b, ["param", "value"]).groupBy("param", "a", "b").agg(F.sqrt(F.sum(d * d)).alias("distance"))
    names = benchmarks.select("benchmark").distinct().agg(F.array_sort(F.collect_set("benchmark")).alias("n")).scalar()
    grid = pts.select("param").distinct().withColumn("_n", names).withColumn("a", F.explode("_n")).withColumn("b", F.explode("_n")).drop("_n")
    out = grid.join(met, ["param", "a", "b"], "left")
    return out.withColumn("distance", F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(F.col("distance")))


def nearest_combo(picks: DataFrame, combos: DataFrame, id_cols: list[str]) -> DataFrame:
    """The swept combination that equals the picked parameters, else the nearest (L2), first on ties.

    `combos` has resource, pos, p0, p1: at most a few thousand swept values per resource,
    so each resource's list travels as one sorted array and no pairs are emitted.
    """
    lists = combos.groupBy("resource").agg(F.array_sort(F.collect_list(F.struct("pos", "p0", "p1"))).alias("_c"))
    d2 = lambda c: F.pow(c["p0"] - F.col("q0"), F.lit(2.0)) + F.pow(c["p1"] - F.col("q1"), F.lit(2.0))
    near = F.array_min(F.transform("_c", lambda c: F.struct(d2(c).alias("d2"), c["pos"].alias("pos"), c["p0"].alias("p0"), c["p1"].alias("p1"))))
    out = dim_join(picks, lists, ["resource"], "left").withColumn("_n", near)
    return out.select(*id_cols, "resource", "q0", "q1", F.col("_n.p0").alias("p0"), F.col("_n.p1").alias("p1"), F.sqrt("_n.d2").alias("distance"))


def _different(codes: np.ndarray, low: int, high: int) -> np.ndarray:
    """1 where a value number is outside low..high - 1."""
    if high == low + 1:
        return (codes != low).view(np.uint8)
    return ((codes < low) | (codes >= high)).view(np.uint8)


def _block_density(
    q: list[np.ndarray], t: list[np.ndarray], n_cat: int, spans: list[float], hamming_r: int, l2_r: float,
) -> list[tuple[int, int, int]]:
    """Smallest Hamming distance, rows within `hamming_r` and rows within `l2_r` of every query; columns, categoricals first.

    The training rows are sorted by their columns, those of few values first. A run of rows that agree in the leading
    columns is compared once in these, the other columns row by row as small value numbers. Rows with a query's
    categoricals are one stretch, the only one whose L2 distances are taken.
    """
    values, codes = zip(*(np.unique(c, return_inverse=True) for c in t), strict=True)
    order = sorted(range(len(t)), key=lambda i: (i >= n_cat, len(values[i])))
    codes = [c.astype(np.min_scalar_type(len(v))) for c, v in zip(codes, values, strict=True)]
    sorting = np.lexsort([codes[i] for i in reversed(order)])
    codes = [c[sorting] for c in codes]
    numeric = [c[sorting].astype(float) for c in t[n_cat:]]
    n = len(sorting)
    starts, leading, cells = np.zeros(1, np.int64), 0, np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k, i in enumerate(order):
        change[1:] |= codes[i][1:] != codes[i][:-1]
        firsts = np.flatnonzero(change)
        if k < n_cat:
            cells = firsts
        if len(firsts) * RUN_ROWS <= n:
            starts, leading = firsts, k + 1
    lengths = np.diff(starts, append=n)
    heads = {i: codes[i][starts] for i in order[:leading]}
    stretches = {tuple(int(codes[i][a]) for i in range(n_cat)): (a, z) for a, z in zip(cells, [*cells[1:], n], strict=True)}
    slack = [*[0] * n_cat, *(EQUAL * s for s in spans)]
    low = [np.searchsorted(v, c - e, "left") for v, c, e in zip(values, q, slack, strict=True)]
    high = [np.searchsorted(v, c + e, "right") for v, c, e in zip(values, q, slack, strict=True)]
    found = []
    for k in range(len(q[0])):
        run = np.zeros(len(starts), np.uint8)
        for i in order[:leading]:
            run += _different(heads[i], low[i][k], high[i][k])
        ham = np.repeat(run, lengths)
        for i in order[leading:]:
            ham += _different(codes[i], low[i][k], high[i][k])
        a, z = stretches.get(tuple(int(low[i][k]) for i in range(n_cat)), (0, 0)) if all(low[i][k] < high[i][k] for i in range(n_cat)) else (0, 0)
        squares = np.zeros(z - a)
        for column, c, s in zip(numeric, q[n_cat:], spans, strict=True):
            squares += np.square((float(c[k]) - column[a:z]) / s)
        found.append((int(ham.min()), int(np.count_nonzero(ham <= hamming_r)), int(np.count_nonzero(np.sqrt(squares) <= l2_r))))
    return found


def neighbor_density(
    queries: DataFrame, train: DataFrame, query_id: str, numeric: list[str], categorical: list[str],
    hamming_r: int = 10, l2_r: float = 0.5, query_block: int = QUERY_BLOCK, train_block: int = TRAIN_BLOCK,
) -> DataFrame:
    """Per query: smallest Hamming distance to a training configuration, how many lie within
    `hamming_r`, and how many with equal categoricals lie within `l2_r` on [0, 1]-scaled numerics.

    Distinct training configurations and queries are kept once and dealt into blocks; each pair of
    blocks is one bounded task that returns one partial row per query, so pairs never leave a task.
    """
    if len(numeric) + len(categorical) > 255:
        raise ValueError("more than 255 columns")
    cfg = cut_lineage(train.select(*numeric, *categorical).distinct())
    asked = cut_lineage(queries.select(F.col(query_id).cast("string").alias("qid"), *numeric, *categorical))
    edges = [f(F.col(c).cast("double")) for c in numeric for f in (F.min, F.max)]
    n_cfg, *edges = cfg.agg(F.count(F.lit(1)), *edges).first()
    spans = [hi - lo if hi is not None and hi > lo else 1.0 for lo, hi in zip(edges[::2], edges[1::2], strict=True)]
    t_blocks, q_blocks = -(-max(n_cfg, 1) // train_block), -(-max(asked.count(), 1) // query_block)

    names = [*(f"c{i}" for i in range(len(categorical))), *(f"n{i}" for i in range(len(numeric)))]
    plain = [*(F.xxhash64(F.col(c).cast("string")) for c in categorical), *(F.col(c).cast("double") for c in numeric)]
    plain = [c.alias(n) for c, n in zip(plain, names, strict=True)]
    deal = lambda cols, blocks: F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    t = cfg.select(deal([*numeric, *categorical], t_blocks).alias("tb"), every(q_blocks).alias("qb"), *plain)
    q = asked.select(deal(["qid"], q_blocks).alias("qb"), every(t_blocks).alias("tb"), "qid", *plain)

    def compare(qs: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or ts.empty:
            return pd.DataFrame({"qid": pd.Series(dtype="object"), **{c: pd.Series(dtype="int64") for c in ("h", "nh", "nl")}})
        columns = lambda pdf: [pdf[n].to_numpy() for n in names]
        out = pd.DataFrame(_block_density(columns(qs), columns(ts), len(categorical), spans, hamming_r, l2_r), columns=["h", "nh", "nl"])
        return out.assign(qid=qs["qid"].to_numpy())[["qid", "h", "nh", "nl"]]

    partial = q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb")).applyInPandas(compare, "qid string, h bigint, nh bigint, nl bigint")
    out = partial.groupBy("qid").agg(F.min("h").alias("min_hamming"), F.sum("nh").alias("n_within_hamming_r"), F.sum("nl").alias("n_within_l2_r"))
    return out.select(F.col("qid").cast(queries.schema[query_id].dataType).alias(query_id), "min_hamming", "n_within_hamming_r", "n_within_l2_r")
