"""Queries over lookup vectors, stall and queue blocks and the training matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.registry import Param, Registry, Resource
from tracemill.operators import encode, matrix, similarity, windows
from tracemill.plans import bindings as b
from tracemill.plans.catalog import query, rounded
from tracemill.plans.trace_queries import K, THR_SQL, VEC_SQL, WITH_COUNTS
from tracemill.plans.trace_queries import counts as trace_counts

# Three swept resources over the throughputs of `w`, one parameter each.
REG = Registry(
    (Param("pa", None, 1, 1, 8), Param("pb", None, 1, 1, 8), Param("pc", None, 1, 1, 8), Param("branch_predictor", None, 0, 0, 1), Param("l1d_stride_prefetch", None, 0, step=(0, 4))),
    (Resource("0", ("pa",)), Resource("1", ("pb",)), Resource("2", ("pc",))),
)
CONFIGS_SQL = """cg AS (SELECT trace_id, pa, pb, pc, branch_predictor, l1d_stride_prefetch, CAST(pa AS VARCHAR) || '-' || CAST(pb AS VARCHAR) || '-' || CAST(pc AS VARCHAR) || '-' || CAST(branch_predictor AS VARCHAR)
    || '-' || CAST(l1d_stride_prefetch AS VARCHAR) AS cid
  FROM (SELECT DISTINCT l_returnflag AS trace_id, l_suppkey % 8 + 1 AS pa, l_partkey % 8 + 1 AS pb, l_orderkey % 8 + 1 AS pc, CAST(l_linestatus = 'O' AS INT) AS branch_predictor,
    l_linenumber % 2 * 4 AS l1d_stride_prefetch FROM lineitem))"""


def configs(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("trace_id"), (F.col("l_suppkey") % 8 + 1).alias("pa"), (F.col("l_partkey") % 8 + 1).alias("pb"),
        (F.col("l_orderkey") % 8 + 1).alias("pc"), (F.col("l_linestatus") == "O").cast("int").alias("branch_predictor"),
        (F.col("l_linenumber") % 2 * 4).alias("l1d_stride_prefetch"),
    ).distinct()
    return li.withColumn("cid", F.concat_ws("-", *[F.col(c).cast("string") for c in ("pa", "pb", "pc", "branch_predictor", "l1d_stride_prefetch")]))


def lookup(spark, sf_dir):
    thr = b.window_thr(spark, sf_dir).withColumn("resource", F.col("resource").cast("string"))
    return encode.build_lookup(thr)


# Whole vectors would make a very long result, so vectors are compared by length,
# by a position-weighted sum over all entries, and by three entries.
def _digest(vec: str):
    total = F.aggregate(F.zip_with(vec, F.sequence(F.lit(1), F.size(vec)), lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return [F.size(vec).alias("n"), F.round(total / F.size(vec), 4).alias("weighted_sum")]


_LV = """lv AS (SELECT trace_id, CAST(resource AS INT) AS res, p0, sum(v) AS sv, sum(v * (pos + 1)) AS spv FROM vv GROUP BY ALL)"""


@query(
    "c5_lookup_features",
    f"""{VEC_SQL}, {CONFIGS_SQL}, {_LV} SELECT cg.trace_id, cid, 303 AS n, round((a.spv + bb.spv + 101 * bb.sv + c.spv + 202 * c.sv) / 303, 4) AS weighted_sum
      FROM cg JOIN lv a ON a.trace_id = cg.trace_id AND a.res = 0 AND a.p0 = pa JOIN lv bb ON bb.trace_id = cg.trace_id AND bb.res = 1 AND bb.p0 = pb
      JOIN lv c ON c.trace_id = cg.trace_id AND c.res = 2 AND c.p0 = pc""",
)
def _(spark, sf_dir):
    out = matrix.lookup_features(configs(spark, sf_dir), lookup(spark, sf_dir), ["trace_id", "cid"], REG)
    return out.select("trace_id", "cid", *_digest("vec"))


# Distribution of stall counts per trace and kind, encoded like the throughputs of `w`.
STALL_SQL = f"""{WITH_COUNTS}, sc AS (SELECT trace_id, 0 AS kind, n_sync AS x FROM g UNION ALL SELECT trace_id, 1, n_direct_cond FROM g
    UNION ALL SELECT trace_id, 2, n_direct_uncond FROM g UNION ALL SELECT trace_id, 3, n_indirect FROM g)"""


def encode_sql(rows: str, keys: str, tag: str = "e") -> str:
    """CTEs turning table `rows`(keys, x) into `ev`(keys, pos, v): the 101-number encoding. `tag` takes the place of the e."""
    quantiles = ", ".join(str(p / 100) for p in range(1, 100, 2))
    return f"""{tag}s AS (SELECT {keys}, x, greatest(x, 0) AS wt, sum(greatest(x, 0)) OVER o AS cw, sum(greatest(x, 0)) OVER (PARTITION BY {keys}) AS tw,
        lag(x) OVER o AS px, row_number() OVER o AS rn, count(*) OVER (PARTITION BY {keys}) AS n FROM {rows} WINDOW o AS (PARTITION BY {keys} ORDER BY x ROWS UNBOUNDED PRECEDING)),
      {tag}p AS (SELECT {keys}, pt, CASE WHEN px IS NULL THEN x ELSE px + (x - px) * ((pt / 100.0E0 * tw - (cw - wt)) / wt) END AS v
        FROM {tag}s, range(1, 100, 2) q(pt) WHERE wt > 0 AND pt / 100.0E0 * tw > cw - wt AND (pt / 100.0E0 * tw <= cw OR rn = n)),
      {tag}r AS (SELECT {keys}, unnest(range(1, 100, 2)) AS pt, unnest(quantile_cont(x, [{quantiles}])) AS v FROM {rows} GROUP BY {keys}),
      {tag}v AS (SELECT {keys}, CAST((pt - 1) // 2 AS INT) AS pos, v FROM {tag}r UNION ALL SELECT {keys}, CAST(50 + (pt - 1) // 2 AS INT), coalesce({tag}p.v, {tag}r.v) FROM {tag}r LEFT JOIN {tag}p USING ({keys}, pt)
        UNION ALL SELECT {keys}, 100, avg(x) FROM {rows} GROUP BY {keys})"""


@query("d18_stall_features", f"{STALL_SQL}, {encode_sql('sc', 'trace_id, kind')} SELECT trace_id, CAST(kind * 101 + pos AS INT) AS pos, round(v + 1e-9, 5) AS v FROM ev")
def _(spark, sf_dir):
    s = matrix.stall_features(b.trace(spark, sf_dir), K)
    return rounded(s.select("trace_id", F.posexplode("vec").alias("pos", "v")), 5, 1e-9)


# Queue latencies derived from the events: three queue sizes per instruction.
QUEUE_SQL = """q AS (SELECT user_id % 8 AS trace_id, 0 AS cfg_idx, size, event_id AS idx, CAST(floor(value * 10) AS BIGINT) % (16 * size) AS issue,
    CAST(floor(value * 10) AS BIGINT) % (16 * size) + CAST(floor(value) AS BIGINT) % 32 AS commit, CAST(floor(value * 100) AS BIGINT) % (24 + size) AS exec
    FROM events, (VALUES (1), (2), (4)) z(size)),
  qo AS (SELECT trace_id, cfg_idx, size, 100.0E0 / (size + avg(issue)) AS thr FROM q GROUP BY trace_id, cfg_idx, size),
  qr AS (SELECT trace_id, cfg_idx, 1 AS part, size, CAST(issue AS DOUBLE) AS x FROM q UNION ALL SELECT trace_id, cfg_idx, 2, size, commit FROM q
    UNION ALL SELECT trace_id, cfg_idx, 3, 0, avg(exec) FROM q GROUP BY trace_id, cfg_idx, idx)"""


def queue(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events").select("event_id", "user_id", "value").withColumn("size", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    v10, v100, v1 = F.floor(F.col("value") * 10), F.floor(F.col("value") * 100), F.floor("value")
    q = ev.select(
        (F.col("user_id") % 8).alias("trace_id"), F.lit(0).alias("cfg_idx"), "size", F.col("event_id").alias("idx"),
        (v10 % (F.col("size") * 16)).alias("issue"), (v10 % (F.col("size") * 16) + v1 % 32).alias("commit"), (v100 % (F.col("size") + 24)).alias("exec"),
    )
    return q, q.groupBy("trace_id", "cfg_idx", "size").agg((F.lit(100.0) / (F.col("size") + F.avg("issue"))).alias("thr"))


_QPOS = """SELECT trace_id, CAST(CASE part WHEN 1 THEN 3 + list_position([1, 2, 4], size) * 101 - 101 WHEN 2 THEN 306 + list_position([1, 2, 4], size) * 101 - 101 ELSE 609 END + pos AS INT) AS pos, v FROM ev
  UNION ALL SELECT trace_id, CAST(list_position([1, 2, 4], size) - 1 AS INT), thr FROM qo"""


@query("d19_queue_latency_features", f"WITH {QUEUE_SQL}, {encode_sql('qr', 'trace_id, cfg_idx, part, size')}, qv AS ({_QPOS}) SELECT trace_id, pos, round(v + 1e-9, 5) AS v FROM qv")
def _(spark, sf_dir):
    out = matrix.queue_latency_features(*queue(spark, sf_dir))
    return rounded(out.select("trace_id", F.posexplode("vec").alias("pos", "v")), 5, 1e-9)


# The throughput traces A, N, R are matched with traces 0, 1, 2 of the events.
@query(
    "d20_training_matrix",
    f"""{VEC_SQL}, {CONFIGS_SQL}, {_LV}, {STALL_SQL.removeprefix('WITH ')}, {encode_sql('sc', 'trace_id, kind')},
      st AS (SELECT CASE trace_id WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' END AS trace_id, sum(v) AS sv, sum(v * (kind * 101 + pos + 1)) AS spv FROM ev GROUP BY ALL)
      SELECT cg.trace_id, cid, 716 AS n, round((a.spv + bb.spv + 101 * bb.sv + c.spv + 202 * c.sv + st.spv + 303 * st.sv
        + 708 * pa + 709 * pb + 710 * pc + 711 * branch_predictor + 712 * l1d_stride_prefetch
        + 713 * CAST(branch_predictor = 0 AS INT) + 714 * CAST(branch_predictor = 1 AS INT) + 715 * CAST(l1d_stride_prefetch = 0 AS INT) + 716 * CAST(l1d_stride_prefetch <> 0 AS INT)) / 716, 4) AS weighted_sum
      FROM cg JOIN lv a ON a.trace_id = cg.trace_id AND a.res = 0 AND a.p0 = pa JOIN lv bb ON bb.trace_id = cg.trace_id AND bb.res = 1 AND bb.p0 = pb
      JOIN lv c ON c.trace_id = cg.trace_id AND c.res = 2 AND c.p0 = pc JOIN st ON st.trace_id = cg.trace_id""",
)
def _(spark, sf_dir):
    stalls = matrix.stall_features(b.trace(spark, sf_dir), K)
    named = F.when(F.col("trace_id") == 0, "A").when(F.col("trace_id") == 1, "N").when(F.col("trace_id") == 2, "R")
    out = matrix.training_matrix(configs(spark, sf_dir), lookup(spark, sf_dir), stalls.withColumn("trace_id", named), registry=REG)
    return out.select("trace_id", "cid", *_digest("features"))


# All blocks of the matrix: a one-parameter, a two-parameter and a latency-dependent resource, stalls, queues, scalars and
# the label, for every trace. Queue size 3 has no lookup row and cfg_idx 1 no queue block: both are filled with zeros.
FULL = Registry(
    (Param("aw", None, 1, 1, 8), Param("lp", None, 1, 1, 8), Param("dp", None, 1, 1, 8), Param("qs", None, 1, 1, 8), Param("branch_predictor", None, 0, 0, 1), Param("l1d_stride_prefetch", None, 0, step=(0, 4))),
    (Resource("alu_issue", ("aw",)), Resource("load_ls_pipes_lower", ("lp", "dp")), Resource("issue_queue", ("qs",), ("qs",))),
)
QUEUE_LEN = 3 + 2 * 3 * 101 + 101
_FULL_CONFIGS = """cg AS (SELECT o_custkey % 8 AS trace_id, o_orderkey % 4 + 1 AS qs, o_orderkey // 4 % 2 AS cfg_idx, avg(o_totalprice) AS cpi FROM orders GROUP BY ALL),
  cf AS (SELECT *, CAST(qs AS VARCHAR) || '-' || CAST(cfg_idx AS VARCHAR) AS cid, qs * 2 AS aw, qs AS lp, cfg_idx + 1 AS dp, cfg_idx AS branch_predictor, qs % 2 * 4 AS l1d_stride_prefetch FROM cg)"""
_FULL_LOOKUP = """lk AS (SELECT trace_id, 0 AS res, 0 AS cfg, p0, 0 AS p1, thr AS x FROM x WHERE resource = 'alu_issue' UNION ALL SELECT trace_id, 1, 0, p0, p1, thr FROM x WHERE resource = 'load_ls_pipes_lower'
    UNION ALL SELECT trace_id, 2, 0, size, 0, issue FROM q UNION ALL SELECT trace_id, 2, 1, size, 0, exec FROM q)"""
_FULL_SCALARS = ["aw", "lp", "dp", "qs", "branch_predictor", "l1d_stride_prefetch", "CAST(branch_predictor = 0 AS INT)", "CAST(branch_predictor = 1 AS INT)", "CAST(l1d_stride_prefetch = 0 AS INT)", "CAST(l1d_stride_prefetch <> 0 AS INT)"]


@query(
    "d20_full_matrix",
    f"""{THR_SQL}, {QUEUE_SQL}, {STALL_SQL.removeprefix(WITH_COUNTS + ', ')}, {_FULL_CONFIGS}, {_FULL_LOOKUP}, {encode_sql('lk', 'trace_id, res, cfg, p0, p1', 'l')},
      {encode_sql('sc', 'trace_id, kind', 's')}, {encode_sql('qr', 'trace_id, cfg_idx, part, size', 'e')}, qv AS ({_QPOS}),
      wanted AS (SELECT trace_id, cid, cpi, 0 AS res, 0 AS cfg, aw AS p0, 0 AS p1 FROM cf UNION ALL SELECT trace_id, cid, cpi, 1, 0, lp, dp FROM cf UNION ALL SELECT trace_id, cid, cpi, 2, cfg_idx, qs, 0 FROM cf),
      parts AS (
        SELECT trace_id, cid, cpi, res * 101 + i.pos AS pos, coalesce(v, 0.0E0) AS v FROM wanted CROSS JOIN range(101) i(pos) LEFT JOIN lv USING (trace_id, res, cfg, p0, p1, pos)
        UNION ALL SELECT trace_id, cid, cpi, 303 + kind * 101 + pos, v FROM cf JOIN sv USING (trace_id)
        UNION ALL SELECT cf.trace_id, cid, cpi, 707 + i.pos, coalesce(v, 0.0E0) FROM cf CROSS JOIN range({QUEUE_LEN}) i(pos) LEFT JOIN qv ON qv.trace_id = cf.trace_id AND qv.pos = i.pos AND cfg_idx = 0
        UNION ALL {' UNION ALL '.join(f'SELECT trace_id, cid, cpi, {707 + QUEUE_LEN + i}, {c} FROM cf' for i, c in enumerate(_FULL_SCALARS))})
      SELECT trace_id, cid, round(cpi, 4) AS cpi, CAST(pos AS INT) AS pos, round(v + 1e-9, 5) AS v FROM parts""",
)
def _(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 8).alias("trace_id"), (F.col("o_orderkey") % 4 + 1).alias("qs"), (F.floor(F.col("o_orderkey") / 4) % 2).alias("cfg_idx"), "o_totalprice")
    cf = o.groupBy("trace_id", "qs", "cfg_idx").agg(F.avg("o_totalprice").alias("cpi")).withColumns({
        "cid": F.concat_ws("-", "qs", "cfg_idx"), "aw": F.col("qs") * 2, "lp": F.col("qs"), "dp": F.col("cfg_idx") + 1, "branch_predictor": F.col("cfg_idx"),
        "l1d_stride_prefetch": F.col("qs") % 2 * 4,
    })
    counts = trace_counts(spark, sf_dir)
    plain = windows.window_throughput(counts, resources=["alu_issue", "load_ls_pipes_lower"]).withColumn("cfg_idx", F.lit(0))
    q, overall = queue(spark, sf_dir)
    dependent = q.select("trace_id", F.lit("issue_queue").alias("resource"), F.col("size").alias("p0"), F.lit(0).alias("p1"), F.col("idx").alias("window_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("cfg_idx"), F.col("issue").cast("double").alias("thr")), F.struct(F.lit(1).alias("cfg_idx"), F.col("exec").cast("double").alias("thr")))).alias("c"))
    dependent = dependent.select(*[c for c in dependent.columns if c != "c"], "c.*")
    lookup_rows = encode.build_lookup(plain.unionByName(dependent))
    out = matrix.training_matrix(
        cf, lookup_rows, matrix.stall_features(b.trace(spark, sf_dir), K), matrix.queue_latency_features(q, overall), FULL, ["trace_id", "cid"], on_missing="zero",
        label="cpi", queue_len=QUEUE_LEN)
    flat = out.select("trace_id", "cid", F.round("cpi", 4).alias("cpi"), F.posexplode("features").alias("pos", "v"))
    return flat.withColumn("v", F.round(F.col("v") + 1e-9, 5))


_COMBOS = "cb AS (SELECT resource, p0, row_number() OVER (PARTITION BY resource ORDER BY p0 DESC) - 1 AS pos FROM (SELECT DISTINCT resource, p0 * 3 AS p0 FROM w))"


@query(
    "c15_nearest_combo",
    f"""WITH {b.W_SQL}, {_COMBOS}, pk AS (SELECT DISTINCT l_partkey AS id, l_linenumber % 3 AS resource, l_partkey % 31 AS q0 FROM lineitem)
      SELECT id, pk.resource, q0, p0, abs(p0 - q0)::DOUBLE AS distance FROM pk JOIN cb USING (resource) QUALIFY row_number() OVER (PARTITION BY id, pk.resource, q0 ORDER BY abs(p0 - q0), pos) = 1""",
)
def _(spark, sf_dir):
    w = b.window_thr(spark, sf_dir).select("resource", (F.col("p0") * 3).alias("p0")).distinct()
    combos = w.select("resource", (-F.col("p0")).alias("pos"), "p0", F.lit(0).alias("p1"))
    picks = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), (F.col("l_linenumber") % 3).alias("resource"), (F.col("l_partkey") % 31).alias("q0"), F.lit(0).alias("q1")
    ).distinct()
    return similarity.nearest_combo(picks, combos, ["id"]).select("id", "resource", "q0", "p0", "distance")


@query(
    "c17_pairwise_distance",
    """WITH c AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
      m AS (SELECT label, pos, avg(v) AS v FROM c GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) AS norm FROM m GROUP BY ALL),
      u AS (SELECT m.label, pos, v / norm AS v FROM m JOIN n USING (label))
      SELECT x.label AS a, y.label AS b, round(sqrt(sum((x.v - y.v) ** 2)), 6) AS distance FROM u x JOIN u y USING (pos) GROUP BY ALL""",
)
def _(spark, sf_dir):
    e = b.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    mean = e.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    vec = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("vector"))
    return rounded(similarity.pairwise_distance(vec, "label"))
