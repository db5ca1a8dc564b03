"""Queries over traces and window throughputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import encode, windows
from tracemill.plans import bindings as b
from tracemill.plans.catalog import query, rounded

K = 40

# Window counts of the derived trace.
COUNTS_SQL = f"""g AS (SELECT trace_id, CAST(idx // {K} AS BIGINT) AS window_id, count(*) AS size,
  count(*) FILTER (op_class = 'IntAlu') AS n_alu, CAST(0 AS BIGINT) AS n_mult_div, CAST(0 AS BIGINT) AS n_fp,
  count(*) FILTER (op_class = 'FloatMult') AS n_fp_mult_div,
  count(*) FILTER (len(read_addrs) > 0) AS n_load, count(*) FILTER (len(write_addrs) > 0) AS n_store,
  count(*) FILTER (inst_sync) AS n_sync, count(*) FILTER (branch_type = 'direct_conditional') AS n_direct_cond,
  count(*) FILTER (branch_type = 'direct_unconditional') AS n_direct_uncond, count(*) FILTER (branch_type = 'indirect') AS n_indirect
  FROM t GROUP BY ALL)"""
WITH_COUNTS = f"WITH {b.T_SQL}, {COUNTS_SQL}"


def counts(spark, sf_dir):
    return windows.window_counts(b.trace(spark, sf_dir), K)


@query("e2_window_counts", f"{WITH_COUNTS} SELECT * FROM g")
def _(spark, sf_dir):
    return counts(spark, sf_dir)


# Category bits of some opcode mnemonics (the dimension that a caller supplies).
OPCODES = [
    ("ADD", 0x01), ("CMP", 0x01), ("JNZ", 0x01), ("PUSH", 0x21), ("POP", 0x11), ("IMUL", 0x02), ("IDIV", 0x02), ("PADDB", 0x04), ("PCMPGTQ", 0x04),
    ("VPTEST", 0x04), ("MOVNTDQA", 0x14), ("ADDSD", 0x08), ("CVTSI2SD", 0x08), ("UCOMISD", 0x08), ("MULPD", 0x40), ("SQRTSS", 0x40), ("STOSQ", 0x20),
]
UNKNOWN = "UNLISTED"
_NAMES = [name for name, _ in OPCODES] + [UNKNOWN]
_MASK = "CASE opcode " + " ".join(f"WHEN '{name}' THEN {mask}" for name, mask in OPCODES) + " ELSE 0 END"
OPCODE_COUNTS_SQL = f"""o AS (SELECT *, list_extract({_NAMES}, CAST((ip // 4 + idx) % {len(_NAMES)} + 1 AS BIGINT)) AS opcode FROM t), m AS (SELECT *, {_MASK} AS mask FROM o),
  g AS (SELECT trace_id, CAST(idx // {K} AS BIGINT) AS window_id, count(*) AS size, count(*) FILTER (mask & 1 > 0) AS n_alu, count(*) FILTER (mask & 2 > 0) AS n_mult_div,
    count(*) FILTER (mask & 8 > 0) AS n_fp, count(*) FILTER (mask & 64 > 0) AS n_fp_mult_div FROM m GROUP BY ALL)"""


def opcode_counts(spark, sf_dir):
    """Window counts of the trace with a mnemonic on every row, classed by the caller's dimension."""
    place = (F.floor(F.col("ip") / 4) + F.col("idx")) % len(_NAMES)
    t = b.trace(spark, sf_dir).withColumn("opcode", F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (place + 1).cast("int")))
    return windows.window_counts(t, K, spark.createDataFrame(OPCODES, "opcode string, mask int"))


@query("e2_opcode_counts", f"WITH {b.T_SQL}, {OPCODE_COUNTS_SQL} SELECT * FROM g")
def _(spark, sf_dir):
    return opcode_counts(spark, sf_dir).select("trace_id", "window_id", "size", "n_alu", "n_mult_div", "n_fp", "n_fp_mult_div")


@query("e1_ordinal_windows", f"WITH {b.T_SQL} SELECT trace_id, CAST(idx // {K} AS BIGINT) AS window_id, min(idx) AS first_idx, max(idx) AS last_idx FROM t GROUP BY ALL")
def _(spark, sf_dir):
    w = windows.ordinal_windows(b.trace(spark, sf_dir), K)
    return w.groupBy("trace_id", "window_id").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def _issue_sql(n: str, top: int) -> str:
    return f"""SELECT trace_id, CAST(w.p0 AS INT) AS p0, window_id,
      round(CASE WHEN {n} = 0 THEN size ELSE size / greatest({n} / CAST(w.p0 AS DOUBLE), 1.0E0) END, 6) AS thr
      FROM g, range(1, {top + 1}) w(p0)"""


def _issue_query(resource):
    def run(spark, sf_dir):
        out = windows.issue_throughput(counts(spark, sf_dir), resource)
        return rounded(out.select("trace_id", "p0", "window_id", "thr"))
    return run


for _name, _resource, _n, _top in [
    ("e4_alu_issue", "alu_issue", "n_alu", 8),
    ("e4_alu_mult_div_issue", "alu_mult_div_issue", "n_mult_div", 8),
    ("e4_fp_issue", "fp_issue", "n_fp", 8),
    ("e4_fp_mult_div_issue", "fp_mult_div_issue", "n_fp_mult_div", 8),
    ("e4_ls_issue", "ls_issue", "(n_load + n_store)", 16),
]:
    query(_name, f"{WITH_COUNTS} {_issue_sql(_n, _top)}")(_issue_query(_resource))

def _opcode_issue_query(resource):
    def run(spark, sf_dir):
        return rounded(windows.issue_throughput(opcode_counts(spark, sf_dir), resource).select("trace_id", "p0", "window_id", "thr"))
    return run


for _name, _resource, _n in [("e4_opcode_mult_div", "alu_mult_div_issue", "n_mult_div"), ("e4_opcode_fp", "fp_issue", "n_fp")]:
    query(_name, f"WITH {b.T_SQL}, {OPCODE_COUNTS_SQL} {_issue_sql(_n, 8)}")(_opcode_issue_query(_resource))

_LOWER = "CASE WHEN n_load + n_store = 0 THEN size ELSE size / (n_load / CAST(p0 + p1 AS DOUBLE) + n_store / CAST(p0 AS DOUBLE)) END"
_UPPER = """CASE WHEN n_load + n_store = 0 THEN size ELSE size / (n_store / CAST(p0 AS DOUBLE)
  + greatest(0.0E0, n_load - n_store / CAST(p0 AS DOUBLE) * p1) / CAST(p0 + p1 AS DOUBLE)) END"""


def _pipes_sql(expr: str) -> str:
    return f"""{WITH_COUNTS} SELECT trace_id, CAST(p0 AS INT) AS p0, CAST(p1 AS INT) AS p1, window_id, round({expr}, 6) AS thr
      FROM g, range(1, 9) a(p0), range(1, 9) bb(p1)"""


@query("e5_pipes_lower", _pipes_sql(_LOWER))
def _(spark, sf_dir):
    out = windows.issue_throughput(counts(spark, sf_dir), "load_ls_pipes_lower")
    return rounded(out.drop("resource"))


@query("e6_pipes_upper", _pipes_sql(_UPPER))
def _(spark, sf_dir):
    out = windows.issue_throughput(counts(spark, sf_dir), "load_ls_pipes_upper")
    return rounded(out.drop("resource"))


_ISSUE = "CASE WHEN {n} = 0 THEN size ELSE size / greatest({n} / CAST(p0 AS DOUBLE), 1.0E0) END"
_ALL = " UNION ALL ".join(
    [
        f"SELECT trace_id, '{r}' AS resource, CAST(p0 AS INT) AS p0, 0 AS p1, window_id, {_ISSUE.format(n=n)} AS thr FROM g, range(1, {top + 1}) w(p0)"
        for r, n, top in [
            ("alu_issue", "n_alu", 8), ("alu_mult_div_issue", "n_mult_div", 8), ("fp_issue", "n_fp", 8),
            ("fp_mult_div_issue", "n_fp_mult_div", 8), ("ls_issue", "(n_load + n_store)", 16),
        ]
    ]
    + [
        f"SELECT trace_id, '{r}' AS resource, CAST(p0 AS INT) AS p0, CAST(p1 AS INT) AS p1, window_id, {e} AS thr FROM g, range(1, 9) a(p0), range(1, 9) bb(p1)"
        for r, e in [("load_ls_pipes_lower", _LOWER), ("load_ls_pipes_upper", _UPPER)]
    ]
)
THR_SQL = f"{WITH_COUNTS}, x AS ({_ALL})"


@query("e7_window_throughput", f"{THR_SQL} SELECT trace_id, resource, p0, p1, window_id, round(thr, 6) AS thr FROM x")
def _(spark, sf_dir):
    return rounded(windows.window_throughput(counts(spark, sf_dir)))


@query(
    "e7_single_config",
    f"""{THR_SQL} SELECT trace_id, resource, p0, p1, window_id, round(thr, 6) AS thr FROM x WHERE
      (resource = 'alu_issue' AND p0 = 4) OR (resource = 'alu_mult_div_issue' AND p0 = 2) OR (resource = 'fp_issue' AND p0 = 4)
      OR (resource = 'fp_mult_div_issue' AND p0 = 2) OR (resource = 'ls_issue' AND p0 = 2)
      OR (resource LIKE 'load_ls%' AND p0 = 2 AND p1 = 2)""",
)
def _(spark, sf_dir):
    from tracemill.functions.registry import REGISTRY
    defaults = {p.name: p.default for p in REGISTRY.params}
    return rounded(windows.single_config_throughput(counts(spark, sf_dir), defaults))


@query(
    "d30_throughput_summary",
    f"""{THR_SQL} SELECT resource, p0, p1, count(thr) AS n_windows, round(avg(thr), 6) AS avg_thr,
      round(min(thr), 6) AS min_thr, round(max(thr), 6) AS max_thr FROM x GROUP BY ALL""",
)
def _(spark, sf_dir):
    return rounded(encode.throughput_summary(windows.window_throughput(counts(spark, sf_dir))))


@query(
    "u1_custom_bound",
    f"""{WITH_COUNTS} SELECT trace_id, CAST(w.p0 AS INT) AS p0, window_id, round(size / (1.0E0 + n_sync * w.p0), 6) AS thr
      FROM g, (VALUES (1), (2), (4), (8)) w(p0)""",
)
def _(spark, sf_dir):
    from tracemill.functions.registry import REGISTRY, Param, Resource
    registry = REGISTRY.with_param(Param("sync_penalty", None, 1, 1, 8, "base2")).with_resource(Resource("sync_stall", ("sync_penalty",)))
    bound = {"sync_stall": lambda p0, p1: F.col("size") / (F.lit(1.0) + F.col("n_sync") * p0)}
    out = windows.issue_throughput(counts(spark, sf_dir), "sync_stall", registry, bound)
    return rounded(out.select("trace_id", "p0", "window_id", "thr"))


@query(
    "minimum_slice",
    f"""{WITH_COUNTS}, x AS (SELECT trace_id, CAST(w.p0 AS INT) AS p0,
      CASE WHEN n_alu = 0 THEN size ELSE size / greatest(n_alu / CAST(w.p0 AS DOUBLE), 1.0E0) END AS thr FROM g, range(1, 9) w(p0))
      SELECT trace_id, p0, round(quantile_cont(thr, 0.01) + 1e-9, 5) AS p1, round(quantile_cont(thr, 0.5) + 1e-9, 5) AS p50,
      round(quantile_cont(thr, 0.99) + 1e-9, 5) AS p99 FROM x GROUP BY ALL""",
)
def flagship(spark, sf_dir):
    """Issue-width bound per window, then its distribution per trace and width."""
    thr = windows.issue_throughput(counts(spark, sf_dir), "alu_issue")
    d = encode.distribution(thr, ["trace_id", "p0"], "thr", points=[1, 50, 99], weighted=False)
    v = lambda i: F.element_at("raw", i)
    return rounded(d.select("trace_id", "p0", v(1).alias("p1"), v(2).alias("p50"), v(3).alias("p99")), 5, 1e-9)


WKEYS = "trace_id, resource, p0"
# Sorted samples with running weights; the percentile range join and interpolation follow.
WEIGHTED_SQL = f"""ws AS (SELECT {WKEYS}, thr AS x, greatest(thr, 0) AS wt,
    sum(greatest(thr, 0)) OVER o AS cw, sum(greatest(thr, 0)) OVER (PARTITION BY {WKEYS}) AS tw,
    lag(thr) OVER o AS px, row_number() OVER o AS rn, count(*) OVER (PARTITION BY {WKEYS}) AS n
    FROM w WINDOW o AS (PARTITION BY {WKEYS} ORDER BY thr ROWS UNBOUNDED PRECEDING)),
  wp AS (SELECT {WKEYS}, pt, CASE WHEN px IS NULL OR wt = 0 THEN x ELSE px + (x - px) * ((pt / 100.0E0 * tw - (cw - wt)) / wt) END AS v
    FROM ws, range(1, 100, 2) q(pt) WHERE wt > 0 AND pt / 100.0E0 * tw > cw - wt AND (pt / 100.0E0 * tw <= cw OR rn = n)),
  wr AS (SELECT {WKEYS}, unnest(range(1, 100, 2)) AS pt, unnest(quantile_cont(thr, [{', '.join(str(p / 100) for p in range(1, 100, 2))}])) AS v FROM w GROUP BY {WKEYS})"""


def _long(df, keys, vec):
    return rounded(df.select(*keys, F.posexplode(vec).alias("pos", "v")).select(*keys, "pos", "v"), 5, 1e-9)


RAW_LONG = f"SELECT {WKEYS}, CAST((pt - 1) // 2 AS INT) AS pos, round(v + 1e-9, 5) AS v FROM wr"
WEIGHTED_LONG = f"""SELECT {WKEYS}, CAST((pt - 1) // 2 AS INT) AS pos, round(coalesce(wp.v, wr.v) + 1e-9, 5) AS v FROM wr LEFT JOIN wp USING ({WKEYS}, pt)"""


@query("d14_cdf_raw", f"WITH {b.W_SQL}, {WEIGHTED_SQL} {RAW_LONG}")
def _(spark, sf_dir):
    keys = ["trace_id", "resource", "p0"]
    return _long(encode.cdf_raw(b.window_thr(spark, sf_dir), keys, "thr"), keys, "raw")


@query("d15_cdf_weighted", f"WITH {b.W_SQL}, {WEIGHTED_SQL} {WEIGHTED_LONG}")
def _(spark, sf_dir):
    keys = ["trace_id", "resource", "p0"]
    return _long(encode.cdf_weighted(b.window_thr(spark, sf_dir), keys, "thr"), keys, "weighted")


VEC_SQL = f"""WITH {b.W_SQL}, {WEIGHTED_SQL}, vv AS (
    SELECT {WKEYS}, CAST((pt - 1) // 2 AS INT) AS pos, v FROM wr
    UNION ALL SELECT {WKEYS}, CAST(50 + (pt - 1) // 2 AS INT), coalesce(wp.v, wr.v) FROM wr LEFT JOIN wp USING ({WKEYS}, pt)
    UNION ALL SELECT {WKEYS}, 100, avg(thr) FROM w GROUP BY ALL)"""


@query("d16_cdf_encode", f"{VEC_SQL} SELECT {WKEYS}, pos, round(v + 1e-9, 5) AS v FROM vv")
def _(spark, sf_dir):
    keys = ["trace_id", "resource", "p0"]
    return _long(encode.cdf_encode(b.window_thr(spark, sf_dir), keys, "thr"), keys, "vec")


@query("d17_build_lookup", f"{VEC_SQL} SELECT trace_id, resource, CAST(0 AS INT) AS cfg_idx, p0, CAST(0 AS INT) AS p1, pos, round(v + 1e-9, 5) AS v FROM vv")
def _(spark, sf_dir):
    return _long(encode.build_lookup(b.window_thr(spark, sf_dir)), encode.LOOKUP_KEYS, "vec")


@query("d17_lookup_stats", f"WITH {b.W_SQL} SELECT trace_id, resource, count(DISTINCT p0) AS n_entries FROM w GROUP BY ALL")
def _(spark, sf_dir):
    return encode.lookup_stats(encode.build_lookup(b.window_thr(spark, sf_dir)))


@query(
    "e9_cumulative_weight",
    f"""WITH {b.W_SQL}, u AS (SELECT {WKEYS}, thr AS x, count(*) AS copies, sum(greatest(thr, 0)) AS wt FROM w GROUP BY ALL)
      SELECT {WKEYS}, x, copies, round(sum(wt) OVER (PARTITION BY {WKEYS} ORDER BY x) / sum(wt) OVER (PARTITION BY {WKEYS}), 6) AS cum_weight FROM u""",
)
def _(spark, sf_dir):
    keys = ["trace_id", "resource", "p0"]
    h = encode.cumulative_weight(b.window_thr(spark, sf_dir), keys, "thr")
    return rounded(h)
