"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import n_words
from tracemill.session import cut_lineage

LEAST_RUN = 1024
FEW_SOURCES = 100_000


def shuffle_key(doc_id: str | Column) -> Column:
    """Reproducible random order of documents: md5 of the id as text (null: of no text)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[float], budget_share: float, repeats: int) -> DataFrame:
    """Adds target to rows (source, source_size): min(repeats * size, level * weight), where the targets use up the budget.

    Sources by code point, null last, take the weights in turn. The level is found by adding capped sources in the order in
    which they reach their cap, which equals resharing the excess by weight until no source is above its cap.
    """
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    reach = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumns({
        "room": F.sum("source_size").over(every) * F.lit(float(budget_share)) - F.coalesce(F.sum("cap").over(reach), F.lit(0.0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(reach), F.lit(0.0)),
    })
    level = F.max(F.when(F.col("room") / F.col("open") <= F.col("cap") / F.col("weight"), F.col("room") / F.col("open"))).over(every)
    rows = rows.withColumn("level", level)
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget_share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Adds size, source_size, target, copies and taken to every document.

    size counts words (null text: 0). Each pass over a source's shuffled documents gives a document the virtual finish time
    (words of the source up to and with it, earlier passes included) / target. Passes of all sources are merged in order of
    finish time, ties by source, shuffle key, id and size, and cut where the budget, budget_share times all words, is used
    up. copies says how many passes of a document come before the cut, taken = copies * size.

    A null source is a source of its own, sorted last; null ids sort first. Rows that agree in source, id and size are
    taken or left together. A source without words has target 0 and takes nothing. An empty table gives an empty result.
    Other columns are kept; those with the name of a result are replaced.

    The order is cut into runs of max(1024, sqrt(rows)) rows by ranges of the shuffle key, and finish times into as many
    ranges: only totals of runs and ranges, and the rows of the range at the cut, are ordered in one place. Sources are
    joined by broadcast when a count shows 100,000 at most.
    """
    marked = docs.withColumns({"__size": n_words("text"), "__key": shuffle_key("doc_id")})
    rows = cut_lineage(marked.select("doc_id", "source", F.col("__size").alias("size"), F.col("__key").alias("key")))
    n_rows = rows.count()
    runs = ceil(max(n_rows, 1) / max(LEAST_RUN, sqrt(n_rows)))
    run = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * F.lit(runs / 2.0**32))
    rows = rows.withColumn("run", run)

    totals = rows.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    totals = cut_lineage(totals.select("source", "run", "run_size", F.coalesce(
        F.sum("run_size").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    sizes = totals.groupBy("source").agg(F.sum("run_size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, budget_share, repeats))
    small = (lambda df: F.broadcast(df)) if targets.count() <= FEW_SOURCES else (lambda df: df)

    def by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.withColumnRenamed("source", "__source")
        return left.join(small(right), left["source"].eqNullSafe(right["__source"]), how).drop("__source")

    inside = Window.partitionBy("source", "run").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    starts = by_source(totals, targets).select(F.col("source").alias("__s"), F.col("run").alias("__r"), "before", "source_size", "target")
    passes = rows.withColumn("inside", F.sum("size").over(inside))
    passes = passes.join(starts, passes["source"].eqNullSafe(starts["__s"]) & (passes["run"] == starts["__r"])).drop("__s", "__r")
    passes = passes.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    done = F.col("before") + F.col("inside") + F.col("pass") * F.col("source_size")
    passes = passes.where("target > 0").withColumn("finish", done / F.col("target")).withColumn("range", F.floor(F.col("finish") * runs))

    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    ranges = passes.groupBy("range").agg(F.sum("size").alias("range_size"))
    ranges = ranges.select("range", F.sum("range_size").over(Window.partitionBy().orderBy("range")).alias("up_to"), "range_size")
    at_cut = ranges.where(F.col("up_to") > budget).orderBy("range").select("range", (F.col("up_to") - F.col("range_size")).alias("before")).first()
    if at_cut is None:
        taken = passes
    else:
        last = passes.where(F.col("range") == at_cut["range"])
        ahead = Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        last = last.withColumn("ahead", F.sum("size").over(ahead) + at_cut["before"]).where(F.col("ahead") <= budget).drop("ahead")
        taken = passes.where(F.col("range") < at_cut["range"]).unionByName(last)
    cuts = taken.groupBy("source").agg(F.max(F.struct("pass", F.struct("key", "doc_id", "size").alias("row"))).alias("__cut"))
    plan = cut_lineage(by_source(targets, cuts, "left").select("source", F.struct("source_size", "target", "__cut").alias("__plan")))

    out = by_source(marked, plan)
    row = F.struct(F.col("__key").alias("key"), F.col("doc_id").alias("doc_id"), F.col("__size").alias("size"))
    copies = F.coalesce(F.col("__plan.__cut.pass") + F.when(row <= F.col("__plan.__cut.row"), 1).otherwise(0), F.lit(0))
    return out.withColumns({
        "size": F.col("__size"), "source_size": F.col("__plan.source_size"), "target": F.col("__plan.target"),
        "copies": copies, "taken": copies * F.col("__size"),
    }).drop("__size", "__key", "__plan")
