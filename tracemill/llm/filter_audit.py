"""Interaction of document filters: who removes what in every order, and each filter's fair share by the Hart-Mas-Colell potential."""

from __future__ import annotations

from itertools import permutations
from math import factorial
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import WORD

COPY_FILTER = "E"


def text_failures(text: str = "text") -> dict[str, Column]:
    """Failure conditions of the single-text filters A to D; a null text is empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.col("__words")
    capitals = F.length(whole) - F.length(F.translate(whole, ascii_uppercase, ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": capitals.cast("long") * 100 > F.length(whole).cast("long") * 5,
        "D": whole.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail exactly the filters of mask, and how many of them are labelled so.

    Bit 0 of mask is filter A and so on. Texts meet by their SHA-256 only after rows that agree in text, part, labels and
    failures have been combined before the shuffle, so thousands of copies are one row a task. Labels are joined once for
    each doc_id: repeated label rows count as one that has the highest of their marks.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "text").withColumn("__words", F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures().values())), F.lit(0))
    rows = rows.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), mask.alias("mask"), F.sha2(whole.cast("binary"), 256).alias("print"))
    marks = labels.groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    marked = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])

    kind = ["print", "part", "mask", "good", "toxic"]
    by_id = marked.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("copies").alias("copies"))
    by_kind = by_id.groupBy(*kind).agg(F.sum("copies").alias("n"), F.min(first).alias("first"))
    owner = F.min(F.struct("first.unknown", "first.id")).over(Window.partitionBy("print"))  # one row for each kind of copy, not for each copy
    original = F.when(F.struct("first.unknown", "first.id").eqNullSafe(owner), F.col("first.copies")).otherwise(0)
    split = by_kind.withColumn("original", original).select(*kind, F.explode(F.array(
        F.struct(F.lit(0).alias("copy"), F.col("original").alias("n")),
        F.struct(F.lit(1 << (ascii_uppercase.index(COPY_FILTER))).alias("copy"), (F.col("n") - F.col("original")).alias("n")),
    )).alias("of"))
    counted = F.col("of.n")
    return split.where(counted > 0).groupBy("part", F.col("mask").bitwiseOR(F.col("of.copy")).alias("mask")).agg(
        F.sum(counted).alias("n"), F.sum(counted * F.col("good")).alias("good"), F.sum(counted * F.col("toxic")).alias("toxic"))


def coalition_values(masks: DataFrame, filters: str) -> DataFrame:
    """One row a part: arrays removed, good and toxic, by coalition of filters, and the potential, times the number of orders.

    The value of a coalition is how many documents its filters remove together. In the game left after a removal the
    potential is P(S) = (v(S) + sum of P(S without i)) / |S|; times |filters|! it is whole, and so is every step.
    """
    coalitions = 1 << len(filters)
    entries = F.collect_list(F.struct("mask", "n", "good", "toxic"))  # at most one for each coalition
    rows = masks.groupBy("part").agg(F.sum("n").alias("total"), entries.alias("entries"))

    def value(of: str) -> Column:
        hit = lambda s: F.filter("entries", lambda e: e["mask"].bitwiseAND(s) != 0)
        return F.transform(F.sequence(F.lit(0), F.lit(coalitions - 1)), lambda s: F.aggregate(hit(s), F.lit(0).cast("long"), lambda a, e: a + e[of]))

    rows = rows.select("part", "total", value("n").alias("removed"), value("good").alias("good"), value("toxic").alias("toxic"))
    orders = factorial(len(filters))

    def potential(known: Column, s: Column) -> Column:
        members = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s.bitwiseXOR(F.lit(1 << i)))).otherwise(0) for i in range(len(filters))]
        size = F.bit_count(s)
        return F.call_function("div", F.get("removed", s) * orders + sum(members, F.lit(0)), size)

    smaller_first = F.sequence(F.lit(1), F.lit(coalitions - 1))  # a part of a coalition has a smaller number
    grown = F.aggregate(smaller_first, F.array(F.lit(0).cast("long")), lambda known, s: F.concat(known, F.array(potential(known, s))))
    return rows.withColumn("potential", grown)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step) with kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    Filters: A under 50 words, B fewer than 65 % distinct words, C over 5 % capitals, D a symbol of #$%&*|, E a text that a
    smaller doc_id has. Every order of them is applied to every part, a value of source (null: the empty part).
    Null texts are empty texts, which are copies of each other. Null ids count as larger than any and do not copy each
    other; rows that agree in doc_id and text are not copies of each other either, and each counts. Labels of no document
    are ignored, documents without labels are neither good nor toxic. An empty table gives no rows; other columns are ignored.

    shapley is the filter's removals summed over all orders: the potential of all filters less that of all others.
    """
    filters = "".join([*text_failures(), COPY_FILTER])
    everyone = (1 << len(filters)) - 1
    values = coalition_values(failure_masks(docs, labels), filters)
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(filters))), " ")
    steps = values.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    bit = lambda letter: F.shiftleft(F.lit(1), F.locate(letter, F.lit(filters)) - 1)
    letters = F.split("filter_order", "")
    before = F.aggregate(F.slice(letters, 1, F.col("step") - 1), F.lit(0), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.call_function("locate", x, F.lit(filters)) - 1)))
    own = F.call_function("shiftleft", F.lit(1), F.call_function("locate", F.get(letters, F.col("step") - 1), F.lit(filters)) - 1)
    steps = steps.withColumns({"before": before, "own": own}).withColumn("after", F.col("before").bitwiseOR(F.col("own")))
    gain = lambda of: F.get(of, F.col("after")) - F.get(of, F.col("before"))
    last = lambda of: F.get(of, F.lit(everyone)) - F.get(of, F.lit(everyone).bitwiseXOR(F.col("own")))
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.get("removed", F.col("after"))).alias("kept"), gain("removed").alias("removed"),
        (F.get("removed", F.col("own")) - gain("removed")).alias("redundant"), last("removed").alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"), last("potential").alias("shapley"),
    )
