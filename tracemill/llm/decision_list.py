"""Quality rules: text statistics as Spark expressions, and a decision list learnt from labels by sequential covering."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import cut_lineage

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
FEATURES = ("n_words", "word_length", "symbol_share", "mark_share", "upper_share", "dup_line_share", "repeat_share", "distinct_share")

Condition = tuple[str, str, float]  # feature, ">=" or "<=", threshold


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where the body uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(_without(text, chars))).cast("long")


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows of 8 words that occur more than once, from the hashes of the words."""
    windows = F.when(F.size(hashes) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    )).otherwise(F.array().cast("array<long>"))

    def covered(own: Column) -> Column:
        placed = F.sort_array(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(pairs: Column) -> Column:
            same = lambda p, j: (p["h"] == F.get(pairs, j - 1)["h"]) | (p["h"] == F.get(pairs, j + 1)["h"])
            marked = F.transform(pairs, lambda p, j: F.when(F.coalesce(same(p, j), F.lit(False)), p["i"]).otherwise(-1))
            return F.sort_array(F.filter(marked, lambda i: i >= 0))

        def total(places: Column) -> Column:
            steps = F.transform(places, lambda p, j: F.coalesce(F.least(F.get(places, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return _let(_let(placed, starts), total)

    return _let(windows, lambda own: F.when(F.size(F.array_distinct(own)) == F.size(own), 0).otherwise(covered(own))).cast("long")


def text_statistics(docs: DataFrame, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The given columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the counts that features need."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: _without(line, SPACES) != "")
    of_words = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(
        F.size(h).cast("long").alias("n_words"), F.size(F.array_distinct(h)).cast("long").alias("n_distinct"), _repeat_words(h).alias("n_repeat_words")))
    of_lines = _let(lines, lambda own: F.struct(F.size(own).cast("long").alias("n_lines"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines")))
    rows = docs.select(
        *columns, of_words.alias("__words"), of_lines.alias("__lines"), F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"), _count(text, "!?").alias("n_marks"), _count(text, UPPER).alias("n_upper"))
    return rows.select(*columns, "__words.*", "__lines.*", "word_chars", "n_symbols", "n_marks", "n_upper")


def features() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"), "word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "mark_share": share("n_marks", "word_chars"), "upper_share": share("n_upper", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "distinct_share": share("n_distinct", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _covers(x: np.ndarray, rule: Sequence[tuple[int, str, float]]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, side, at in rule:
        hit &= x[:, f] >= at if side == ">=" else x[:, f] <= at
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> list[tuple[int, str, float]]:
    """Adds the condition with the largest FOIL gain until no good row is covered or nothing is gained."""
    rule: list[tuple[int, str, float]] = []
    hit = np.ones(len(x), bool)
    while len(rule) < most and (hit & ~bad).any():
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        best, best_gain = None, 1e-9
        for f in range(x.shape[1]):
            for at in np.unique(np.quantile(x[hit & bad, f], np.linspace(0, 1, 65))):
                for side in (">=", "<="):
                    own = hit & _covers(x, [(f, side, at)])
                    p1, n1 = (own & bad).sum(), (own & ~bad).sum()
                    if p1:
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if gain > best_gain:
                            best, best_gain = (f, side, float(at)), gain
        if best is None:
            break
        rule.append(best)
        hit &= _covers(x, [best])
    return rule


def learn_list(x: np.ndarray, bad: np.ndarray, least_precision: float = 0.9, least_covered: int = 5, most_rules: int = 16, most_conditions: int = 4) -> list[list[Condition]]:
    """Ordered conjunctions that mark bad rows: each is grown on two thirds of the rows that are left and pruned on the others.

    Pruning takes off last conditions as long as (p - n) / (p + n) on the other rows does not fall. The list ends at the
    first rule that covers too few bad rows or is not precise enough on all rows that are left.
    """
    rules = []
    left = np.ones(len(x), bool)
    prune = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and (left & bad).sum() >= least_covered:
        grow_rows, prune_rows = left & ~prune, left & prune
        if not (grow_rows & bad).any():
            break
        rule = _grow(x[grow_rows], bad[grow_rows], most_conditions)

        def worth(conditions: list, rows: np.ndarray = prune_rows) -> float:
            hit = _covers(x[rows], conditions)
            p, n = (hit & bad[rows]).sum(), (hit & ~bad[rows]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covers(x, rule) & left
        if not rule or (hit & bad).sum() < least_covered or (hit & bad).sum() < least_precision * hit.sum():
            break
        rules.append([(FEATURES[f], side, at) for f, side, at in rule])
        left &= ~hit
    return rules


def rejects(rules: Sequence[Sequence[Condition]]) -> Column:
    """The list as one ordered conditional: false at the first rule that holds would keep, so the first match rejects."""
    values, verdict = features(), F.lit(False)
    for rule in reversed(rules):
        holds = F.lit(True)
        for name, side, at in rule:
            holds &= values[name] >= at if side == ">=" else values[name] <= at
        verdict = F.when(holds, True).otherwise(verdict)
    return verdict


def fit_rules(statistics: DataFrame, labels: DataFrame, at_most: int = 20_000) -> list[list[Condition]]:
    """Learns the list from about `at_most` labelled rows that pass the base rules, chosen by a hash of the id."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < min(1.0, at_most / max(n, 1)))
    values = [c.alias(f"f{i}") for i, c in enumerate(features()[f] for f in FEATURES)]
    rows = statistics.where(~base_failed()).join(chosen, "doc_id").select("doc_id", "quality", *values).orderBy("doc_id").limit(2 * at_most).collect()
    if not rows:
        return []
    return learn_list(np.array([r[2:] for r in rows], np.float64), np.array([r["quality"] == 0 for r in rows]))


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every document.

    kept is false where the base rules fail, else what the list learnt from `labels` says. Null texts count as empty, so
    they fail; null ids are judged but never learnt from. Repeated rows are judged alike; a label table that repeats an id
    counts its lowest quality. Without labels of both kinds the list is empty and nothing more is rejected. Other columns are
    ignored. Statistics are computed once and kept in the checkpoint folder; only the sampled numbers reach the driver.
    """
    statistics = cut_lineage(text_statistics(docs))
    rules = fit_rules(statistics, labels)
    judged = statistics.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejects(rules))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
