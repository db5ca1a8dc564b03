"""License scans: an exact set-similarity join of text blocks with templates, and the places of fixed phrases in the blocks found."""

from __future__ import annotations

import json
from collections.abc import Sequence
from math import ceil
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8
STRIDE = 32

# Fixed values: (label, phrase) of the base search.
BASE_PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
# Further notices that only the containment of their words finds.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("gpl", "licensed under the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
)


def license_words(text: Column) -> Column:
    """The words of a text without ASCII case; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _strings(values: Sequence[str]) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")  # a literal after constant folding


def token_frequencies(words: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many rows of (words) each token of the templates occurs; the driver gets one number for each token at most."""
    met = words.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in met.collect()}


def scan_licenses(
    docs: DataFrame, phrases: Sequence[tuple[str, str]] = BASE_PHRASES, notices: Sequence[tuple[str, str]] = NOTICES,
    containment: float = CONTAINMENT, stride: int = STRIDE,
) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score to every row; other columns are kept.

    Templates are the word sets of all phrases and notices. Blocks begin at every `stride` words and are so much longer
    that any template fits wholly into one. Tokens of templates are ordered by how many rows of the whole table hold them,
    rare ones first; no other token can count. A block meets a template only if the first tokens of both (as many as leave
    fewer than the needed number behind: prefix filter) share one, it has enough tokens (length filter), and enough tokens
    follow the shared one on both sides (positional filter). The shared tokens of the remaining pairs are counted exactly.
    The inverted index of the templates' prefixes is a small literal, so blocks meet it where they are read: no shuffle but
    for the token counts, and no hot group. Score is the largest containment that reaches the threshold, else 0.

    Where a block meets the template of a phrase, the places that start in its first `stride` words are looked up, so every
    place is found once: n_base counts them, first_word and last_word are the smallest and largest start (null if none).
    Labels are distinct, sorted and joined by commas; labels has those of the notices and of scattered words too.
    Null and empty texts have no words. Repeated rows and ids are scanned like any other. An empty table gives no rows.
    Columns with the name of a result are replaced.
    """
    templates = [(label, text.split(" ")) for label, text in (*phrases, *notices)]
    sets = [sorted(set(words)) for _, words in templates]
    longest = max(len(words) for _, words in templates)
    needed = [ceil(containment * len(s) - 1e-9) for s in sets]
    vocabulary = sorted(set().union(*sets))

    rows = docs.withColumn("__words", license_words(F.col("text")))
    counts = token_frequencies(docs.select(license_words(F.col("text")).alias("words")), vocabulary)
    order = sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    index: dict[str, list[dict[str, int]]] = {}
    for number, (tokens, least) in enumerate(zip(sets, needed, strict=True)):
        for place, token in enumerate(sorted(tokens, key=rank.get)[:len(tokens) - least + 1]):
            index.setdefault(token, []).append({"t": number, "at": place, "size": len(tokens), "least": least})
    entries = F.from_json(F.lit(json.dumps(index)), "map<string,array<struct<t:int,at:int,size:int,least:int>>>")
    tokens_of = F.from_json(F.lit(json.dumps(sets)), "array<array<string>>")
    least_of = F.from_json(F.lit(json.dumps(needed)), "array<int>")

    # Blocks: tokens in global order, since array_intersect keeps the order of its first argument.
    n = F.size("__words")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.call_function("div", n - 1, F.lit(stride)).cast("int"))).otherwise(F.array().cast("array<int>"))
    block = lambda b: F.array_intersect(_strings(order), F.slice("__words", b * stride + 1, F.lit(stride + longest - 1)))
    blocks = F.filter(F.transform(starts, lambda b: F.struct(b.alias("b"), block(b).alias("tokens"))), lambda x: F.size(x["tokens"]) >= min(needed))
    rows = rows.withColumn("__blocks", blocks)

    def candidates(x: Column) -> Column:
        size = F.size(x["tokens"])
        fits = lambda e, i: (size >= e["least"]) & (i <= size - e["least"]) & (F.least(size - i, e["size"] - e["at"]) >= e["least"])
        hits = F.transform(x["tokens"], lambda token, i: F.transform(
            F.filter(F.coalesce(F.try_element_at(entries, token), F.array().cast("array<struct<t:int,at:int,size:int,least:int>>")), lambda e: fits(e, i)), lambda e: e["t"]))
        return F.array_distinct(F.flatten(hits))

    def verified(x: Column) -> Column:
        shared = lambda t: F.size(F.array_intersect(x["tokens"], F.get(tokens_of, t)))
        pairs = F.transform(candidates(x), lambda t: F.struct(x["b"].alias("b"), t.alias("t"), shared(t).alias("shared")))
        return F.filter(pairs, lambda p: p["shared"] >= F.get(least_of, p["t"]))

    rows = rows.withColumn("__pairs", F.flatten(F.transform("__blocks", verified)))

    # Places of phrases: exact check of the blocks that the join has found.
    texts = F.from_json(F.lit(json.dumps([text.split(" ") for _, text in phrases])), "array<array<string>>")

    def places(p: Column) -> Column:
        phrase = F.get(texts, p["t"])
        first = p["b"] * stride
        at = F.filter(F.sequence(first, F.least(first + stride, n) - 1), lambda i: F.slice("__words", i + 1, F.size(phrase)) == phrase)
        return F.transform(at, lambda i: F.struct(i.alias("at"), p["t"].alias("t")))

    of_phrases = F.filter("__pairs", lambda p: p["t"] < len(phrases))
    rows = rows.withColumn("__places", F.flatten(F.transform(of_phrases, places)))
    labels = _strings([label for label, _ in templates])
    named = lambda column: F.transform(column, lambda p: F.get(labels, p["t"]))
    joined = lambda column: F.array_join(F.array_sort(F.array_distinct(column)), ",")
    at = F.transform("__places", lambda p: p["at"].cast("long"))
    sizes = F.from_json(F.lit(json.dumps([len(s) for s in sets])), "array<int>")
    best = F.array_max(F.transform("__pairs", lambda p: p["shared"].cast("double") / F.get(sizes, p["t"])))
    return rows.withColumns({
        "n_words": n.cast("long"), "n_base": F.size("__places").cast("long"), "first_word": F.array_min(at), "last_word": F.array_max(at),
        "base_labels": joined(named("__places")), "labels": joined(F.concat(named("__places"), named("__pairs"))), "score": F.coalesce(best, F.lit(0.0)),
    }).drop("__words", "__blocks", "__pairs", "__places")
