"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")

# One hit rejects.
STRICT_TERMS = ("porn", "porno", "xxx", "hentai", "camgirls", "casino", "sportsbook", "viagra", "cialis", "warez", "keygen", "malware")
# Several distinct hits reject.
SOFT_TERMS = ("adult", "sex", "nude", "bet", "betting", "poker", "slots", "jackpot", "pills", "pharmacy", "loan", "payday", "crack", "torrent", "escort", "dating")

Rule = tuple[str, str, str]


def host_of(url: str | Column) -> Column:
    """After the first :// up to /, ?, # or the end, ASCII letters lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: str | Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text (host and path) and action of the longest fitting rule, null if none fits; the longer host wins a tie.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, action = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, act).otherwise(action)
    return text, action


@functools.lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def term_hits(text: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Distinct strict and soft terms of a lower-cased text that stand between characters other than a-z, 0-9 and _."""
    hits = set()
    for last, (term, is_strict) in automaton(strict, soft).iter(text):
        first = last - len(term)
        if (first < 0 or text[first] not in WORD_CHARS) and (last + 1 == len(text) or text[last + 1] not in WORD_CHARS):
            hits.add((term, is_strict))
    n_strict = sum(is_strict for _, is_strict in hits)
    return n_strict, len(hits) - n_strict


def count_terms(url: str | Column, strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS) -> Column:
    """Struct of the distinct strict and soft terms in a URL (null: none)."""
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("strict long, soft long")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            counts = [term_hits(u, strict, soft) if u else (0, 0) for u in urls]
            yield pd.DataFrame(counts, columns=["strict", "soft"], dtype="int64")

    return hits(F.translate(url, UPPER, LOWER))


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = (), strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS,
               soft_limit: int = 2, url: str = "url") -> DataFrame:
    """Adds host, path, rule, strict_hits, soft_hits and verdict (allow or block) to every row.

    The longest fitting rule decides. Without one, a URL with a strict term or with `soft_limit` distinct soft terms is
    blocked. Null URLs and URLs without :// have an empty host and path, so no rule fits; null URLs hold no terms and are
    allowed. Every row is judged by itself: repeated rows give repeated results, an empty table an empty one, and other
    columns are kept. Columns that have the name of a result are replaced.
    """
    host, path = host_of(url), path_of(url)
    text, action = rule_of(host, path, rules)
    hits = pages.withColumn("__hits", count_terms(url, strict, soft))
    verdict = F.coalesce(action, F.when((F.col("__hits.strict") > 0) | (F.col("__hits.soft") >= soft_limit), "block").otherwise("allow"))
    return hits.withColumns({
        "host": host, "path": path, "rule": text, "verdict": verdict,
        "strict_hits": F.col("__hits.strict"), "soft_hits": F.col("__hits.soft"),
    }).drop("__hits")
