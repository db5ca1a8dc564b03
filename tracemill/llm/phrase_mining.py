"""Phrase collocations: exact counts from burstable hash containers under a trie of word ids, scored by their weakest cut."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import map_texts, slices
from tracemill.session import cut_lineage

LONGEST, LEAST_COUNT, TOP = 4, 30, 2000
UNKNOWN_LANG = "und"
SCORE_SCALE = 2_000_000
SWALLOWED_PERCENT = 80
BURST_ENTRIES = 4096        # entries of a hash container before it bursts by the next word
TRIE_ENTRIES = 800_000      # entries of all tries of a task before whole subtrees are spilled
VOCABULARY = 1 << 20        # words of a language in a task before everything is spilled and word ids start anew
CHUNK_WORDS = 1 << 19       # words numbered at once
WORD_BITS = 21              # holds VOCABULARY and a chunk; three ids fit into a signed long
FILTER_BITS = 26            # the filter of frequent phrases has 2^26 bits, 8 MB, whatever the data
RUN_ROWS = 20_000
SALTS = 512
FEW_LANGS = 100_000

# Letters A-Z become a-z, so the byte A is free to mark the end of a piece.
BREAK = b"A"
PREPARED = bytes(ord(BREAK) if b in b".,;:!?\x0a\x0b\x0c\x0d" else b + 32 if 65 <= b <= 90 else b for b in range(256))
FACTORS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


class Node(dict):
    """Inner node of the trie: word id -> Node or hash container (a Counter of the remaining word ids, packed into a number)."""


class HatTrie:
    """Counts of word-id sequences of one length: hash containers under a trie that deepens where a container bursts."""

    def __init__(self, length: int, burst: int = BURST_ENTRIES):
        self.length, self.burst, self.root, self.entries = length, burst, Node(), 0

    def add(self, firsts: np.ndarray, rests: np.ndarray) -> None:
        """Counts sequences given by their first word id and the other ids, WORD_BITS each."""
        if len(firsts):
            self._add(self.root, firsts, rests, self.length - 1)

    def _add(self, node: Node, firsts: np.ndarray, rests: np.ndarray, left: int) -> None:
        order = np.argsort(firsts)
        firsts, rests = firsts[order], rests[order]
        cuts = (np.flatnonzero(firsts[1:] != firsts[:-1]) + 1).tolist()
        values = rests.tolist()
        for start, end in zip([0, *cuts], [*cuts, len(values)], strict=True):
            first = int(firsts[start])
            child = node.get(first)
            if type(child) is Node:
                below = WORD_BITS * (left - 1)
                self._add(child, rests[start:end] >> below, rests[start:end] & ((1 << below) - 1), left - 1)
                continue
            if child is None:
                child = node[first] = Counter()
            before = len(child)
            child.update(values[start:end])
            self.entries += len(child) - before
            if left > 1 and len(child) > self.burst:
                node[first] = self._burst(child, WORD_BITS * (left - 1))

    @staticmethod
    def _burst(container: Counter, below: int) -> Node:
        node = Node()
        for ids, n in container.items():
            node.setdefault(ids >> below, Counter())[ids & ((1 << below) - 1)] = n
        return node

    def _leaves(self, node: Node | Counter, prefix: int, left: int) -> Iterator[tuple[int, Counter]]:
        if type(node) is not Node:
            yield prefix, node
            return
        below = WORD_BITS * (left - 1)
        for i, child in node.items():
            yield from self._leaves(child, prefix | i << below, left - 1)

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes whole subtrees out, large ones first, until `keep` entries are left: a run (firsts, rests, counts) in order."""
        subtrees = {first: list(self._leaves(child, 0, self.length - 1)) for first, child in self.root.items()}
        sizes = Counter({first: sum(len(c) for _, c in leaves) for first, leaves in subtrees.items()})
        firsts, lengths, prefixes, rests, counts = [], [], [], [], []
        for first, size in sizes.most_common():
            if self.entries <= keep:
                break
            self.entries -= size
            del self.root[first]
            for prefix, container in subtrees[first]:
                firsts.append(first)
                prefixes.append(prefix)
                lengths.append(len(container))
                rests.extend(container.keys())
                counts.extend(container.values())
        first = np.repeat(np.array(firsts, np.int64), lengths)
        rest = np.array(rests, np.int64) | np.repeat(np.array(prefixes, np.int64), lengths)
        below = WORD_BITS * (self.length - 1)
        order = np.argsort(first << below | rest) if below + WORD_BITS < 64 else np.lexsort((rest, first))
        return first[order], rest[order], np.array(counts, np.int64)[order]


class Words:
    """Word ids of one language in a task, with the 64-bit hash of every word and whether it may be frequent."""

    def __init__(self, lang: str, frequent: np.ndarray | None) -> None:
        self.lang, self.frequent = lang, frequent
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[BREAK]  # id 0
        self.hashes, self.usable = np.zeros(1, np.uint64), np.zeros(1, bool)

    def encode(self, parts: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.ids.__getitem__, parts), np.int64, len(parts))
        known = len(self.hashes)
        if self.frequent is not None and known < len(self.ids):
            fresh = list(islice(self.ids, known, None))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh))
            self.hashes = np.concatenate([self.hashes, hashes])
            self.usable = np.concatenate([self.usable, self.may_be_frequent([hashes])])
        return ids

    def may_be_frequent(self, hashes: list[np.ndarray]) -> np.ndarray:
        bits = filter_positions(self.lang, hashes)
        return (self.frequent[(bits >> np.uint64(3)).astype(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def filter_positions(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """Bit of each phrase in the filter of frequent phrases, from the hashes of its words."""
    mixed = np.full(len(words[0]), xxhash.xxh64_intdigest(lang), np.uint64)
    for w in words:
        mixed = (mixed ^ (mixed >> np.uint64(32))) * FACTORS[0] + w
    return ((mixed ^ (mixed >> np.uint64(29))) * FACTORS[1]) >> np.uint64(64 - FILTER_BITS)


def phrase_starts(ids: np.ndarray, words: Words, length: int) -> np.ndarray:
    """Where a phrase of a length starts that has no break, and whose words and two parts, shorter by a word, may be frequent."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    usable = words.usable[ids]  # a break is not
    at = np.flatnonzero(np.logical_and.reduce([usable[j:j + n] for j in range(length)]))
    if length > 2 and len(at):
        hashes = [words.hashes[ids[at + j]] for j in range(length)]
        at = at[words.may_be_frequent(hashes[:-1]) & words.may_be_frequent(hashes[1:])]
    return at


def count_phrases(
    docs: DataFrame, length: int, frequent: np.ndarray | None = None, trie_entries: int = TRIE_ENTRIES, burst: int = BURST_ENTRIES,
) -> DataFrame:
    """(lang, phrase, n): runs of phrase counts of docs (lang, text), in which a phrase can occur several times.

    Every task keeps a trie for each language (at length 1: a count for each word id). Beyond `trie_entries` the largest
    subtrees are written as sorted runs, the rest at the end, so memory depends on no table; a task that has met very many
    words writes everything and numbers its words anew. The shuffle merges the runs, by whole phrases: the subtree of a hot
    first word is spread over all partitions. At length 1 a row with the empty phrase has the number of words of a language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent) if frequent is not None else None

    def rows(lang: str, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(counts), RUN_ROWS):
            part = phrases.slice(start, RUN_ROWS)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(part)), part, pa.array(counts[start:start + RUN_ROWS])], names=["lang", "phrase", "n"])

    def write(words: Words, trie: HatTrie, single: np.ndarray, keep: int) -> Iterator[pa.RecordBatch]:
        texts = pa.array(list(words.ids), pa.binary()).cast(pa.string())
        if length == 1:
            order = np.flatnonzero(single[1:]) + 1
            yield from rows(words.lang, texts.take(pa.array(order)), single[order])
            yield from rows(words.lang, pa.array([""]), np.array([single[1:].sum()], np.int64))
            return
        firsts, rests, counts = trie.spill(keep)
        for start in range(0, len(counts), RUN_ROWS):
            part = slice(start, start + RUN_ROWS)
            ids = [firsts[part], *(rests[part] >> WORD_BITS * j & ((1 << WORD_BITS) - 1) for j in reversed(range(length - 1)))]
            yield from rows(words.lang, pc.binary_join_element_wise(*(texts.take(pa.array(i)) for i in ids), " "), counts[part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value if shared else None
        found: dict[str, tuple[Words, HatTrie]] = {}
        single: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                texts = defaultdict(list)
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    texts[lang].append(text)
                for lang, own in texts.items():
                    parts = b"\n".join(own).translate(PREPARED).replace(BREAK, b" " + BREAK + b" ").split()
                    for start in range(0, len(parts), CHUNK_WORDS):
                        if lang not in found:
                            found[lang], single[lang] = (Words(lang, frequent), HatTrie(length, burst)), np.zeros(0, np.int64)
                        words, trie = found[lang]
                        ids = words.encode(parts[start:start + CHUNK_WORDS + length - 1])
                        if length == 1:
                            counts = np.bincount(ids, minlength=len(words.ids))
                            counts[:len(single[lang])] += single[lang]
                            single[lang] = counts
                        else:
                            at = phrase_starts(ids, words, length)
                            rests = np.zeros(len(at), np.int64)
                            for j in range(1, length):
                                rests = rests << WORD_BITS | ids[at + j]
                            trie.add(ids[at], rests)
                        if len(words.ids) > VOCABULARY:
                            yield from write(words, trie, single[lang], 0)
                            del found[lang], single[lang]
                if sum(trie.entries for _, trie in found.values()) > trie_entries:
                    for lang, (words, trie) in found.items():
                        yield from write(words, trie, single[lang], trie_entries // (2 * len(found)))
        for lang, (words, trie) in found.items():
            yield from write(words, trie, single[lang], 0)

    return map_texts(docs, run, "lang string, phrase string, n long")


def frequent_filter(phrases: DataFrame) -> np.ndarray:
    """Bits set for rows (lang, phrase) of one length: 2^FILTER_BITS at most come to the driver. A set bit proves nothing, an unset one does."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist(), strict=True):
                by_lang[lang].append([xxhash.xxh64_intdigest(w) for w in phrase.split(b" ")])
            for lang, hashed in by_lang.items():
                yield pa.RecordBatch.from_arrays([pa.array(filter_positions(lang, list(np.array(hashed, np.uint64).T)).astype(np.int64))], names=["bit"])

    bits = phrases.select("lang", "phrase").mapInArrow(positions, "bit long").select((F.col("bit") + 1).alias("bit"))
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in parts.toLocalIterator():
        start = (row["bucket"] - 1) * len(row["bits"])
        out[start:start + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, length, f) of all phrases counted `least` times or more, (lang, n) with all words of a language).

    Length by length: a phrase is only counted where both its parts, shorter by one word, may be frequent, as no phrase is
    more frequent than its parts. The filter that says so has a fixed size and only errs towards counting.
    """
    if not 1 < longest <= 1 + 63 // WORD_BITS:
        raise ValueError("phrases have two to four words")
    found, total, frequent = None, None, None
    for length in range(1, longest + 1):
        merged = count_phrases(docs, length, frequent).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        merged = cut_lineage(merged.where((F.col("f") >= least) | (F.col("phrase") == "")))
        if length == 1:
            total = merged.where("phrase = ''").select("lang", F.col("f").alias("n"))
        own = merged.where("phrase <> ''").withColumn("length", F.lit(length))
        found = own if found is None else found.unionByName(own)
        if length < longest:
            shorter = frequent_filter(own)
            if not shorter.any():
                break
            frequent = shorter if frequent is None else frequent | shorter
    return found, total


def weakest_cuts(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, score, l, r) of all phrases of two words or more, by their lowest-scoring cut (ties: the first)."""
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    cuts = found.where("length > 1").select("lang", "phrase", "f", "length", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "f", "cut", part(1, F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("length") - F.col("cut")).alias("rest"))
    counts = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(counts("first", "l"), ["lang", "first"]).join(counts("rest", "r"), ["lang", "rest"])
    wide = lambda c: c.cast("decimal(20,0)")
    score = F.call_function("div", wide(F.col("f")) * F.lit(SCORE_SCALE).cast("decimal(7,0)"), wide(F.col("l")) + wide(F.col("r")))
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", F.col("f").alias("a")).agg(best).select("lang", "phrase", "a", "best.score", "best.l", "best.r")


def without_swallowed(cuts: DataFrame, found: DataFrame) -> DataFrame:
    """Drops phrases that lie inside a longer frequent phrase with at least 80 % of their count."""
    words = F.split("phrase", " ")
    places = F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("length") - n + 1), lambda at: F.array_join(F.slice(words, at, n), " "))))
    longer = found.where("length > 2").select("lang", F.explode(F.array_distinct(places)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    joined = cuts.join(longer, ["lang", "phrase"], "left")
    return joined.where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * SWALLOWED_PERCENT)).drop("longer")


def top_phrases(scored: DataFrame, top: int = TOP, salts: int = SALTS) -> DataFrame:
    """The first `top` rows of each language with their rank, without ordering a language in one task.

    Languages are dealt over salts, and only the first rows of each salt stay. The ceil(top / salts)-th rows of all salts
    are `top` rows or more, so the last of these is a bound that a few times `top` rows pass.
    """
    order = F.struct((-F.col("score")).alias("s"), (-F.col("a")).alias("a"), F.col("phrase").alias("p"))
    rows = scored.withColumn("__order", order).withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy("__order"))).where(F.col("__rank") <= top)
    ranked = cut_lineage(ranked)
    bounds = ranked.where(F.col("__rank") == ceil(top / salts)).groupBy("lang").agg(F.count(F.lit(1)).alias("__salts"), F.max("__order").alias("__bound"))
    bounds = cut_lineage(bounds.where(F.col("__salts") == salts).select("lang", "__bound"))
    small = F.broadcast(bounds) if bounds.count() <= FEW_LANGS else bounds
    passed = ranked.join(small, "lang", "left").where(F.col("__bound").isNull() | (F.col("__order") <= F.col("__bound")))
    listed = passed.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("__order", "phrase", "a", "l", "r", "score"))), 1, top).alias("rows"))
    return listed.select("lang", F.posexplode("rows").alias("at", "row")).select(
        "lang", (F.col("at") + 1).cast("long").alias("rank"), "row.phrase", "row.a", "row.l", "row.r", "row.score")


def mine_phrases(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best collocations of each language in docs (lang, text).

    Texts lose the case of A-Z and are cut into pieces at .,;:!? and line ends; phrases of 2 to `longest` words lie inside a
    piece and are counted exactly, overlaps included. Null texts are empty, a null language is `und`, rows without words
    add nothing, repeated rows count again. Ties go by count, then by phrase in byte order. A language without a phrase of
    `least` occurrences has no row; an empty table gives none. Other columns are ignored.
    """
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"), "text").where(F.col("text").isNotNull())
    found, total = frequent_phrases(texts, least, longest)
    ranked = top_phrases(without_swallowed(weakest_cuts(found), found), top)
    small = F.broadcast(total) if total.count() <= FEW_LANGS else total
    return ranked.join(small, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
