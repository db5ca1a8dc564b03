"""Near copies by the Jaccard similarity of word shingles: SimHash classes and MinHash bands give candidates, the shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import map_texts, slices
from tracemill.llm.components import components
from tracemill.llm.simhash_dedup import TO_LOWER, fingerprint, link_fingerprints
from tracemill.session import cut_lineage

SHINGLE_WORDS, SIMILARITY = 5, 0.8
# A pair at 0.8 shares one of 32 bands of 5 minima with probability 1 - (1 - 0.8^5)^32 = 0.999997.
BANDS, BAND_ROWS = 32, 5
# Similarities are compared with this much allowance for rounding.
SLACK = 1e-9
HASHES_AT_ONCE = 2048
# Hashes in the sets of all heads of a round (8 MB) up to which they are broadcast; more are shuffled.
HEAD_HASHES = 1 << 20
FACTORS = np.random.default_rng(7).integers(1, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = np.random.default_rng(8).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)


def shingle_hashes(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text with fewer words is one shingle, one without words has none."""
    words = text.translate(TO_LOWER).split()  # splits at 0x20 and 0x09-0x0D, as bytes do
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[width - 1:] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e]) for s, e in zip(starts, last)), np.uint64, len(last)))  # noqa: B905


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band: equal where the BAND_ROWS minima of two shingle sets agree."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[k:k + HASHES_AT_ONCE]
        np.minimum(least, (part[None, :] * FACTORS[:, None] + TERMS[:, None]).min(1), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64).view(np.int64)


def _raw(part: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            texts = _raw(part)
            sets = [shingle_hashes(t) for t in texts]
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            marks = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("print"), pa.array([len(s) for s in sets], pa.int32()), keys, pa.array(marks)], names=["print", "size", "bands", "fingerprint"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = [shingle_hashes(t).view(np.int64) for t in _raw(part)]
            yield pa.RecordBatch.from_arrays([part.column("print"), pa.array(sets, pa.list_(pa.int64()))], names=["print", "shingles"])


def _fits(one: str, other: str) -> Column:
    """Whether two set sizes allow SIMILARITY: pairs go by it before any set is read."""
    return F.least(one, other) >= SIMILARITY * F.greatest(one, other) - SLACK


def _shingle_sets(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """(print, shingles) of the texts whose print is a row of `prints`."""
    chosen = texts.join(prints, "print", "left_semi").dropDuplicates(["print"])
    return cut_lineage(map_texts(chosen, _sets, "print long, shingles array<long>"))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs (head, print) at SIMILARITY or above. The sets of few heads are broadcast, so that no pair carries one."""
    sets = _shingle_sets(pairs.select(F.col("head").alias("print")).unionByName(pairs.select("print")).distinct(), texts)
    heads = sets.join(pairs.select(F.col("head").alias("print")).distinct(), "print", "left_semi")
    hashes = heads.agg(F.sum(F.size("shingles"))).first()[0] or 0
    heads = heads.select(F.col("print").alias("head"), F.col("shingles").alias("x"))
    heads = F.broadcast(heads) if hashes <= HEAD_HASHES else heads
    both, all_ = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    met = pairs.join(sets.withColumnRenamed("shingles", "y"), "print").join(heads, "head")
    return cut_lineage(met.where(both >= SIMILARITY * (all_ - both) - SLACK).select(
        F.least("head", "print").alias("a"), F.greatest("head", "print").alias("b")).distinct())


def _simhash_pairs(sketches: DataFrame) -> DataFrame:
    """(head, print) to compare: every text with the smallest print of its class of fingerprints at 2 or fewer differing bits, as in `simhash_dedup`."""
    marks = cut_lineage(sketches.select("fingerprint").distinct())
    classes = components(link_fingerprints(marks)).withColumnRenamed("node", "fingerprint")
    named = cut_lineage(sketches.join(classes, "fingerprint", "left").select("print", "size", F.coalesce("root", "fingerprint").alias("class")))
    heads = named.groupBy("class").agg(F.min(F.struct(F.col("print").alias("head"), F.col("size").alias("head_size"))).alias("h")).select("class", "h.*")
    return cut_lineage(named.join(heads, "class").where((F.col("print") != F.col("head")) & _fits("size", "head_size")).select("head", "print"))


def _shared(sketches: DataFrame) -> DataFrame:
    """(band, print, size) of the bands that two texts or more share."""
    bands = sketches.select("print", "size", F.explode("bands").alias("band"))
    return cut_lineage(bands.join(bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select("band"), "band", "left_semi"))


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, print, size, root, others) of the bands with two classes or more; others counts the members of other classes in the band."""
    own = shared.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    classes = own.groupBy("band", "root").agg(F.count("*").alias("own"))
    mixed = classes.groupBy("band").agg(F.sum("own").alias("members"), F.count("*").alias("classes")).where("classes > 1")
    return cut_lineage(own.join(classes, ["band", "root"]).join(mixed, "band").select("band", "print", "size", "root", (F.col("members") - F.col("own")).alias("others")))


def _to_heads(open_: DataFrame) -> DataFrame:
    """(head, print) to compare: in each band the members of other classes with the text that meets most such members in all its bands.

    That text tends to be the centre of a group of copies, which more texts are linked to than to an outer one, and it is
    the same one in most bands of the group, so that a group gives few pairs a member.
    """
    weight = open_.groupBy("print").agg(F.sum("others").alias("weight"))
    head = F.struct(F.col("print").alias("head"), F.col("size").alias("head_size"), F.col("root").alias("head_root"))
    heads = open_.join(weight, "print").groupBy("band").agg(F.max_by(head, F.struct("weight", "print")).alias("h")).select("band", "h.*")
    return cut_lineage(open_.join(heads, "band").where((F.col("root") != F.col("head_root")) & _fits("size", "head_size")).select("head", "print").distinct())


def _rare_pairs(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """(head, print): every pair of two classes among the open texts that can reach SIMILARITY, as an exact set-similarity join.

    Shingles are ordered by the number of open texts that hold them, those of a single class first. Two sets at SIMILARITY
    share a shingle among the first size - ceil(SIMILARITY * size) + 1 of each, and the first one they share leaves enough
    places behind it in both. Copies that differ from a common centre begin with their own edits, so they do not meet there.
    In a list of texts with one shingle the members of its largest class are not compared with each other.
    """
    members = open_.select("print", "size", "root").distinct()
    sets = _shingle_sets(members, texts)
    tokens = members.join(sets, "print").select("print", "size", "root", F.explode("shingles").alias("shingle"))
    held = tokens.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    ranked = tokens.join(held.select("shingle", "texts"), "shingle").groupBy("print", "size", "root").agg(
        F.sort_array(F.collect_list(F.struct("texts", "shingle"))).alias("ranked"))
    least = lambda size, share: F.ceil(size * F.lit(share) - F.lit(SLACK))
    ahead = F.col("size") - F.size("ranked")
    first = (F.col("size") - least(F.col("size"), SIMILARITY) + 1 - ahead).cast("int")
    places = ranked.select("print", "size", "root", ahead.alias("ahead"), F.posexplode(F.slice("ranked", F.lit(1), F.greatest(first, F.lit(0)))).alias("at", "entry"))
    lists = cut_lineage(places.select("print", "size", "root", (F.col("size") - F.col("ahead") - F.col("at") - 1).alias("behind"), F.col("entry.shingle").alias("shingle")))
    classes = lists.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    mixed = classes.groupBy("shingle").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("classes")).where("classes > 1")
    marked = cut_lineage(lists.join(mixed.select("shingle", "main"), "shingle"))
    left = marked.where("root <> main").select("shingle", *(F.col(c).alias(f"{c}_1") for c in ("print", "size", "root", "behind")))
    enough = 1 + F.least("behind", "behind_1") >= least(F.col("size") + F.col("size_1"), SIMILARITY / (1 + SIMILARITY))
    once = (F.col("root") == F.col("main")) | (F.col("print_1") < F.col("print"))
    met = left.join(marked, "shingle").where((F.col("root") != F.col("root_1")) & once & _fits("size", "size_1") & enough)
    return cut_lineage(met.select(F.least("print", "print_1").alias("head"), F.greatest("print", "print_1").alias("print")).distinct())


def link_texts(texts: DataFrame) -> DataFrame:
    """(node, root) of rows (print, text): root is the smallest print reachable over links.

    Texts at SIMILARITY or above are linked if they are in one class of SimHash fingerprints or share a band: the classes
    of fingerprints are compared first, each with one head, and the bands find what lies beyond 2 bits. Only texts of different classes are compared, as a pair within a class can't change the components. Rounds with one head
    a band join the large groups while every fourth comparison joins two classes; when to stop them decides about speed
    alone, for the pairs they leave between classes are then found without exception (`_rare_pairs`).
    """
    sketches = cut_lineage(map_texts(texts, _sketch, "print long, size int, bands array<long>, fingerprint long").dropDuplicates(["print"]))
    shared = _shared(sketches)
    roots = cut_lineage(components(_linked(_simhash_pairs(sketches), texts)))
    joined = roots.where("node <> root").count()

    def join_classes(linked: DataFrame) -> DataFrame:
        return cut_lineage(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(linked)))

    while True:
        pairs = _to_heads(_open(shared, roots))
        compared, before = pairs.count(), joined
        if compared:
            roots = join_classes(_linked(pairs, texts))
            joined = roots.where("node <> root").count()
        if (joined - before) * 4 <= compared:
            break
    return join_classes(_linked(_rare_pairs(_open(shared, roots), texts), texts))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without near copies: of each class of linked texts the row of the smallest doc_id stays.

    Words are compared without ASCII case. Null texts, empty ones and those of white space are equal. Of rows that agree in
    doc_id and text one stays. Null ids count as larger than any. An empty table gives no rows.
    """
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    prints = docs.select("doc_id", own.alias("print"))
    distinct = prints.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "print")).alias("least"))
    roots = link_texts(docs.select(own.alias("print"), "text")).withColumnRenamed("node", "print")
    classes = distinct.join(roots, "print", "left").select(F.coalesce("root", "print").alias("root"), "least")
    kept = classes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("__id"), F.col("least.print").alias("__kept"))
    marked = docs.withColumn("__print", own)
    stay = marked.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__kept")), "left_semi")
    return stay.dropDuplicates(["doc_id", "__print"]).drop("__print")
