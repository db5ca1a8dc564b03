"""SimHash near-duplicates, with candidates from Golay decoding of fingerprint segments."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import map_texts, slices
from tracemill.llm.components import components
from tracemill.session import cut_lineage

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
# Fixed values of the binary Golay code: length 23, generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY_LENGTH, GOLAY_CHECK, GOLAY_GENERATOR = 23, 11, 0b101011100011
# Start and width of the segments of a 64-bit fingerprint; each fits into a Golay word.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Members of a key up to which pairs are compared; larger groups are linked through common neighbours.
PAIRED_MEMBERS = 64
HASHES_AT_ONCE = 1 << 17
TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the text's 3-word shingles; bit i is set if more than half of the shingle hashes have it."""
    words = text.translate(TO_LOWER).split()  # splits at 0x20 and 0x09-0x0D, as bytes do
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[SHINGLE_WORDS - 1:] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, len(last), HASHES_AT_ONCE):
        part = last[k:k + HASHES_AT_ONCE]
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[k:], part)), np.uint64, len(part))  # noqa: B905
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(last), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """Adds the fingerprint of the text as a signed long (null text: 0), all columns kept."""
    kept = docs.drop("fingerprint")
    schema = ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in kept.schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.view(np.int64))], names=[*part.schema.names, "fingerprint"])

    return map_texts(kept, add, schema + ", fingerprint long")


def syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    word = word.copy()
    for bit in range(GOLAY_LENGTH - 1, GOLAY_CHECK - 1, -1):
        word ^= np.where(word >> bit & 1, GOLAY_GENERATOR << (bit - GOLAY_CHECK), 0)
    return word


@functools.lru_cache(maxsize=1)
def error_patterns() -> np.ndarray:
    """For each of the 2048 syndromes: the unique error of weight 3 at most, and, if it has weight 3, the five of weight 4.

    The nearest codeword of a word lies within 3 bits, so it lies within 4 bits of every word one bit away: such words
    share one of the codewords that these errors lead to. Rows are filled up with their first error.
    """
    patterns = np.array([sum(1 << b for b in bits) for weight in range(5) for bits in combinations(range(GOLAY_LENGTH), weight)], np.int64)
    found = syndrome(patterns)
    order = np.argsort(found, kind="stable")  # light errors first within a syndrome
    starts = np.searchsorted(found[order], np.arange(1 << GOLAY_CHECK))
    sizes = np.diff(np.append(starts, len(order)))
    take = starts[:, None] + np.minimum(np.arange(6)[None, :], sizes[:, None] - 1)
    table = patterns[order[take]]
    return np.where(np.arange(6)[None, :] < sizes[:, None], table, table[:, :1])


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) such that any two fingerprints that differ in 2 bits or fewer share a key.

    Of three segments one agrees and another differs in one bit at most. For each ordered pair of segments, the key is
    the first one's bits with the index of a codeword near the second one.
    """
    bits = fingerprints.view(np.uint64)
    parts = [(bits >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    near = [(p[:, None] ^ error_patterns()[syndrome(p)]) >> GOLAY_CHECK for p in parts]
    rows, keys = [], []
    for pair, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        key = (pair << 34 | parts[i] << 12)[:, None] | near[j]
        real = np.ones(key.shape, bool)
        real[:, 1:] = near[j][:, 1:] != near[j][:, :1]
        rows.append(np.nonzero(real)[0])
        keys.append(key[real])
    return np.concatenate(rows), np.concatenate(keys)


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect every two fingerprints (column fingerprint, distinct) at 2 or fewer differing bits.

    Members of a key are compared pair by pair where a key has few. Members of larger groups are listed under each of the
    65 words within one bit of them; those under one word, 65 at most, differ in 2 bits or fewer and are linked to their
    smallest, and any two that close meet under some word.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 20_000):
                values = batch.column(0).slice(start, 20_000).to_numpy()
                rows, keys = golay_keys(values)
                yield pa.RecordBatch.from_arrays([pa.array(values[rows]), pa.array(keys)], names=["fingerprint", "key"])

    keys = distinct.select("fingerprint").mapInArrow(keyed, "fingerprint long, key long")
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = cut_lineage(keys.join(shared, "key"))
    few, many = shared.where(F.col("members") <= PAIRED_MEMBERS), shared.where(F.col("members") > PAIRED_MEMBERS)
    left, right = few.select("key", F.col("fingerprint").alias("a")), few.select("key", F.col("fingerprint").alias("b"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64)])
    words = many.select("fingerprint").distinct().select("fingerprint", F.explode(flips).alias("flip"))
    words = words.groupBy(F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("word")).agg(F.collect_set("fingerprint").alias("near")).where(F.size("near") > 1)
    stars = words.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def group_documents(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (doc_id, fingerprint): the class of every fingerprint, and of every class the document that stands for it.

    First: fingerprint, root, component_id. Second: root, doc_id (the smallest, null only if all are null), fingerprint.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "fingerprint"))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(least.alias("least")))
    roots = components(link_fingerprints(distinct)).withColumnRenamed("node", "fingerprint")
    classes = distinct.join(roots, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least")
    kept = classes.groupBy("root").agg(F.min("least").alias("least")).select("root", "least.doc_id", "least.fingerprint")
    of_print = classes.drop("least").join(kept.select("root", F.col("doc_id").alias("component_id")), "root")
    return of_print.select("fingerprint", "root", "component_id"), kept


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of every row.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other. Texts of one or
    two words have one shingle. Repeated rows are rows of their own in the same component. Null ids count as larger than
    any; a component of null ids only has a null component_id. Other columns are ignored, an empty table gives no rows.
    """
    prints = cut_lineage(with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "fingerprint"))
    of_print, _ = group_documents(prints)
    return prints.join(of_print.select("fingerprint", "component_id"), "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without near-duplicates: of each component the row of the smallest doc_id stays.

    Of rows that agree in doc_id and fingerprint one stays.
    """
    marked = with_fingerprints(docs.withColumnRenamed("fingerprint", "__fingerprint"))
    prints = cut_lineage(with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "fingerprint"))
    kept = group_documents(prints)[1].select(F.col("doc_id").alias("__id"), F.col("fingerprint").alias("__print"))
    stay = marked.join(kept, marked["doc_id"].eqNullSafe(kept["__id"]) & (marked["fingerprint"] == kept["__print"]), "left_semi")
    return stay.dropDuplicates(["doc_id", "fingerprint"]).drop("fingerprint").withColumnRenamed("__fingerprint", "fingerprint")
