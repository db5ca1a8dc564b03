"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import map_texts, slices

UNDETERMINED = "und"
BUCKETS = 1 << 16
PIECE_BYTES = 1 << 20
# ASCII bytes other than letters become spaces.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits; bucket 0 is empty
    scale: np.ndarray  # 2 x bits: slope and intercept of the margins


def code_book(n: int, seed: int = 7) -> np.ndarray:
    """Codewords as +-1, one row a language: all splits of up to 6 languages, else the best of 200 random books of 63 bits."""
    if n <= 6:
        columns = [[1 if i == 0 else 1 - 2 * (split >> (i - 1) & 1) for i in range(n)] for split in range(1, 1 << max(n - 1, 0))]
        return np.array(columns, np.float64).reshape(-1, n).T
    rng = np.random.default_rng(seed)
    books = (np.where(rng.random((n, 63)) < 0.5, -1.0, 1.0) for _ in range(200))
    return max(books, key=lambda b: -(b @ b.T - 64 * np.eye(n)).max())


def gram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams and bigrams of every position, and where each text starts and ends (null: empty).

    Letters are lower-cased, runs of other ASCII characters are one space. Grams that reach over a text's end have bucket 0.
    """
    binary = pc.fill_null(pc.utf8_lower(texts), "").cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64, len(binary) + 1, 8 * binary.offset)
    raw = np.frombuffer(binary.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(binary) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    clean = np.frombuffer(raw.tobytes().translate(LETTERS), np.uint8)
    keep = clean != 32
    keep[1:] |= clean[:-1] != 32
    offsets = np.concatenate([[0], keep.cumsum()])[offsets]
    text = np.concatenate([clean[keep].astype(np.uint32), np.zeros(2, np.uint32)])
    two = text[:-2] * np.uint32(0x9E3779B1) + text[1:-1] * np.uint32(0x85EBCA6B)
    three = two + text[2:] * np.uint32(0xC2B2AE35)
    buckets = np.stack([three * np.uint32(0x27D4EB2F) >> np.uint32(16), two * np.uint32(0x165667B1) >> np.uint32(16)])
    ends = offsets[1:]
    for back in (1, 2):
        over = ends[ends - back >= offsets[:-1]] - back
        buckets[: 3 - back, over] = 0
    return buckets, offsets[:-1], ends


def margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Mean weight of a text's grams for each bit (texts x bits)."""
    buckets, starts, ends = gram_buckets(texts)
    out = np.zeros((len(texts), weights.shape[1]))
    full = np.flatnonzero(ends > starts)
    for i, j in _pieces(ends - starts, full):
        rows = full[i:j]
        a, z = starts[rows[0]], ends[rows[-1]]
        for own in buckets:
            for k in range(a, z, PIECE_BYTES):  # a long text is summed piece by piece
                part = weights[own[k:min(k + PIECE_BYTES, z)]]
                first = np.searchsorted(ends[rows], k, "right")
                at = np.maximum(starts[rows[first:]] - k, 0)
                at = at[at < len(part)]
                out[rows[first:first + len(at)]] += np.add.reduceat(part, at, axis=0)
    return out / np.maximum(2 * (ends - starts), 1)[:, None]


def _pieces(lengths: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
    total = lengths[rows].cumsum()
    i = 0
    while i < len(rows):
        j = max(int(np.searchsorted(total, (total[i - 1] if i else 0) + PIECE_BYTES, "right")), i + 1)
        yield i, j
        i = j


def fit(texts: list[str], languages: list[str]) -> LanguageModel:
    """Naive Bayes log ratios for every bit of the code, with margins scaled by logistic regression."""
    known = tuple(sorted(set(languages)))
    codes = code_book(len(known))
    if not codes.shape[1]:
        return LanguageModel(known, codes, np.zeros((BUCKETS, 0), np.float32), np.zeros((2, 0)))
    counts = np.zeros((len(known), BUCKETS))
    array, label = pa.array(texts, pa.string()), np.array([known.index(x) for x in languages])
    size = np.array([len(t.encode()) for t in texts])
    for i, j in _pieces(size, np.arange(len(texts))):  # about 1 MB of text at a time
        buckets, starts, ends = gram_buckets(array.slice(i, j - i))
        of_position = np.repeat(label[i:j], ends - starts)
        for own in buckets:
            counts += np.bincount(of_position * BUCKETS + own, minlength=counts.size).reshape(counts.shape)
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)  # languages count alike
    smooth = 0.5 / BUCKETS
    weights = np.stack([np.log((share[c > 0].mean(0) + smooth) / (share[c < 0].mean(0) + smooth)) for c in codes.T], axis=1)
    weights[0] = 0
    weights = weights.astype(np.float32)
    found = np.concatenate([margins(array.slice(i, j - i), weights) for i, j in _pieces(size, np.arange(len(texts)))])
    scale = np.array([_logistic(found[:, b], codes[label, b]) for b in range(codes.shape[1])]).T
    return LanguageModel(known, codes, weights, scale)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept by Newton's method."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - (y > 0)) / len(x) + ridge * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design / len(x) + ridge * np.eye(2)
        beta = beta - np.linalg.solve(hessian, gradient)
    return float(beta[0]), float(beta[1])


def decode(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the codeword with the least logistic loss, its share of exp(-loss), and that of the second best."""
    z = margins(texts, model.weights) * model.scale[0] + model.scale[1]
    loss = np.logaddexp(0, -z[:, None, :] * model.codes[None, :, :]).sum(2)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    share /= share.sum(1, keepdims=True)
    best = share.argmax(1)
    ordered = np.sort(share, axis=1)
    return best, ordered[:, -1], ordered[:, -2] if share.shape[1] > 1 else np.zeros(len(best))


def fit_sample(docs: DataFrame, train: Column, per_language: int = 1000, at_most: int = 20_000, longest: int = 100_000) -> LanguageModel | None:
    """Fits on a bounded sample of the rows that `train` admits: about `per_language` documents of each language, `at_most`
    in all, none longer than `longest` characters, chosen by a hash of the id. None without such rows."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not found:
        return None
    quota = min(per_language, at_most / len(found))
    share = F.create_map(*[F.lit(x) for lang, n in found.items() for x in (lang, min(1.0, quota / n))])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where((draw < share) & (F.length("text") <= longest)).orderBy("doc_id", F.xxhash64("text")).collect()
    return fit([r["text"] for r in sample], [r["lang"] for r in sample]) if sample else None


def identify(docs: DataFrame, model: LanguageModel | None, least_lead: float = 0.05) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous to every row; other columns are kept.

    Null texts and texts without a letter are `und` with score 0, and so is every text if there is no model. ambiguous: the
    best codeword leads the second by less than `least_lead`. Rows are independent; columns that have the name of a result
    are replaced. The model is a few MB at any size of the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "ambiguous")
    schema = ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in kept.schema)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                if model is None or not model.languages:
                    names, score, unsure = [UNDETERMINED] * len(part), np.zeros(len(part)), np.zeros(len(part), bool)
                else:
                    best, score, second = decode(model, text)
                    real = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
                    names = [model.languages[i] if ok else UNDETERMINED for i, ok in zip(best, real, strict=True)]
                    unsure = real & (score - second < least_lead)
                    score = np.where(real, score, 0.0)
                arrays = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, "lang_pred", "score", "ambiguous"])

    return map_texts(kept, predict, schema + ", lang_pred string, score double, ambiguous boolean")
