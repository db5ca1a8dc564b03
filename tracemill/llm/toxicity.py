"""Toxic spans by a linear-chain conditional random field over words, summed up to document scores."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import map_texts, slices

BUCKETS = 1 << 18
PREFIXES, SUFFIXES = range(3, 9), range(3, 6)
# Bytes of a word above which it is a run without spaces, and the same for one with characters of three bytes or more, as in
# scripts that do not part words.
LONGEST, LONGEST_WIDE = 32, 8
WIDE = re.compile(rb"[\xe0-\xff]")
WHOLE = len(PREFIXES)  # column of the whole word
# A chain of more words is cut into parts that overlap on both sides.
PART, OVERLAP = 2048, 512
# Bytes that separate words: ASCII other than letters and digits.
SEPARATORS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
WORD = re.compile(r"(?:[^\W_]|[^\x00-\x7f])+")
MAX_TRANSITION = 3.0


@dataclass(frozen=True)
class ToxicModel:
    weights: np.ndarray  # by bucket of a word's features
    bias: float
    transition: np.ndarray  # 2 x 2 potentials, not logarithms
    document: np.ndarray  # intercept and weights of the document's features


@dataclass(frozen=True)
class Words:
    """Every position of a text has one candidate, its word, or several where a run without spaces has no words."""

    features: np.ndarray  # distinct candidates x features
    codes: np.ndarray  # distinct candidate of each candidate
    heads: np.ndarray | None  # first candidate of each position; None if each has one
    starts: np.ndarray  # first position of each text
    lengths: np.ndarray  # positions of each text
    firsts: np.ndarray | None  # first position of each word or run; None if each has one position
    counts: np.ndarray  # words and runs of each text

    def position(self) -> np.ndarray:
        """Position of each candidate."""
        return np.repeat(np.arange(len(self.heads)), np.diff(self.heads, append=len(self.codes))) if self.heads is not None else np.arange(len(self.codes))

    def best(self, values: np.ndarray) -> np.ndarray:
        """Largest value of each position's candidates."""
        return values if self.heads is None else np.maximum.reduceat(values, self.heads)

    def chosen(self, values: np.ndarray) -> np.ndarray:
        """Code of each position's first candidate of the largest value."""
        if self.heads is None:
            return self.codes
        place = np.flatnonzero(values == self.best(values)[self.position()])
        return self.codes[place[np.searchsorted(place, self.heads)]]


def is_run(word: bytes) -> bool:
    return len(word) > LONGEST or len(word) > LONGEST_WIDE and WIDE.search(word) is not None


def candidates(run: bytes) -> Iterator[list[bytes]]:
    """For each character of a run without spaces what may be a word there: whole characters of as many bytes as a prefix that is a feature."""
    ends = lambda at: at == len(run) or at < len(run) and run[at] & 0xC0 != 0x80
    for i, b in enumerate(run):
        if b & 0xC0 != 0x80:
            yield [run[i:i + n] for n in PREFIXES if ends(i + n)] or [run[i:]]


def read_words(texts: pa.Array) -> Words:
    """Lower-cased words of each text (null: none), candidates within runs, and the hashed features of the distinct ones."""
    raw = pc.fill_null(pc.utf8_lower(texts), "").cast(pa.large_binary()).to_pylist()
    lengths, n_words = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    chunks, run, sizes, positions = [], [], [], []

    def keep(words: list[bytes]) -> None:
        run.extend(words)
        if len(run) > 1 << 18:
            chunks.append(pa.array(run, pa.binary()))
            run.clear()

    for i, text in enumerate(raw):
        words = text.translate(SEPARATORS).split()
        lengths[i] = n_words[i] = len(words)
        if max(map(len, words), default=0) <= LONGEST and not WIDE.search(text):
            keep(words)
            sizes.append(np.ones(len(words), np.int8))
            positions.append(np.ones(len(words), np.int64))
            continue
        counts, per_word = array("b"), []
        for word in words:
            before = len(counts)
            for near in candidates(word) if is_run(word) else ([word],):
                keep(near)
                counts.append(len(near))
            per_word.append(len(counts) - before)
        lengths[i] = len(counts)
        positions.append(np.array(per_word, np.int64))
        sizes.append(np.frombuffer(counts, np.int8) if counts else np.empty(0, np.int8))
    coded = pa.concat_arrays([*chunks, pa.array(run, pa.binary())]).dictionary_encode()
    codes, per = coded.indices.to_numpy(), np.concatenate([*sizes, np.empty(0, np.int8)])
    heads = per.cumsum(dtype=np.int64) - per if len(per) < len(codes) else None
    wide = np.concatenate([*positions, np.empty(0, np.int64)])
    firsts = wide.cumsum() - wide if len(wide) < len(per) else None
    return Words(word_features(coded.dictionary), codes, heads, lengths.cumsum() - lengths, lengths, firsts, n_words)


def word_features(words: pa.Array) -> np.ndarray:
    """Buckets of the whole word of LONGEST bytes or less, its prefixes and its suffixes in bytes; bucket 0 where it is shorter."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset) if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8).astype(np.uint32)
    first, size = offsets[:-1].astype(np.int64), np.diff(offsets)
    last = first + size - 1
    columns = []

    def bucket(h: np.ndarray, kind: int, real: np.ndarray) -> None:
        mixed = (h + np.uint32(kind)) * np.uint32(0x9E3779B1)
        columns.append(np.where(real, (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA6B) % np.uint32(BUCKETS - 1) + np.uint32(1), 0).astype(np.int32))

    h = np.zeros(len(size), np.uint32)
    for j in range(LONGEST):
        inside = np.flatnonzero(size > j)
        h[inside] = h[inside] * np.uint32(0x01000193) + data[first[inside] + j] + np.uint32(1)
        if j + 1 in PREFIXES:
            bucket(h, j + 1, size > j)
    bucket(h + size.astype(np.uint32) * np.uint32(0xC2B2AE35), 0, size > 0)
    h = np.zeros(len(size), np.uint32)
    for j in range(max(SUFFIXES)):
        inside = np.flatnonzero(size > j)
        h[inside] = h[inside] * np.uint32(0x01000193) + data[last[inside] - j] + np.uint32(1)
        if j + 1 in SUFFIXES:
            bucket(h, 100 + j, size > j)
    return np.stack(columns, axis=1)


def _sweep(odds: np.ndarray, starts: np.ndarray, lengths: np.ndarray, t: np.ndarray, backward: bool) -> np.ndarray:
    """Ratio of the two states' forward (or backward) messages at every position, all chains at once."""
    out = np.ones_like(odds)
    order = np.argsort(-lengths, kind="stable")
    at = (starts + lengths - 1 if backward else starts)[order]
    alive = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), "right")
    step = -1 if backward else 1
    ratio = np.ones(len(order))
    for i, n in enumerate(alive):
        here = at[:n]
        if backward:
            if i:
                carried = odds[here + 1] * ratio[:n]
                ratio = (t[1, 0] + t[1, 1] * carried) / (t[0, 0] + t[0, 1] * carried)
            else:
                ratio = ratio[:n]
            out[here] = ratio
        else:
            ratio = odds[here] * ((t[0, 1] + t[1, 1] * ratio[:n]) / (t[0, 0] + t[1, 0] * ratio[:n]) if i else 1.0)
            out[here] = ratio
        at = here + step
    return out


def chain_marginals(odds: np.ndarray, starts: np.ndarray, lengths: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at every position by forward-backward.

    odds: ratio of the toxic and the clean emission. Long chains are cut into parts with an overlap on both sides. A part
    starts without knowing what came before; as transitions are bounded, that fades by a constant factor a word and is
    below 1e-12 when the part proper begins.
    """
    parts = -(-np.maximum(lengths, 1) // PART)
    chain = np.repeat(np.arange(len(lengths)), parts)
    begin = (np.arange(len(chain)) - np.repeat(parts.cumsum() - parts, parts)) * PART
    end = np.minimum(begin + PART, lengths[chain])
    low, high = np.maximum(begin - OVERLAP, 0), np.minimum(end + OVERLAP, lengths[chain])
    size = high - low
    place = size.cumsum() - size
    source = np.repeat(starts[chain] + low - place, size) + np.arange(int(size.sum()))
    spread = odds[source]
    ratio = _sweep(spread, place, size, t, False) * _sweep(spread, place, size, t, True)
    proper = np.arange(len(source)) - np.repeat(place, size) + np.repeat(low, size)
    inside = (proper >= np.repeat(begin, size)) & (proper < np.repeat(end, size))
    out = np.zeros(len(odds))
    out[source[inside]] = (ratio / (1 + ratio))[inside]
    return out


def word_odds(model: ToxicModel, words: Words) -> np.ndarray:
    return words.best(np.exp(np.clip(model.weights[words.features].sum(1) + model.bias, -20, 20))[words.codes])


def document_features(p: np.ndarray, words: Words) -> np.ndarray:
    """Per text: 1, largest marginal, log of their sum and of their mean; zeros but for the 1 in a text without words.

    A run without spaces counts as one word of its largest marginal, so that its length alone adds nothing.
    """
    p = p if words.firsts is None else np.maximum.reduceat(p, words.firsts)
    starts, full = words.counts.cumsum() - words.counts, words.counts > 0
    out = np.zeros((len(words.counts), 4))
    out[:, 0] = 1
    if full.any():
        at = starts[full]
        total = np.add.reduceat(p, at)
        out[full, 1] = np.maximum.reduceat(p, at)
        out[full, 2] = np.log1p(total)
        out[full, 3] = np.log1p(100 * total / words.counts[full])
    return out


def label_words(words: Words, toxic: np.ndarray) -> np.ndarray:
    """Labels of words from labels of documents: a word of a toxic document is toxic if one of its features marks such documents.

    A feature does if the log ratio of its shares of toxic and other documents, less 2.5 standard errors, is above 1. A word
    that is itself in 20 documents or more is judged by itself, not by its prefixes and suffixes.
    """
    document = np.repeat(np.arange(len(words.lengths)), words.lengths)[words.position()]
    pairs = np.unique(document.astype(np.int64) * len(words.features) + words.codes)
    per_toxic, per_clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    of_doc, of_word = pairs // max(len(words.features), 1), pairs % max(len(words.features), 1)
    for column in words.features.T:
        seen = np.unique(of_doc * BUCKETS + column[of_word])
        bad = toxic[seen // BUCKETS] > 0
        per_toxic += np.bincount(seen[bad] % BUCKETS, minlength=BUCKETS)
        per_clean += np.bincount(seen[~bad] % BUCKETS, minlength=BUCKETS)
    n_bad = max(int((toxic > 0).sum()), 1)
    a, b = per_toxic + 0.5, per_clean + 0.5
    marks = np.log(a / (n_bad + 1)) - np.log(b / (len(toxic) - n_bad + 1)) - 2.5 * np.sqrt(1 / a + 1 / b) > 1
    marks[0] = False
    whole = words.features[:, WHOLE]
    judged = np.where((per_toxic + per_clean)[whole] >= 20, marks[whole], marks[words.features].any(1))
    return words.best(judged[words.codes] & (toxic[document] > 0))


def fit(texts: list[str], labels: list[int], steps: int = 40, ridge: float = 1e-4) -> ToxicModel:
    """Labels words, trains the chain by Adam on its log likelihood, and the document score by logistic regression."""
    words, toxic = read_words(pa.array(texts, pa.string())), np.array(labels)
    y = label_words(words, toxic)
    model = np.zeros(BUCKETS + 5)  # weights, bias, transitions
    model[BUCKETS] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    inner = np.ones(len(y), bool)
    inner[words.starts[words.lengths > 0]] = False
    before, after = y[:-1][inner[1:]].astype(int), y[1:][inner[1:]].astype(int)
    seen = np.bincount(before * 2 + after, minlength=4).reshape(2, 2)
    mean, square = np.zeros_like(model), np.zeros_like(model)
    rate, n = 0.3, max(len(y), 1)
    for step in range(1, steps + 1):
        t = np.exp(model[BUCKETS + 1:].reshape(2, 2))
        odds = np.exp(np.clip(model[:BUCKETS][words.features].sum(1) + model[BUCKETS], -20, 20))
        codes = words.chosen(odds[words.codes])
        odds = odds[codes]
        forward, backward = _sweep(odds, words.starts, words.lengths, t, False), _sweep(odds, words.starts, words.lengths, t, True)
        ratio = forward * backward
        p = ratio / (1 + ratio)
        of_word = np.bincount(codes, p - y, minlength=len(words.features))
        gradient = np.zeros_like(model)
        for column in words.features.T:
            gradient[:BUCKETS] += np.bincount(column, of_word, minlength=BUCKETS)
        gradient[0], gradient[BUCKETS] = 0, of_word.sum()
        left, right = forward[:-1][inner[1:]], (odds * backward)[1:][inner[1:]]
        total = (t[0, 0] + t[0, 1] * right) + left * (t[1, 0] + t[1, 1] * right)
        left, right = left / total, right / total
        gradient[BUCKETS + 1:] = np.array([t[0, 0] * (1 / total).sum(), t[0, 1] * right.sum(), t[1, 0] * left.sum(), t[1, 1] * (left * right * total).sum()]) - seen.ravel()
        del forward, backward, ratio, p, odds, left, right, total
        gradient = gradient / n + ridge * model
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        model -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
        model[BUCKETS + 1:] = np.clip(model[BUCKETS + 1:], -MAX_TRANSITION / 2, MAX_TRANSITION / 2)
    chain = ToxicModel(model[:BUCKETS].astype(np.float32), float(model[BUCKETS]), np.exp(model[BUCKETS + 1:].reshape(2, 2)), np.zeros(4))
    x = document_features(chain_marginals(word_odds(chain, words), words.starts, words.lengths, chain.transition), words)
    return ToxicModel(chain.weights, chain.bias, chain.transition, _logistic(x, toxic))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-3) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(beta))
        beta = beta - np.linalg.solve(hessian, x.T @ (p - y) / len(x) + ridge * beta)
    return beta


def score(model: ToxicModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """Score of each text, marginal of each word, and the words."""
    words = read_words(texts)
    p = chain_marginals(word_odds(model, words), words.starts, words.lengths, model.transition)
    return 1 / (1 + np.exp(-np.clip(document_features(p, words) @ model.document, -30, 30))), p, words


def offending(text: str, p: np.ndarray, least: float) -> list[dict]:
    """Offsets (code points) and mean marginals of runs of words whose marginal is at least `least`.

    A position in a run without spaces stands for its longest candidate.
    """
    spans, last, i = [], None, 0
    for word in WORD.finditer(pc.utf8_lower(pa.scalar(text)).as_py()):
        whole = word.group().encode()
        for k, near in enumerate(candidates(whole) if is_run(whole) else ([whole],)):
            if i < len(p) and p[i] >= least:
                start = word.start() + k
                end = start + len(near[-1].decode())
                if spans and (last == i - 1 or start < spans[-1][1]):
                    spans[-1][1], spans[-1][2] = max(end, spans[-1][1]), [*spans[-1][2], p[i]]
                else:
                    spans.append([start, end, [p[i]]])
                last = i
            i += 1
    return [{"start": a, "end": z, "score": float(np.mean(s))} for a, z, s in spans]


def fit_sample(docs: DataFrame, labels: DataFrame, train: Column, per_label: int = 1500, longest: int = 50_000) -> ToxicModel | None:
    """Fits on a bounded sample of the labelled rows that `train` (of doc_id) admits: about `per_label` documents of each
    label, none longer than `longest` characters, chosen by a hash of the id. None if a label is missing.

    The sample is fitted in a task, so the driver holds the finished model alone."""
    rows = labels.where(train & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    found = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, per_label / found[1])).otherwise(min(1.0, per_label / found[0]))
    chosen = rows.where(draw < share).dropDuplicates(["doc_id"]).limit(4 * per_label)
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = texts.orderBy("doc_id", F.xxhash64("text")).select("text", "toxic").limit(8 * per_label)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            labels += batch.column("toxic").to_pylist()
        if len(set(labels)) == 2:
            model = fit(texts, labels)
            row = {"weights": model.weights.tobytes(), "bias": model.bias, "transition": model.transition.ravel().tolist(), "document": model.document.tolist()}
            yield pa.RecordBatch.from_pylist([row])

    learnt = map_texts(sample, learn, "weights binary, bias double, transition array<double>, document array<double>").collect()
    if not learnt:
        return None
    weights, bias, transition, document = learnt[0]
    return ToxicModel(np.frombuffer(weights, np.float32), bias, np.array(transition).reshape(2, 2), np.array(document))


def score_toxicity(docs: DataFrame, model: ToxicModel | None, threshold: float = 0.3, span_threshold: float = 0.5, with_spans: bool = True) -> DataFrame:
    """Adds score, predicted (1 from `threshold` on) and toxic_spans (start, end, score; offsets in code points) to every row.

    Null texts and texts without words are scored by the intercept alone and have no spans; without a model every score is
    0. Rows are independent; other columns are kept, those with the name of a result are replaced. The model has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted", "toxic_spans")
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    schema = ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in kept.schema)
    schema += ", score double, predicted int" + (", toxic_spans array<struct<start:int,end:int,score:double>>" if with_spans else "")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                spans = [[] for _ in range(len(part))] if with_spans else []
                if model is None:
                    scores = np.zeros(len(part))
                else:
                    scores, p, words = score(model, text)
                    hits = np.flatnonzero(p >= span_threshold) if with_spans else []
                    for i in np.unique(np.searchsorted(words.starts + words.lengths, hits, "right")):
                        spans[i] = offending(text[int(i)].as_py(), p[words.starts[i]:words.starts[i] + words.lengths[i]], span_threshold)
                arrays = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))] + ([pa.array(spans, spans_type)] if with_spans else [])
                names = [*part.schema.names, "score", "predicted"] + ["toxic_spans"] * with_spans
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=names)

    return map_texts(kept, predict, schema)
