"""Byte-level BPE with sentencepiece: the model file is written here from a list of ranks, nothing is trained."""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from tracemill.llm.common import map_texts, slices

RUN_TOKENS = 1 << 19
KNOWN_TOKENS = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes by rank from a file with lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_alphabet() -> str:
    """One visible character for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in visible else next(hidden)) for b in range(256))


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes(out + bytes([value]))


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def build_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece i is the token of rank i in visible characters, scored -i; the last one is unknown.

    Ranks run from 0 without gaps. The normaliser is the identity: no prefix, no change of white space.
    """
    alphabet = byte_alphabet()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    bpe, unknown, none = 2, len(by_rank), -1
    pieces = [_block(1, _block(1, token.decode("latin-1").translate(alphabet).encode()) + b"\x15" + struct.pack("<f", -rank)) for rank, token in enumerate(by_rank)]
    pieces.append(_block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)))
    trainer = _number(3, bpe) + _number(4, unknown + 1) + _number(40, unknown) + _number(41, none) + _number(42, none) + _number(43, none)
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normalizer)


class ByteBpe:
    """Encodes and decodes groups of texts; equal pre-tokens of a run are encoded once."""

    def __init__(self, model: bytes, pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(self.alphabet)}
        pieces = [bytes(back[c] for c in self.processor.id_to_piece(i)) for i in range(self.processor.get_piece_size() - 1)]
        self.known: dict[str, list[int]] = {}
        self.whole = {token: i for i, token in enumerate(pieces)}
        self.pieces = pa.array(pieces, pa.binary())
        self.decimal = pa.array([b"%d " % i for i in range(len(pieces))], pa.binary())

    def _merge(self, tokens: list[str]) -> list[list[int]]:
        """Ids of distinct pre-tokens: one that is itself in the vocabulary is that piece, others are merged.

        What earlier runs have merged is kept as long as it is at most KNOWN_TOKENS pre-tokens.
        """
        out = list(map(self.known.get, tokens))
        rest = [t for t, ids in zip(tokens, out, strict=True) if ids is None]
        whole = [self.whole.get(t.encode()) for t in rest]
        visible = [t.encode().decode("latin-1").translate(self.alphabet) for t, i in zip(rest, whole, strict=True) if i is None]
        merged = iter(self.processor.encode(visible, out_type=int, num_threads=1))
        new = {t: next(merged) if i is None else [i] for t, i in zip(rest, whole, strict=True)}
        if len(self.known) + len(new) > KNOWN_TOKENS:
            self.known = {}
        if len(new) <= KNOWN_TOKENS:
            self.known.update(new)
        return [new[t] if ids is None else ids for t, ids in zip(tokens, out, strict=True)]

    def _run(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of pre-tokens and how many each has."""
        coded = pa.array(tokens, pa.string()).dictionary_encode()
        merged = self._merge(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        length = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter(chain.from_iterable(merged), np.int32, int(length.sum()))
        counts = length[codes]
        ends = counts.cumsum()
        shift = (length.cumsum() - length)[codes] - (ends - counts)
        return flat[np.repeat(shift, counts) + np.arange(int(counts.sum()))], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text ends; pre-tokens are held for one run at a time."""
        ids, counts, run, bounds, n = [], [], [], [], 0
        for text in texts:
            matches = (m.group() for m in self.pattern.finditer(text)) if len(text) > RUN_TOKENS else None
            while found := self.pattern.findall(text) if matches is None else list(islice(matches, RUN_TOKENS)):
                run += found
                n += len(found)
                if len(run) >= RUN_TOKENS:
                    for out, part in zip((ids, counts), self._run(run), strict=True):
                        out.append(part)
                    run = []
                if matches is None:
                    break
            bounds.append(n)
        for out, part in zip((ids, counts), self._run(run), strict=True):
            out.append(part)
        ends = np.concatenate([[0], np.concatenate(counts).cumsum()])
        return np.concatenate(ids), ends[bounds].astype(np.int64)

    def written(self, ids: np.ndarray, ends: np.ndarray, values: pa.Array) -> Iterator[memoryview]:
        """The bytes that `values` has for the ids of each text, in a row."""
        out = values.take(pa.array(ids, pa.int32()))
        offsets = np.frombuffer(out.buffers()[1], np.int32, len(out) + 1, 4 * out.offset) if len(out) else np.zeros(1, np.int32)
        data = memoryview(out.buffers()[2] or b"")
        start = 0
        for end in offsets[ends].tolist():
            yield data[start:end]
            start = end


@functools.lru_cache(maxsize=2)
def _loaded(model: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(model, pattern)


def tokenize(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Adds ids (if asked for), n_tokens, ids_sha256 and decoded_sha256 to every row.

    Each match of `pattern` is encoded by itself, without special tokens. The ids are then decoded again, so that
    decoded_sha256 is the digest of what the ids stand for. Null and empty texts have no ids: n_tokens is 0 and both digests
    are those of no bytes. Rows are independent: repeated rows, empty tables and other columns need no care; columns that
    have the name of a result are replaced. The vocabulary file is read on the driver (its size is fixed, about 1 MB).
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(build_model(read_ranks(vocabulary)))
    added = ["ids"] * with_ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = docs.drop("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    schema = ", ".join(["`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in kept.schema])
    schema += (", ids array<int>" if with_ids else "") + ", n_tokens long, ids_sha256 string, decoded_sha256 string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(model.value, pattern)
        for batch in batches:
            for part in slices(batch, text):
                ids, ends = bpe.encode([t or "" for t in part.column(text).to_pylist()])
                arrays = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))] if with_ids else []
                arrays.append(pa.array(np.diff(ends, prepend=0), pa.int64()))
                arrays.append(pa.array([hashlib.sha256(d[:-1]).hexdigest() for d in bpe.written(ids, ends, bpe.decimal)], pa.string()))
                arrays.append(pa.array([hashlib.sha256(d).hexdigest() for d in bpe.written(ids, ends, bpe.pieces)], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *added])
        bpe.known = {}  # the worker outlives this task

    return map_texts(kept, encode, schema)
