"""Operators against plain restatements on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import byte_bpe, chat_format, decision_list, hilbert_ann, html_extract, language_id, minhash_dedup, mixing, simhash_dedup, toxicity, url_vocabulary
from tracemill.llm.components import components
from tracemill.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} {i}" for i in range(20_000))
TEXTS = [
    None, "", " \t\n", "one", "One two", "a b c", "A B C", "a b c d", "the cat sat on the mat", "The cat sat on the MAT", LONG, LONG + " end",
    "é à 日本語 \U0001f600 </turn> ### \\", "x" * 3000, "12 34 56", "\x00 \x01", "line\nline\n\nline\n", "a a a a a a a a a a a a a a a a a a a a",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", 1, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[8], rows[8], (None, "the cat sat", None, None, None, None), (-5, TEXTS[10], "en", "s1", 2, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, fingerprint string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text):
    return WORD.findall(text or "")


# chat formatting


def test_chats_read_back(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "#", "##", "####### \\0\\1\\2", "</turn", "</turn></turn>", "### x: y</turn>\n", "\\", "a\n\n: b"]
    roles = ["user", "assistant", "assistant", None, "we: ird\n### r", "user", "user"]
    rows = [(c, t, roles[(c + t) % 7], odd[(3 * c + t) % len(odd)], "z") for c in range(5) for t in range(40)]
    rows += [(9, t, "user" if t % 3 else "assistant", odd[t % len(odd)], "z") for t in range(1000)] + [(None, None, "assistant", "q", "z"), (9, 3, "user", "again", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat_format.format_chats(df).select("conv_id", "formatted", chat_format.read_chats("formatted").alias("turns"), chat_format.loss_text("pieces").alias("loss"))
    want = {}
    for c, t, r, x, _ in rows:
        want.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    found = {r.conv_id: r for r in got.collect()}
    assert set(found) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in found[c].turns] == [(r, x) for _, r, x in turns]
        assert found[c].loss == "".join(x for _, r, x in turns if r == "assistant")
        headers = sum(i == 0 or turns[i - 1][1] != turns[i][1] for i in range(len(turns)))
        assert found[c].formatted.count("### ") == headers and found[c].formatted.count("</turn>") == len(turns)
    assert chat_format.format_chats(df.limit(0)).count() == 0


# mixing


def fill(sizes, weights, share, repeats):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > repeats * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = repeats * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mixture_takes_targets(spark, docs, none):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), [None, "a", "b", "c", "d"][min(int(rng.exponential(1.2)), 4)], "k") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    got = mixing.mix_sources(df).collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r["size"] == len(words(rows[r.doc_id][1])) and r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
    target = fill(sizes, (3, 1, 2), 1.5, 2)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    assert all(abs(taken[s] - target[s]) <= 60 for s in target) and sum(taken.values()) <= 1.5 * sum(sizes.values()) + 1e-6
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    odd = mixing.mix_sources(docs).collect()
    assert len(odd) == docs.count() and {r.fingerprint for r in odd} == {"x", "y", None}
    assert mixing.mix_sources(none).count() == 0


# language


def test_languages(spark, docs, none):
    base = {"aa": "la le li lo lu", "bb": "ka ke ki ko ku", "cc": "zor zar zir zur"}
    rng = np.random.default_rng(0)
    make = lambda lang: " ".join(rng.choice(base[lang].split(), 30))
    texts = [(lang, make(lang)) for lang in base for _ in range(40)]
    model = language_id.fit([t for _, t in texts], [lang for lang, _ in texts])
    best, score, second = language_id.decode(model, pa.array([make("bb"), make("cc"), make("aa")]))
    assert [model.languages[i] for i in best] == ["bb", "cc", "aa"] and (score > 0.9).all() and (second < 0.1).all()
    got = language_id.identify(docs.withColumn("lang_pred", F.lit(1)), model).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.lang_pred == "und" and r.score == 0) == (not re.search(r"[^\W\d_]", r.text or "")) and 0 <= r.score <= 1
    assert language_id.identify(none, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.fit_sample(none, F.lit(True)) is None
    one = language_id.fit_sample(docs, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, one).collect()} == {"und", "en"}


def test_margins_do_not_depend_on_pieces(monkeypatch):
    weights = np.random.default_rng(1).normal(size=(language_id.BUCKETS, 3)).astype(np.float32)
    texts = pa.array([None, "", "a", "ab", "Abc  def", LONG[:5000], "é" * 300, "x y"])
    whole = language_id.margins(texts, weights)
    monkeypatch.setattr(language_id, "PIECE_BYTES", 7)
    assert np.allclose(whole, language_id.margins(texts, weights), atol=1e-4)
    assert all(np.allclose(whole[i], language_id.margins(texts.slice(i, 1), weights)[0], atol=1e-4) for i in range(len(texts)))


def test_code_books_are_far_apart():
    for n in (3, 4, 5, 20):
        book = language_id.code_book(n)
        apart = [(book[i] != book[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (book.shape[1] + 1) // 2 if n <= 6 else min(apart) >= 20


# simhash


def brute_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(docs, none):
    got = simhash_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    known = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    prints = {i: brute_fingerprint(t) for i, t in known.items()}
    classes = brute_components(prints)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", classes[r.doc_id])
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(classes.values()))
    assert simhash_dedup.near_duplicates(none).count() == 0 and simhash_dedup.keep_one(none).count() == 0


def test_links_of_many_close_fingerprints(spark):
    rng = np.random.default_rng(5)
    values = set()
    for _ in range(4):
        centre = int(rng.integers(0, 1 << 63))
        values |= {centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (150, 3))}
    values |= {int(v) for v in rng.integers(0, 1 << 63, 100)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long").repartition(4)
    links = simhash_dedup.link_fingerprints(df)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links.collect())
    roots = {r.node: r.root for r in components(links).collect()}
    want = brute_components(dict(zip(signed, values, strict=True)))
    assert {v: roots.get(v, v) for v in signed} == want


def test_near_copies_of_large_chained_groups(spark):
    """One group of slowly drifting copies, so that few texts are linked to any head, and texts that only share a passage."""
    rng = np.random.default_rng(4)
    base, texts = [f"w{i}" for i in rng.integers(0, 9000, 120)], []
    for i in range(60):
        if i % 3 == 0:
            base = list(base)
            base[int(rng.integers(0, 120))] = f"n{i}"
        texts.append(" ".join([*base, f"end{i}"]))
    passage = [f"p{i}" for i in range(100)]
    texts += [" ".join([*passage, *(f"q{i}x{k}" for k in range(30))]) for i in range(20)]
    shingled = [{tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    close = {(i, j) for i in range(len(texts)) for j in range(i) if len(shingled[i] & shingled[j]) >= 0.8 * len(shingled[i] | shingled[j])}
    parent = {i: i for i in range(len(texts))}
    for i, j in close:
        if parent[i] != parent[j]:
            old = parent[i]
            parent = {k: parent[j] if r == old else r for k, r in parent.items()}
    rows = spark.createDataFrame(list(enumerate(texts)), "print long, text string")
    roots = {r.node: r.root for r in minhash_dedup.link_texts(rows).collect()}
    got = {i: roots.get(i, i) for i in parent}
    assert len({(parent[i], got[i]) for i in parent}) == len(set(parent.values())) == len(set(got.values()))


@pytest.mark.parametrize("broadcast", [True, False])
def test_pairs_inside_a_large_group_of_unlike_copies(spark, monkeypatch, broadcast):
    """Copies of one text, most below 0.8 to it and to each other, a second group beside it, and planted pairs just above 0.8."""
    if not broadcast:
        monkeypatch.setattr(minhash_dedup, "HEAD_HASHES", 0)
    rng = np.random.default_rng(21)
    texts = []

    def edited(base, edits, tag):
        return [f"{tag}e{i}" if i in edits else w for i, w in enumerate(base)]

    for group, copies in enumerate((300, 120)):
        centre = [f"g{group}w{i}" for i in rng.integers(0, 5000, 150)]
        for c in range(copies):
            texts.append(edited(centre, set(rng.choice(150, int(rng.integers(1, 14)), replace=False).tolist()), f"g{group}c{c}"))
    for pair in range(40):
        base = texts[int(rng.integers(0, 420))]
        far = edited(base, set(range(5, 145, 12)), f"p{pair}")
        texts += [far, edited(far, {20, 50, 80}, f"r{pair}")]
    texts += [[], ["one"], ["one"], ["a", "b"]]
    rows = spark.createDataFrame([(i, " ".join(t) + " " * (i % 3)) for i, t in enumerate(texts)], "print long, text string").repartition(5)
    shingled = [{tuple(t[k:k + 5]) for k in range(max(len(t) - 4, 1))} for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 10 * len(shingled[i] & shingled[j]) >= 8 * len(shingled[i] | shingled[j])]
    assert all((420 + 2 * p + 1, 420 + 2 * p) in set(near) for p in range(40))
    parent = {i: i for i in range(len(texts))}
    for i, j in near:
        if parent[i] != parent[j]:
            low, high = sorted((parent[i], parent[j]))
            parent = {k: low if r == high else r for k, r in parent.items()}
    roots = {r.node: r.root for r in minhash_dedup.link_texts(rows).collect()}
    assert {i: roots.get(i, i) for i in parent} == parent


def test_pipeline_drops_near_copies(spark, docs, none):
    rng = np.random.default_rng(11)
    rows = []
    for family in range(30):
        base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
        for copy in range(4):
            text = list(base)
            for i in rng.choice(200, copy * 2, replace=False) if copy < 3 else rng.choice(200, 60, replace=False):
                text[i] = f"n{family}x{copy}x{i}"
            rows.append((family * 10 + copy, " ".join(text), "en", "s", 1))
    shingled = {i: {tuple(t.split()[k:k + 5]) for k in range(196)} for i, t, *_ in rows}
    parent = {i: i for i in shingled}
    for i in shingled:
        for j in shingled:
            if i < j and len(shingled[i] & shingled[j]) >= 0.8 * len(shingled[i] | shingled[j]):
                parent = {k: parent[i] if r == parent[j] else r for k, r in parent.items()}
    want = sorted({min(k for k in parent if parent[k] == r) for r in parent.values()})
    assert 30 < len(want) < len(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = next(f for _, f in corpus_pipeline.STAGES if f is corpus_pipeline.drop_near_duplicates)
    got = stage(spark, table, "")
    assert got.columns == table.columns and sorted(r.doc_id for r in got.collect()) == want
    assert minhash_dedup.keep_one(docs).columns == docs.columns and minhash_dedup.keep_one(none).count() == 0
    kept = [r.doc_id for r in minhash_dedup.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) and 0 in kept and not {1, 2, 9} & set(kept)


def test_near_copies_by_simhash_without_bands(spark, monkeypatch):
    """Where no two texts share a band, the classes of fingerprints still give the close copies; the sets still decide."""
    monkeypatch.setattr(minhash_dedup, "_shared", lambda sketches: sketches.select(F.lit(0).cast("long").alias("band"), "print", "size").limit(0))
    long = [f"w{i}" for i in range(3000)]
    phrase = "a b c d e f g " * 60  # repeated shingles: near copies by their fingerprints, not by their sets
    texts = [" ".join(long), " ".join([*long, "end"]), *(phrase + " ".join(f"{c}{i}" for i in range(6)) for c in "xy"), "one two three"]
    prints = [brute_fingerprint(t) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 and (prints[2] ^ prints[3]).bit_count() <= 2
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, table, "").collect()) == [0, 2, 3, 4]


def test_golay_neighbours():
    patterns = simhash_dedup.error_patterns()
    rng = np.random.default_rng(2)
    word = rng.integers(0, 1 << 23, 500)
    near = word[:, None] ^ patterns[simhash_dedup.syndrome(word)]
    assert (simhash_dedup.syndrome(near.ravel()) == 0).all()
    for bit in range(23):
        other = word ^ (1 << bit)
        others = other[:, None] ^ patterns[simhash_dedup.syndrome(other)]
        assert (near[:, :, None] == others[:, None, :]).any((1, 2)).all()
    close = np.array([0, 1 << 5, 1 << 5 | 1 << 40, 1 << 63 - 1], np.int64)
    for a in close:
        for b in close:
            if int(a ^ b).bit_count() <= 2:
                keys = [set(simhash_dedup.golay_keys(np.array([v]))[1].tolist()) for v in (a, b)]
                assert keys[0] & keys[1]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# quality rules


def brute_statistics(text):
    w = words(text)
    places, seen, repeated = {}, set(), 0
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {i + k for own in places.values() if len(own) > 1 for i in own for k in range(8)}
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered)


def test_quality_statistics_and_rules(spark, docs, none):
    labels = spark.createDataFrame([(8, 1), (8, 0), (None, 0), (3, None), (99, 1)], "doc_id long, quality int")
    got = decision_list.judge_quality(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        want = brute_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.kept and r.base_failed)
    assert decision_list.judge_quality(none, labels).count() == 0
    assert decision_list.judge_quality(docs, labels.limit(0)).count() == docs.count()


def test_list_finds_planted_rules(spark):
    rng = np.random.default_rng(4)
    x = rng.random((900, len(decision_list.FEATURES)))
    bad = (x[:, 2] > 0.8) | ((x[:, 4] < 0.2) & (x[:, 5] > 0.5))
    rules = decision_list.learn_list(x, bad)
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= decision_list._covers(x, [(decision_list.FEATURES.index(f), s, t) for f, s, t in rule])
    assert (hit == bad).mean() > 0.97
    assert decision_list.learn_list(x, np.zeros(len(x), bool)) == []


# nearest neighbours


def test_nearest_match_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 12)).round(1)
    x[300:900] = x[299]
    x[900:950] *= 2
    rows = [(i, [float(v) for v in x[i]], "r") for i in range(len(x))]
    rows += [rows[50], (5000, None, "r"), (5001, [0.0] * 12, "r"), (5002, [float("nan")] * 12, "r"), (5003, [1.0, None] + [0.0] * 10, "r"), (5004, [1.0], "r"), (None, rows[0][1], "r")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    single = x.astype(np.float32).astype(np.float64)
    got = {}
    for r in hilbert_ann.nearest(df, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, len(x), 50))
    for q, found in got.items():
        score = hilbert_ann.cosines(single[q], single)
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:5]
        assert [found[k + 1][0] for k in range(5)] == order, q
        assert np.allclose([found[k + 1][1] for k in range(5)], score[order], rtol=0, atol=1e-12)
    small = hilbert_ann.nearest(df.where("vec_id in (50, 51, 52)"), F.col("vec_id") == 50).collect()
    assert sorted((r.query_id, r.rank) for r in small) == [(50, 1), (50, 2)]
    assert hilbert_ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_hilbert_curve_steps_to_neighbours():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = hilbert_ann.hilbert_index(points, 3)
    assert sorted(index) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(1) == 1).all()


# byte-level BPE


def test_bpe_equals_tiktoken(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = byte_bpe.tokenize(docs.withColumn("ids", F.lit("clash")), path, public_tokenizers.PATTERN).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = encoding.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.tokenize(none, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_runs_of_long_texts(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(byte_bpe, "RUN_TOKENS", 100)
    monkeypatch.setattr(byte_bpe, "KNOWN_TOKENS", 50)
    bpe = byte_bpe.ByteBpe(byte_bpe.build_model(ranks), public_tokenizers.PATTERN)
    texts = [t or "" for t in TEXTS]
    ids, ends = bpe.encode(texts)
    start = 0
    for text, end in zip(texts, ends, strict=True):
        assert ids[start:end].tolist() == encoding.encode_ordinary(text)
        start = end


# URLs


def test_urls(spark):
    rules = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"))
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/porn": ("", "", None, "block"),
        "http://A.Example.COM/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "http://xexample.com/en/": ("xexample.com", "/en/", "com/", "allow"),
        "http://x.com?porn": ("x.com", "", None, "block"), "http://x.org/Adult/bet": ("x.org", "/Adult/bet", None, "block"), "http://x.org/adult/adult": ("x.org", "/adult/adult", None, "allow"),
        "http://x.org/adults/sussex/alphabet": ("x.org", "/adults/sussex/alphabet", None, "allow"), "http://porn.x.com/": ("porn.x.com", "/", "com/", "allow"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(cases)] * 2
    got = url_vocabulary.judge_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string"), rules).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url], r.url


# pages


def test_pages(spark):
    notice = "we use cookies to make this site work better for all of you"
    page = lambda body: f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>menu</a></nav>{body}<footer>f</footer></body></html>"
    cases = [
        (page("<article><h1>T &amp; U</h1><p>a<b>b</b>  c<br>d<div class='x comments'><article>no</article></div><p>e</article>tail"), "T & U\n\nab c d\n\ne"),
        (page(f"<div>{notice}</div><p>first unique words of a page without any article</p>"), "first unique words of a page without any article"),
        (page(f"<div>{notice}</div><p>second unique text</p>"), "second unique text"),
        (page(f"<main><p>{notice}</p><form>q</form><script>var x='</p>';</script></main>"), notice), (None, ""), ("", ""), ("<p>cut &am", "cut &am"), ("<div cla", ""),
        ("<p>" + LONG + "</p>", LONG),
    ]
    rows = [(i, "http://h.org/" + str(i), html, "clash") for i, (html, _) in enumerate(cases)] + [(100, None, cases[0][0], "clash"), (3, "http://h.org/3", cases[3][0], "clash")]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = cases[r.page_id % 100][1]
        assert (r.text, r.n_chars) == (want, len(want)), r.page_id
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_blocks_of_any_length_go(spark):
    lengths = [n for n in range(6, 16) for _ in range(12)]
    shared = [" ".join(f"s{k}x{i}" for i in range(n)) for k, n in enumerate(lengths)]
    own = lambda page, k: " ".join(f"p{page}b{k}w{i}" for i in range(8))
    body = lambda page: "".join(f"<p>{own(page, k)}</p><div>{text}</div>" for k, text in enumerate(shared))
    rows = [(page, f"http://h.org/{page}", f"<html><body>{body(page)}</body></html>") for page in (1, 2)]
    for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == "\n\n".join(own(r.page_id, k) for k in range(len(shared)))
        assert r.n_repeated == sum(lengths)


def test_copied_pages_keep_their_article(spark):
    article = " ".join(f"word{i}" for i in range(40))
    notice = "we use cookies to make this site work better for all of you"
    body = f"<body><div>{notice}</div><p>{article}</p></body>"
    rows = [(1, "http://h.org/a", body), (2, "http://h.org/a?utm=1", body), (3, "http://h.org/print/a", body.replace("<p>", "<nav>print</nav>\n<p class='x'>"))]
    rows += [(4, "http://h.org/b", f"<body><div>{notice}</div><p>another text</p></body>"), (5, None, f"<p>{article}</p>"), (6, None, f"<p>{article}</p>")]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: article, 2: article, 3: article, 4: "another text", 5: article, 6: article}


def test_names_that_hold_the_article():
    real = "the real text"
    for html in (
        f"<body class='right-sidebar'><p>{real}</p></body>", f"<div class='content-sidebar-wrap'><p>{real}</p></div>", f"<main id='search'><p>{real}</p></main>",
        f"<article class='post comments-open tag-social'><p>{real}</p></article>", f"<article class='post comments'><p>{real}</p></article>",
        f"<body class='nav'><p>{real}</p><div class='x sidebar'>no</div><div id='cookie-banner'>no</div><aside>no</aside></body>",
    ):
        assert html_extract.candidates(html_extract.parse(html))[0] == real, html
    related = html_extract.parse(f"<main><p>{real}</p><article>related post</article></main>")
    assert html_extract.candidates(related)[0] == real + "\n\nrelated post"


# toxicity


def brute_marginals(odds, t):
    forward, backward = [np.array([1.0, odds[0]])], [np.ones(2)]
    for o in odds[1:]:
        a = forward[-1] @ t * np.array([1.0, o])
        forward.append(a / a.sum())
    for o in odds[:0:-1]:
        b = t @ (np.array([1.0, o]) * backward[-1])
        backward.append(b / b.sum())
    both = np.array(forward) * np.array(backward[::-1])
    return both[:, 1] / both.sum(1)


def test_marginals_match_brute_force(monkeypatch):
    rng = np.random.default_rng(8)
    t = np.exp(np.array([[1.5, -1.5], [-1.5, 1.5]]))
    lengths = np.array([0, 1, 2, 700, 5000, 0, 3, 2048, 2049])
    odds = np.exp(rng.normal(-2, 3, lengths.sum()))
    starts = lengths.cumsum() - lengths
    got = toxicity.chain_marginals(odds, starts, lengths, t)
    for s, n in zip(starts, lengths, strict=True):
        if n:
            assert np.allclose(got[s:s + n], brute_marginals(odds[s:s + n], t), atol=1e-10)


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(9)
    clean = [f"w{i}" for i in range(300)]
    make = lambda bad: " ".join(np.insert(rng.choice(clean, 60), 7, ["vile", "slur"] if bad else ["nice", "word"]))
    y = [i % 2 for i in range(300)]
    model = toxicity.fit([make(b) for b in y], y)
    tests = [make(i % 2) for i in range(40)]
    found, p, _ = toxicity.score(model, pa.array(tests))
    assert ((found >= 0.3) == np.array([i % 2 for i in range(40)])).all()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(tests)], "doc_id long, text string, score int")
    for r in toxicity.score_toxicity(df, model).collect():
        assert [r.text[s.start:s.end] for s in r.toxic_spans] == (["vile slur"] if r.doc_id % 2 else [])
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score < 0.3 and r.predicted == 0 for r in got)
    assert toxicity.score_toxicity(none, model).count() == 0 and toxicity.fit_sample(none, none.select("doc_id", F.lit(1).alias("toxic")), F.lit(True)) is None
    assert {r.score for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}


def test_toxic_words_in_runs_without_spaces(spark):
    rng = np.random.default_rng(9)
    clean = [f"w{i}" for i in range(300)] + ["plain", "garden", "river", "winter", "table", "paper", "日本語の文章です"]
    make = lambda bad: " ".join(np.insert(rng.choice(clean, 60), 7, ["vile", "slur"] if bad else ["nice", "word"]))
    y = [i % 2 for i in range(300)]
    model = toxicity.fit([make(b) for b in y], y)
    run = "gardenriverplaintablepaperwinter"
    texts = [f"{run}VILE{run}", f"{run}nice{run}", f"{run * 40}slur{run * 40}", "日本語の文章ですvile日本語の文章です", "日本語の文章です" * 9, "x" * 100_000, f"some {run}{run} words"]
    found, _, words = toxicity.score(model, pa.array(texts))
    assert list(found >= 0.3) == [True, False, True, True, False, False, False]
    assert list(words.lengths) == [68, 64 + 4, 80 * 32 + 4, 20, 72, 100_000, 66]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score_toxicity(df, model).collect():
        assert abs(r.score - found[r.doc_id]) < 1e-9
        hits = [r.text[s.start:s.end].lower() for s in r.toxic_spans]
        assert len(hits) == int(found[r.doc_id] >= 0.3) and all("vile" in h or "slur" in h for h in hits)
    one, other = "a" * 20 + "b" + "a" * 20, "a" * 20 + "c" + "a" * 20
    a, b = (toxicity.read_words(pa.array([w])) for w in (one, other))
    assert set(map(tuple, a.features)) != set(map(tuple, b.features))
    assert [len(c) for c in toxicity.candidates("é日a".encode())] == [2, 2, 1]


def test_toxicity_query_ignores_held_out_labels(spark, tmp_path):
    """Flipped labels of the fold that is held out leave every score as it is; odd rows do not stop the query."""
    rng = np.random.default_rng(3)
    clean = [f"w{i}" for i in range(200)]
    texts = [" ".join([*rng.choice(clean, 40), *(["vile", "slur"] if i % 3 == 0 else [])]) for i in range(240)] + [None, "", "one"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5) for i, t in enumerate(texts)] + [(None, "vile slur", None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    got = []
    for flip in (False, True):
        folder = tmp_path / str(flip)
        docs.write.parquet(str(folder / "documents.parquet"))
        labels = [(i, int((i % 3 == 0) != (flip and held(i))), 1) for i in range(240)]
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(folder / "labels.parquet"))
        rows = QUERIES["op10_toxicity"](spark, str(folder)).collect()
        assert len(rows) == len(texts) + 1 and all(r.held_out == held(r.doc_id) for r in rows if r.doc_id is not None)
        got.append({r.doc_id: (r.score, r.predicted) for r in rows})
    assert got[0] == got[1] and all(got[0][i][1] == int(i % 3 == 0) for i in range(240))


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The driver gets the finished model alone; the sample and the arrays of the fit stay out of its memory."""
    rng = np.random.default_rng(5)
    clean = [f"w{i}" for i in range(200)]
    texts = [" ".join([*rng.choice(clean, 40), *(["vile", "slur"] if i % 3 == 0 else [])]) for i in range(120)]
    toxic = [int(i % 3 == 0) for i in range(120)]
    want, fit, driver = toxicity.fit(texts, toxic), toxicity.fit, os.getpid()

    def not_here(*args):
        assert os.getpid() != driver, "fitted in the driver"
        return fit(*args)

    monkeypatch.setattr(toxicity, "fit", not_here)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    got = toxicity.fit_sample(docs, labels, F.lit(True))
    assert (got.weights == want.weights).all() and got.bias == want.bias
    assert (got.transition == want.transition).all() and (got.document == want.document).all()
