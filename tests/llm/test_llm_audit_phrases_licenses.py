"""Filter audit, phrase mining and license scan against brute force on small tables with odd rows."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import filter_audit, license_scan, phrase_mining

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 613} x{i}" for i in range(15_000)) + " apache license, version 2 " + "the end " * 50
TEXTS = [
    None, "", " \n\t", "one", "LOUD TEXT", "a # b", "a # b", "plain words " * 40, "plain words " * 40, " ".join(f"w{i}" for i in range(60)), LONG, LONG,
    "Released under the MIT License. UNDER THE MIT LICENSE", "é à 日本語 \U0001f600 cc-by-nc", "\x00 \x01", "x" * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "s0", "", "s1"][i % 4], [None, "en", "de"][i % 3], "x", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6], (None, TEXTS[5], "s0", "en", None, None), (None, "only without id", "s1", None, None, None), (-3, TEXTS[9], None, "en", "y", 2), (99, "only without id", "s1", "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, labels string, n_words int")


# filter audit


def audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    owner = {}
    for d, t, *_ in rows:
        if d is not None:
            owner[t or ""] = min(owner.get(t or "", d), d)
    masks = []
    for d, t, s, *_ in rows:
        text = t or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": text in owner and d != owner[text],
        }
        masks.append((s or "", {k for k, f in fails.items() if f}, d in good and d is not None, d in toxic and d is not None))
    out, shapley = {}, Counter()
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[1]]
                left = [m for m in left if letter not in m[1]]
                failing = sum(letter in m[1] for m in own)
                shapley[part, letter] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), failing - len(gone), sum(m[1] == {letter} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone))
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_is_the_replayed_orders(spark, docs):
    labels = [(0, 1, 0), (6, 1, 1), (6, 0, 1), (8, None, 1), (11, 1, None), (99, 0, 1), (None, 1, 1), (12345, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit_filters(docs, marks).collect()}
    assert got == audit([tuple(r) for r in docs.collect()], labels)


def test_audit_of_nothing(spark, docs):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs.limit(0), marks).count() == 0
    assert {r.good_lost for r in filter_audit.audit_filters(docs, marks).select("good_lost").distinct().collect()} == {0}


# phrases


def phrases(rows, least, longest, top):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = {}
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        rows = []
        for p, a in found.items():
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = lambda q: len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if not any(100 * n >= 80 * a for q, n in found.items() if inside(q)):
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out[lang, rank] = (p.decode(), -a, left, right, total[lang], -s)
    return out


def mined(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_are_the_counted_ones(spark, docs, seed):
    rng = np.random.default_rng(seed)
    stock = ["a", "B", "the", "of", "é", "日本", "c-d", "e#", "\x1c", "X"]
    rows = [(" ".join(rng.choice(stock, 30, p=[.3, .2, .1, .1, .1, .05, .05, .04, .03, .03])) + str(rng.choice([".", ", of the", "\n\nof the", " ! a a a a", ""])), str(rng.choice(["en", "de"]))) for _ in range(60)]
    rows += [("of the world x y z", None)] * 9 + [(None, "en"), ("", None), ("one", "fr"), ("  \t", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit(1)).repartition(5)
    for least, top in ((5, 2000), (2, 7)):
        assert mined(phrase_mining.mine_phrases(df, least=least, top=top)) == phrases(rows, least, 4, top)
    odd = [(r.text, r.lang) for r in docs.collect()]
    assert mined(phrase_mining.mine_phrases(docs, least=3)) == phrases(odd, 3, 4, 2000)
    assert phrase_mining.mine_phrases(docs.limit(0)).count() == 0


def test_spilled_subtrees_and_burst_containers_add_up(spark):
    rng = np.random.default_rng(3)
    rows = [(" ".join(f"t{x}" for x in rng.zipf(1.4, 400) % 300), "en") for _ in range(20)]
    df = spark.createDataFrame(rows, "text string, lang string").select("lang", "text").coalesce(1)
    want = Counter()
    for text, _ in rows:
        words = text.split()
        want.update(" ".join(words[i:i + 3]) for i in range(len(words) - 2))
    got = phrase_mining.count_phrases(df, 3, np.full(1 << (phrase_mining.FILTER_BITS - 3), 255, np.uint8), trie_entries=500, burst=4)
    assert {r.phrase: r.n for r in got.groupBy("phrase").agg(F.sum("n").alias("n")).collect()} == want
    trie, bits = phrase_mining.HatTrie(3, burst=3), phrase_mining.WORD_BITS
    ids = [(1, i, j) for i in range(9) for j in range(9) for _ in range(i + j + 1)] + [(2, 0, 5)]
    for part in (ids[::2], ids[1::2]):
        trie.add(np.array([i[0] for i in part]), np.array([i[1] << bits | i[2] for i in part]))
    assert type(trie.root[1]) is phrase_mining.Node and type(trie.root[2]) is Counter and trie.entries == 82
    unpacked = lambda run: {(f, r >> bits, r & ((1 << bits) - 1)): n for f, r, n in zip(*(x.tolist() for x in run), strict=True)}
    whole = Counter(ids)
    assert unpacked(trie.spill(1)) == {i: n for i, n in whole.items() if i[0] == 1} and unpacked(trie.spill(0)) == {(2, 0, 5): 1} and not trie.root


def test_ids_start_anew_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "VOCABULARY", 40)
    monkeypatch.setattr(phrase_mining, "CHUNK_WORDS", 16)
    rows = [(" ".join(f"t{i * i % 101}" for i in range(n)), "en") for n in (500, 3, 900)]
    docs = spark.createDataFrame(rows, "text string, lang string").select("lang", "text").coalesce(1)
    for length in (1, 2, 4):
        want = Counter()
        for text, _ in rows:
            words = text.split()
            want.update(" ".join(words[i:i + length]) for i in range(len(words) - length + 1))
        full = None if length == 1 else np.full(1 << (phrase_mining.FILTER_BITS - 3), 255, np.uint8)
        got = phrase_mining.count_phrases(docs, length, full).where("phrase <> ''").groupBy("phrase").agg(F.sum("n").alias("n")).collect()
        assert {r.phrase: r.n for r in got} == want


def test_filter_keeps_every_frequent_phrase(spark):
    frequent = spark.createDataFrame([("en", f"w{i} v{i}") for i in range(500)], "lang string, phrase string")
    single = frequent.select("lang", F.explode(F.split("phrase", " ")).alias("phrase"))
    bits = phrase_mining.frequent_filter(frequent) | phrase_mining.frequent_filter(single)
    assert 0 < int(np.unpackbits(bits).sum()) <= 1500
    words = phrase_mining.Words("en", bits)
    ids = words.encode(" A ".join(f"w{i} v{i} w{i}" for i in range(0, 1000, 7)).encode().split())
    known = len(range(0, 500, 7))
    assert len(phrase_mining.phrase_starts(ids, words, 2)) == 2 * known  # only the words count so far
    assert len(phrase_mining.phrase_starts(ids, words, 3)) == 0  # v w is not frequent
    assert len(phrase_mining.phrase_starts(words.encode([]), words, 2)) == 0


def test_top_rows_of_ties(spark):
    rows = [("en", f"p{i:05d}", i % 3, 7) for i in range(6000)] + [("de", f"q{i}", 1, 1) for i in range(5)]
    got = phrase_mining.top_phrases(spark.createDataFrame(rows, "lang string, phrase string, score long, a long").withColumns({"l": F.lit(1), "r": F.lit(1)}), top=50, salts=8).collect()
    want = sorted((-s, -a, p) for lang, p, s, a in rows if lang == "en")[:50]
    assert [r.phrase for r in sorted(got, key=lambda r: r["rank"]) if r.lang == "en"] == [p for _, _, p in want]
    assert sum(r.lang == "de" for r in got) == 5


# licenses


def scan(text, stride=license_scan.STRIDE):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    templates = [(label, t.split()) for label, t in (*license_scan.BASE_PHRASES, *license_scan.NOTICES)]
    length = stride + max(len(t) for _, t in templates) - 1
    labels, best = set(), 0.0
    for start in range(0, len(words), stride):
        block = set(words[start:start + length])
        for label, t in templates:
            share = len(block & set(t)) / len(set(t))
            if share >= license_scan.CONTAINMENT:
                labels.add(label)
                best = max(best, share)
    places = [(i, label) for label, t in templates[:3] for i in range(len(words)) if words[i:i + len(t)] == t]
    at = [i for i, _ in places]
    base = {label for _, label in places}
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), best)


def test_licenses_are_the_counted_blocks_and_places(spark, docs):
    rng = np.random.default_rng(5)
    notices = [t for _, t in (*license_scan.BASE_PHRASES, *license_scan.NOTICES)]
    texts = [r.text for r in docs.collect()]
    for _ in range(120):
        words = [f"f{x}" for x in rng.integers(0, 50, rng.integers(0, 200))]
        for _ in range(rng.integers(0, 4)):
            own = notices[rng.integers(len(notices))].split()
            if rng.random() < 0.5:
                own = [w for w in own if rng.random() < 0.9]
            if rng.random() < 0.3:
                rng.shuffle(own)
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = own
        texts.append(str(rng.choice([" ", " - ", "\n"])).join(w.upper() if rng.random() < 0.3 else w for w in words))
    texts += ["under the mit license " * 30, "cc by nc cc by nc", "under the Kit license MIİ", "under the mit licenses"]
    rows = [(i, t, "clash", 1.5) for i, t in enumerate(texts)] + [(0, texts[-1], "again", None), (None, texts[-4], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")
    got = license_scan.scan_licenses(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == scan(r.text), r.text
    none = license_scan.scan_licenses(df.limit(0))
    assert none.count() == 0 and set(none.columns) >= {"doc_id", "n_base", "labels"}
