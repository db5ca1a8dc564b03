"""One query for each operator of this subpackage, over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.byte_bpe import tokenize
from tracemill.llm.chat_format import format_chats, loss_text, read_chats
from tracemill.llm.common import id_remainder, table
from tracemill.llm.decision_list import judge_quality
from tracemill.llm.filter_audit import audit_filters
from tracemill.llm.hilbert_ann import nearest
from tracemill.llm.html_extract import extract_main_text
from tracemill.llm.language_id import fit_sample as fit_languages
from tracemill.llm.language_id import identify
from tracemill.llm.license_scan import BASE_PHRASES, CONTAINMENT, NOTICES, STRIDE, scan_licenses
from tracemill.llm.mixing import mix_sources
from tracemill.llm.phrase_mining import mine_phrases
from tracemill.llm.simhash_dedup import near_duplicates
from tracemill.llm.toxicity import fit_sample as fit_toxicity
from tracemill.llm.toxicity import score_toxicity
from tracemill.llm.url_vocabulary import SOFT_TERMS, STRICT_TERMS, judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PROBE_TURN = r"\### Assistant: </turn> ok"
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE_TURN), (-7, 1, "assistant", PROBE_TURN)], "conv_id long, turn long, role string, text string")
    chats = format_chats(rows.unionByName(probe)).withColumn("turns", read_chats("formatted")).withColumn("loss", loss_text("pieces"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op1_chat_format"] = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, length(replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2')) + 7
    + CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role THEN 0
      ELSE 6 + length(replace(replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), ':', '\3'), chr(10), '\4')) END AS written
  FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(written) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op2_mix_sources"] = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sizes AS (
  SELECT source, sum(size) AS source_size, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight
  FROM docs GROUP BY source),
room AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER below, 0.0) AS room,
    sum(weight) OVER () - coalesce(sum(weight) OVER below, 0.0) AS open
  FROM sizes WINDOW below AS (ORDER BY source_size * 2.0::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
    least(cap, coalesce(max(CASE WHEN room / open <= cap / weight THEN room / open END) OVER () * weight, cap)) AS target FROM room),
passes AS (
  SELECT d.*, t.source_size, t.target, pass, (CAST(sum(d.size) OVER (PARTITION BY d.source, pass ORDER BY key, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT)
    + pass * t.source_size) / t.target AS finish
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) AS p(pass) WHERE t.target > 0),
ahead AS (
  SELECT doc_id, source, size, pass, sum(size) OVER (ORDER BY finish, encode(source) NULLS LAST, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS ahead FROM passes),
taken AS (
  SELECT doc_id, source, size, count(*) AS copies FROM ahead WHERE ahead <= (SELECT sum(target) FROM targets) GROUP BY ALL)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(d.size * coalesce(k.copies, 0) AS BIGINT) AS taken
FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.source IS NOT DISTINCT FROM k.source AND d.size = k.size
"""


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op9_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def _rule_sql(column: str) -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r[1]) - len(r[2]))
    value = {"rule": lambda r: r[1] + r[2], "verdict": lambda r: r[0]}[column]
    return "CASE " + " ".join(
        f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{value(r)}'" for r in rules) + " END"


def _hits_sql(terms: tuple[str, ...]) -> str:
    return " + ".join(rf"CAST(regexp_matches(lowered, '\b{t}\b') AS BIGINT)" for t in terms)


ORACLES["op9_url_vocabulary"] = rf"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hits AS (SELECT *, {_rule_sql("rule")} AS rule, {_rule_sql("verdict")} AS action, {_hits_sql(STRICT_TERMS)} AS strict_hits, {_hits_sql(SOFT_TERMS)} AS soft_hits FROM parts)
SELECT page_id, host, path, rule, strict_hits, soft_hits,
  coalesce(action, CASE WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END) AS verdict FROM hits
"""


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder("doc_id", 3) == 1
    found = identify(docs.select("doc_id", "text"), fit_languages(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder("doc_id", 4) == 2
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out)
    scored = score_toxicity(docs, model).withColumn("held_out", held_out)
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("toxic_spans").alias("n_spans"))


@query
def op7_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(embeddings, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


@query
def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


ORACLES["op11_filter_audit"] = r"""
WITH words_ AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS first_id FROM words_ GROUP BY text),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(w.text) - length(regexp_replace(w.text, '[A-Z]', '', 'g'))) > 5 * length(w.text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > first_id OR (w.doc_id IS NULL AND first_id IS NOT NULL) THEN 16 ELSE 0 END AS mask
  FROM words_ w JOIN firsts f ON w.text = f.text LEFT JOIN marks m ON w.doc_id = m.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
done AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (WHERE mask & (before | own) = 0) AS kept, sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS removed,
    sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0) AS redundant, sum(n) FILTER (WHERE mask = own) AS unique_fails,
    sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS good_lost, sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM done
"""


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _template_rows_sql() -> str:
    def row(number: int, label: str, text: str) -> str:
        tokens = sorted(set(text.split(" ")))
        listed = ", ".join(f"'{t}'" for t in tokens)
        return f"({number}, '{label}', '{text}', [{listed}], {ceil(CONTAINMENT * len(tokens) - 1e-9)}, {number < len(BASE_PHRASES)})"

    return ", ".join(row(i, *template) for i, template in enumerate((*BASE_PHRASES, *NOTICES)))


ORACLES["op13_license_scan"] = rf"""
WITH templates AS (SELECT * FROM (VALUES {_template_rows_sql()}) AS t(number, label, phrase, tokens, least, base)),
words_ AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
blocks AS (
  SELECT id, list_distinct(words[b * {STRIDE} + 1:b * {STRIDE} + {STRIDE - 1 + max(len(t[1].split(" ")) for t in (*BASE_PHRASES, *NOTICES))}]) AS tokens
  FROM (SELECT id, words, unnest(range(0, CAST(ceil(len(words) / {STRIDE}.0) AS BIGINT))) AS b FROM words_)),
pairs AS (
  SELECT id, label, len(list_intersect(blocks.tokens, t.tokens)) AS shared, len(t.tokens) AS size, least FROM blocks, templates t WHERE list_has_any(blocks.tokens, t.tokens)),
met AS (SELECT id, label, CAST(shared AS DOUBLE) / size AS score FROM pairs WHERE shared >= least),
places AS (
  SELECT id, i - 1 AS place, label FROM (SELECT id, words, unnest(range(1, len(words) + 1)) AS i FROM words_) w, templates t
  WHERE base AND array_to_string(words[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
by_place AS (
  SELECT id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY id),
by_pair AS (SELECT id, max(score) AS score FROM met GROUP BY id),
named AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT id, label FROM met UNION ALL SELECT id, label FROM places) GROUP BY id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM words_ LEFT JOIN by_place USING (id) LEFT JOIN by_pair USING (id) LEFT JOIN named USING (id)
"""


@query
def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLES["op12_phrase_mining"] = r"""
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered),
words_ AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
lengths AS (SELECT unnest(range(1, 5)) AS length),
starts AS (SELECT lang, words, length, unnest(range(1, len(words) - length + 2)) AS i FROM words_, lengths WHERE len(words) >= length),
counts AS (SELECT lang, length, array_to_string(words[i:i + length - 1], ' ') AS phrase, count(*) AS f FROM starts GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE length = 1 GROUP BY lang),
found AS (SELECT *, string_split(phrase, ' ') AS words FROM counts WHERE f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, CAST((CAST(c.f AS HUGEINT) * 2000000) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, length)) AS k FROM found WHERE length > 1) c
  JOIN found l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:k], ' ') JOIN found r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[k + 1:c.length], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM cuts) p WHERE pick = 1),
inner_ AS (
  SELECT lang, array_to_string(words[i:i + size - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, length - size + 2)) AS i FROM (SELECT *, unnest(range(2, length)) AS size FROM found WHERE length > 2) s) t GROUP BY 1, 2),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM best b LEFT JOIN inner_ i ON b.lang = i.lang AND b.phrase = i.phrase WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE rank <= 2000
"""
