"""The training-data operators as queries over the test tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dieflow.llm import bpe, conversation, decontam, filter_audit, html_main, ngram_lm, quality, secret_scan, sharding, simhash, toxicity, urlfilter, warc
from dieflow.llm.common import table

SHARDS = 40
#: (verdict, host, path)
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; null and empty texts have fingerprint 0, repeated rows stay."""
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base measures, base_failed and kept of every document; null and empty texts have no words and fail."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.quality(table(spark, sf_dir, "documents")).select("doc_id", *(F.col(f"quality.{n}") for n in names))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every document; null texts are empty, repeated rows stay."""
    return bpe.digest_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, checksum, shard and place under the law `bytes`, placed by a slot map that is stored and read back; null texts have no bytes."""
    placed, _ = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it; null and empty texts hold none, repeated rows come out repeatedly."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base score and the automaton's score of every document; null and empty texts are their end alone, repeated rows count repeatedly."""
    return ngram_lm.score(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; null urls and urls without :// have neither host nor path and no rule."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of base spans, and all spans, of every document; null and empty texts have none, repeated rows the same."""
    return secret_scan.digest(secret_scan.secrets(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out, score, predicted and the offending sentences of every document, by a model of the labelled rows that aren't held out; null and empty texts score the leak."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.training_rows(docs, labels))
    scored = toxicity.score(docs, model, sentences=True)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "offending")


def op10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, main text and its length of every page; null and empty pages have an empty text, repeated rows come out repeatedly."""
    return html_main.extract(table(spark, sf_dir, "pages"))


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every step of every filter order, 600 rows a language; null languages are the empty one, null texts empty."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every conversation after damage; null roles and texts are one space, repeated rows are duplicates."""
    return conversation.repair(table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, digest, type and original of every page, written as ARC, converted to WARC and read back; null pages are empty payloads."""
    return warc.archived(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_quality, op3_bpe, op4_sharding, op5_decontamination, op6_backoff_lm, op7_urls, op8_secrets, op9_toxicity, op10_pages, op11_filters, op12_conversations, op13_warc)
}


def _quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in quality.STOP_WORDS.values() for w in ws}))
    passed = " AND ".join(f"coalesce({r.measure}::DOUBLE / nullif({r.per}, 0) BETWEEN {r.low} AND {'1e308' if r.high == float('inf') else r.high}, TRUE)" for r in quality.RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM s)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(8, coalesce(j - i, 8)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM h) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             len(regexp_extract_all(t, '[!?]')) AS n_marks, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(t, '\p{{L}}')) AS n_letters,
             len(list_filter(w, lambda x: strlen(x) < 8 AND lower(x) IN ({stops}))) AS n_stop_words,
             len(list_filter(list_zip(w[2:], w[:-2]), lambda x: x[1] = x[2])) AS n_stutters,
             len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•·]'))) AS n_bullet_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) AS n_ellipsis_lines,
             coalesce(c.n, 0) AS n_repeat_words FROM s LEFT JOIN c ON s.r = c.r),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passed} AS kept FROM f"""


def _urls_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    upper, lower = urlfilter.UPPER, urlfilter.LOWER_LETTERS
    return rf"""
WITH r(v, h, p) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT s.n, arg_max(r.h || r.p, length(r.h) * 10000 + length(r.p)) AS rule, arg_max(r.v, length(r.h) * 10000 + length(r.p)) AS verdict
      FROM s JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p) GROUP BY s.n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN b ON s.n = b.n"""


_FILTERS_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(least < w.doc_id, FALSE)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM d GROUP BY ALL),
f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum([0] || bits[1:step - 1])::INT AS applied FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, bit,
             sum(n) FILTER (mask & applied = 0 AND mask & bit = 0) AS kept, sum(n) FILTER (mask & applied = 0 AND mask & bit <> 0) AS removed,
             sum(n) FILTER (mask & applied <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
             sum(n) FILTER (mask & applied = 0 AND mask & bit <> 0 AND good = 1) AS good_lost, sum(n) FILTER (mask & applied = 0 AND mask & bit <> 0 AND toxic = 1) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r"""


#: Edits as pieces: up to two rows made up, then a row deleted, kept or given a role.  States: 0 start, 1 system, 2 user, 3 assistant.
_CONVERSATIONS_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([j::BIGINT FOR j IN range(8)], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) AS t(i))),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 [ascii(x)::BIGINT FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS b FROM conversations),
coded AS (SELECT * EXCLUDE (b), xor(list_reduce(b, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS code FROM given, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
         FROM coded, (SELECT unnest([1, 2]) AS copy) WHERE code <> 0 AND (copy = 1 OR code = 3)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
                regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS final FROM ordered),
faulty AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM seen),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
made AS (SELECT * FROM (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)) AS t(state, ins, mid)),
edits AS (SELECT state, ins, mid, 'D' AS op, NULL::VARCHAR AS needs, mid AS goes, 4 AS cost FROM made
          UNION ALL SELECT state, ins, mid, 'R', NULL, CASE mid WHEN 2 THEN 3 ELSE 2 END, 3 FROM made
          UNION ALL SELECT state, ins, mid, 'K', k.needs, k.goes, 0 FROM made JOIN (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS k(st, needs, goes) ON k.st = mid),
walk AS (SELECT conv_id, 0::BIGINT AS pos, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM counts
         UNION ALL
         SELECT w.conv_id, f.pos, e.goes, min({'cost': (w.best.cost + 3 * e.ins + e.cost + CASE WHEN f.fault = 'truncated' AND e.op <> 'D' THEN 3 ELSE 0 END)::BIGINT, 'audit': w.best.audit || repeat('I', e.ins) || e.op})
         FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1 JOIN edits e ON e.state = w.state
         WHERE e.op = 'D' OR coalesce(f.fault, '') NOT IN ('blank', 'duplicate') AND (e.needs IS NULL OR e.needs = f.initial)
         GROUP BY w.conv_id, f.pos, e.goes),
ended AS (SELECT w.conv_id, min({'cost': w.best.cost + 3 * m.ins, 'audit': w.best.audit || repeat('I', m.ins)}) AS best
          FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.pos JOIN made m ON m.state = w.state AND m.mid IN (0, 3) GROUP BY w.conv_id),
letters AS (SELECT conv_id, i, best.audit[i] AS op FROM ended, LATERAL (SELECT unnest(range(1, length(best.audit) + 1)) AS i)),
placed AS (SELECT *, count(*) FILTER (op <> 'I') OVER w AS pos, count(*) FILTER (op <> 'D') OVER w AS line FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
joined AS (SELECT p.*, f.role, f.text, f.initial, max((op = 'K' AND line = 1 AND f.initial = 's')::INT) OVER (PARTITION BY p.conv_id) AS sys
           FROM placed p LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos AND op <> 'I' WHERE op <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (line - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS body FROM joined GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY page_id DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY t) AS best FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN n >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND k > 1 THEN best END AS refers_to FROM r"""


ORACLE_SQL: dict[str, str] = {"op2_quality": _quality_sql(), "op7_urls": _urls_sql(), "op11_filters": _FILTERS_SQL, "op12_conversations": _CONVERSATIONS_SQL, "op13_warc": _WARC_SQL}
