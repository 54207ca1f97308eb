"""One query per operator, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import byte_bpe, chat_format, filter_audit, fingerprints, html_extract, lm_score, merkle, packing, quality_rules, simhash, substring_dedup, toxicity, url_filter
from parley.llm.store import bound_batches


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(read(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat_format.digests(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_lm_score": op2_lm_score,
    "op3_url_filter": op3_url_filter,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_fingerprints": op8_fingerprints,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_simhash": op10_simhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_chat_format": op12_chat_format,
    "op13_merkle_manifest": op13_merkle_manifest,
}
#: Of the others SQL lacks the learned models, the hash functions or the tokenizer.
ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
g AS (SELECT doc_id, i, word, count(*) OVER f AS n, md5(string_agg(word, ' ') OVER f) AS h FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT doc_id, i, word, CASE WHEN n = 35 AND count(*) FILTER (n = 35) OVER (PARTITION BY h) > 1 THEN 1 ELSE 0 END AS again FROM g),
c AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT doc_id, count(*) AS n, sum(gone) AS k, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS t FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN s ON d.doc_id = s.doc_id""",
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
 CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
 || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
 || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS failed
 FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
 WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
m AS (SELECT c.*, filter_order, step, own, contains(failed, own) AS fails, len(list_intersect(string_split(failed, ''), string_split(before, ''))) > 0 AND before <> '' AND failed <> '' AS earlier FROM c, s),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS removed, coalesce(sum(n) FILTER (fails AND earlier), 0) AS redundant,
 coalesce(sum(n) FILTER (failed = own), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0) AS toxic_lost
 FROM m GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
    "op12_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length('### : </turn>') + 1 AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS k),
d AS (SELECT doc_id, lang, coalesce(xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(k[1 + (xor(c, b) & 255)], c >> 8))) % 7 = 0, false) AS hit,
 coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
 n_chars AS n, coalesce(strlen(text) || ':' || text, '-') AS z FROM documents, k),
h AS (SELECT doc_id, lang, sha256(a || coalesce(strlen(CAST(n AS VARCHAR)) || ':' || n, '-') || z) AS leaf,
 sha256(a || coalesce(strlen(CAST(n + hit::BIGINT AS VARCHAR)) || ':' || (n + hit::BIGINT), '-') || z) AS tampered FROM d),
p AS (SELECT *, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM h),
t(g, lvl, idx, h, size) AS (SELECT g, 0, pos, leaf, size FROM p
 UNION ALL SELECT g, lvl + 1, idx // 2, sha256(h || coalesce(nx, '')), (size + 1) // 2 FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY idx) AS nx FROM t) WHERE size > 1 AND idx % 2 = 0),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS size FROM t WHERE size = 1),
u(lvl, idx, h, size) AS (SELECT 0, pos, subroot, size FROM s
 UNION ALL SELECT lvl + 1, idx // 2, sha256(h || coalesce(nx, '')), (size + 1) // 2 FROM (SELECT *, lead(h) OVER (ORDER BY idx) AS nx FROM u) WHERE size > 1 AND idx % 2 = 0),
f(g, doc_id, leaf, pos, lvl, ix, h, proof) AS (SELECT g, doc_id, leaf, pos, 0, pos, tampered, '' FROM p
 UNION ALL SELECT f.g, doc_id, leaf, pos, f.lvl + 1, ix // 2, sha256(CASE WHEN b.h IS NULL THEN f.h WHEN ix % 2 = 1 THEN b.h || f.h ELSE f.h || b.h END), proof || coalesce(b.h, '')
 FROM f JOIN t a ON a.g = f.g AND a.lvl = f.lvl AND a.idx = ix AND a.size > 1 LEFT JOIN t b ON b.g = f.g AND b.lvl = f.lvl AND b.idx = xor(ix, 1)),
m AS (SELECT f.* FROM f JOIN t ON t.g = f.g AND t.lvl = f.lvl AND t.size = 1),
v(doc_id, leaf, subroot, lvl, ix, h, proof) AS (SELECT doc_id, leaf, subroot, 0, s.pos, h, proof FROM m JOIN s ON m.g = s.g
 UNION ALL SELECT doc_id, leaf, subroot, v.lvl + 1, ix // 2, sha256(CASE WHEN b.h IS NULL THEN v.h WHEN ix % 2 = 1 THEN b.h || v.h ELSE v.h || b.h END), proof || coalesce(b.h, '')
 FROM v JOIN u a ON a.lvl = v.lvl AND a.idx = ix AND a.size > 1 LEFT JOIN u b ON b.lvl = v.lvl AND b.idx = xor(ix, 1))
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, v.h AS folded_root, v.h = r.h AS verified FROM v JOIN u r ON r.size = 1 AND r.lvl = v.lvl""",
}
