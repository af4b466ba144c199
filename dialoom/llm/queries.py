"""Registered queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialoom.llm import chat, exact_dedup, filter_audit, hard_negatives, html_wrappers, kneser_ney, licenses, mixing, packing, prob_minhash, quality, secret_scan, token_ids

#: a conversation whose texts hold control strings, formatted beside the table's own
CONTROL_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op5_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_report(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.read_all(token_ids.write_shards(table(spark, sf_dir, "documents")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_and_read(given.unionByName(spark.createDataFrame(CONTROL_CONVERSATION, given.schema)))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.train_and_score(table(spark, sf_dir, "documents"))


def queries() -> dict:
    import corpus_pipeline

    own = [op1_mix_sources, op2_quality_rules, op3_secret_scan, op4_exact_dedup, op5_prob_minhash, op6_html_text, op7_license_scan, op8_packing, op9_token_ids, op10_chat_format, op11_hard_negatives, op12_filter_audit, op13_kneser_ney]
    return {**{f.__name__: f for f in own}, "pipeline": corpus_pipeline.run}


# Whole-text counts of operator 2; hosts come from `source`.
OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, hash(ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]) AS h
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ld AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
f AS (SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(coalesce(ld.n, 0) AS BIGINT) AS n_dup_lines, coalesce(ld.n_lines, 0) AS n_lines,
       CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (r) LEFT JOIN ld USING (r)),
b AS (SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2,
       10 * n_symbols > word_chars AS f3, 10 * n_dup_lines > 4 * n_lines AS f4 FROM f),
hr AS (SELECT source, count(*) AS n, count(*) FILTER (f1) AS k1, count(*) FILTER (f2) AS k2, count(*) FILTER (f3) AS k3, count(*) FILTER (f4) AS k4 FROM b GROUP BY source),
lng AS (SELECT source, n, unnest([k1, k2, k3, k4]) AS k, unnest([1, 2, 3, 4]) AS rule FROM hr),
m AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM lng GROUP BY rule),
s AS (SELECT rule, m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 1.0 END AS q FROM m),
bad AS (SELECT source FROM lng JOIN s USING (rule) GROUP BY source HAVING bool_or((k + m * q) / (n + q) > 0.5))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2 OR f3 OR f4) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM b.source) AS kept
FROM b
"""
OP4 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, CAST(count(*) OVER (PARTITION BY s) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY s ORDER BY doc_id) = 1 AS kept, s AS text_sha256
FROM d
"""


OP11 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
       list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""
OP12 = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
       CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
       + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
       + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask),
o1 AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT o1.a || o2.a || o3.a || o4.a || o5.a AS filter_order, [o1.bit, o2.bit, o3.bit, o4.bit, o5.bit] AS bits
      FROM o1, o1 o2, o1 o3, o1 o4, o1 o5 WHERE o1.bit | o2.bit | o3.bit | o4.bit | o5.bit = 31),
st AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit,
       sum(CASE WHEN mask & CAST(before + bit AS INTEGER) = 0 THEN n ELSE 0 END) AS kept,
       sum(CASE WHEN mask & CAST(before AS INTEGER) = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
       sum(CASE WHEN mask & CAST(before AS INTEGER) > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
       sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
       sum(CASE WHEN mask & CAST(before AS INTEGER) = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
       sum(CASE WHEN mask & CAST(before AS INTEGER) = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, st GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op4_exact_dedup": OP4, "op11_hard_negatives": OP11, "op12_filter_audit": OP12}
