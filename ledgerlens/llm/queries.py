"""The registered queries of the numbered operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import conversations, decontaminate, hard_negatives, kd_search, near_dups, ngram_lm, pieces, quality, repeats, secret_scan, simhash, token_files, toxicity

BYTE_BPE = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(
        table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), END_ID)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 good but toxic, 2 good; selected are texts likely of grade 1 or more."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))
    model = quality.fit(docs, labels, grade, n_grades=3)
    return quality.grade_texts(docs, model, select_grade=1)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    # by the id alone: rows that share a doc_id are kept together, whatever their texts
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("kept")))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.held_out_scores(table(spark, sf_dir, "documents"), order=3, prune=0)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_files": op4_token_files,
    "op5_top_k": op5_top_k,
    "op6_quality": op6_quality,
    "op7_near_dedup": op7_near_dedup,
    "op8_lm_scores": op8_lm_scores,
    "op9_repeats": op9_repeats,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_simhash": op12_simhash,
    "op13_hard_negatives": op13_hard_negatives,
}

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES: dict[str, str] = {
    "op1_decontamination": rf"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', item_id, text FROM benchmark),
split AS (
  SELECT kind, id, list_filter(list_transform(
    string_split_regex(translate(coalesce(text, ''), {_LETTERS}), '[\x20\x09-\x0D]+'),
    lambda x: trim(x, '.,;:!?"''()[]')), lambda x: x <> '') AS w
  FROM texts),
items AS (
  SELECT id, least(5, len(w)) AS n, unnest(list_distinct(list_transform(
    range(1, len(w) - least(5, len(w)) + 2), lambda i: list_slice(w, i, i + least(5, len(w)) - 1)))) AS s
  FROM split WHERE kind = 'i' AND len(w) > 0),
lengths AS (SELECT DISTINCT n FROM items),
docs AS (
  SELECT id, n, unnest(list_distinct(list_transform(
    range(1, len(w) - n + 2), lambda i: list_slice(w, i, i + n - 1)))) AS s
  FROM split, lengths WHERE kind = 'd'),
sizes AS (SELECT id, count(*) AS n_shingles FROM items GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, CAST(any_value(n_shingles) AS INTEGER) AS n_shingles,
  CAST(count(*) AS INTEGER) AS n_shared, count(*) / any_value(n_shingles) AS containment
FROM docs d JOIN items i ON d.n = i.n AND d.s = i.s JOIN sizes z ON z.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n_shingles)""",
    "op5_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding,
    lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding,
    lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(
    list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scores)
SELECT * FROM ranked WHERE rank <= 10""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_sum(list_transform(
    list_zip(a.v, o.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id AND len(a.v) = len(o.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (
    PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
    # the crc of a key byte by byte, then a walk over the rows with the best repair for each state
    "op11_conversation_repair": r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([CAST(i AS UBIGINT)], CAST(range(8) AS UBIGINT[])),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(
    string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
    lambda x: CAST(ord(x) AS UBIGINT)) AS k
  FROM conversations),
drawn AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS UBIGINT)], k),
    lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)]))) % 20 AS draw
  FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN draw = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM drawn WHERE draw <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
    left(role, 1) AS initial, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS final
  FROM damaged),
marked AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier,
    CASE WHEN final = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    max(pos) AS n
  FROM marked GROUP BY conv_id),
inserts(s, way, word, cost, lines) AS (
  VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []),
    (0, 2, 'I', 3, ['user:']), (1, 2, 'I', 3, ['user:']), (3, 2, 'I', 3, ['user:']),
    (2, 3, 'I', 3, ['assistant:']), (0, 3, 'II', 6, ['user:', 'assistant:']),
    (1, 3, 'II', 6, ['user:', 'assistant:']), (3, 3, 'II', 6, ['user:', 'assistant:'])),
moves(way, initial, letter, t) AS (
  VALUES (0, 's', 'K', 1), (0, 'u', 'K', 2), (1, 'u', 'K', 2), (3, 'u', 'K', 2), (2, 'a', 'K', 3),
    (0, NULL, 'R', 2), (1, NULL, 'R', 2), (2, NULL, 'R', 3), (3, NULL, 'R', 2),
    (0, NULL, 'D', 0), (1, NULL, 'D', 1), (2, NULL, 'D', 2), (3, NULL, 'D', 3)),
walk(conv_id, pos, s, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': []::VARCHAR[]} FROM figures
  UNION ALL
  SELECT w.conv_id, m.pos, v.t, min({
    'cost': w.best.cost + i.cost + CASE v.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
      + CASE WHEN m.fault = 'truncated' AND v.letter <> 'D' THEN 3 ELSE 0 END,
    'audit': w.best.audit || i.word || v.letter,
    'lines': list_concat(w.best.lines, i.lines, CASE v.letter WHEN 'D' THEN []
      WHEN 'K' THEN [m.role || ':' || m.text]
      ELSE [CASE v.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || m.text] END)})
  FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos + 1
    JOIN inserts i ON i.s = w.s
    JOIN moves v ON v.way = i.way AND coalesce(v.initial, m.initial) = m.initial
      AND (v.letter = 'D' OR m.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.conv_id, m.pos, v.t),
ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + i.cost, 'audit': w.best.audit || i.word,
    'lines': list_concat(w.best.lines, i.lines)}) AS best
  FROM walk w JOIN figures f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.pos
    JOIN inserts i ON i.s = w.s AND i.way IN (0, 3)
  GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost,
  coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
  LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
