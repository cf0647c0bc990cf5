"""The registered queries of this subpackage, and the SQL that some of them agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import (
    decision_list, interaction, langid, merge_replay, packing, passages, piece_count, repeats, resample, simhash,
    stable_hash, vafile, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("op1_language")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


@query("op2_substring_dedup", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS seq
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50)),
low AS (SELECT seq, min(doc_id) AS first_doc FROM starts GROUP BY seq),
cut AS (SELECT s.doc_id, s.p FROM starts s JOIN low USING (seq) WHERE low.first_doc < s.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM cut),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""")
def op2(spark, sf_dir):
    kept = repeats.remove_repeats(texts(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op3_token_count")
def op3(spark, sf_dir):
    counted = piece_count.count_tokens(texts(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op5_byte_bpe")
def op5(spark, sf_dir):
    coded = merge_replay.encode_decode(
        texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_packing")
def op7(spark, sf_dir):
    return packing.pack(texts(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_simhash")
def op9(spark, sf_dir):
    found = simhash.near_copies(texts(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op6(spark, sf_dir):
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op8_vector_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN low ON vec_id = low.a
""")
def op8(spark, sf_dir):
    return stable_hash.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op4_quality")
def op4(spark, sf_dir):
    return resample.Sampler(texts(spark, sf_dir), table(spark, sf_dir, "labels")).weights


@query("op10_toxicity")
def op10(spark, sf_dir):
    flagged = passages.flag(texts(spark, sf_dir), table(spark, sf_dir, "labels"))
    return flagged.select("doc_id", (~passages.learnable(F.col("doc_id"))).alias("held_out"), "score", "predicted")


@query("op11_filter_audit", r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic
  FROM labels GROUP BY doc_id),
f AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN m USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT v.x || w.x || x.x || y.x || z.x AS o FROM l v, l w, l x, l y, l z
  WHERE len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5),
r AS (
  SELECT f.*, o, least(if(a, instr(o, 'A'), 9), if(b, instr(o, 'B'), 9), if(c, instr(o, 'C'), 9),
                       if(d, instr(o, 'D'), 9), if(e, instr(o, 'E'), 9)) AS gone FROM f, o),
s AS (
  SELECT part, o, k, substr(o, k, 1) AS x,
         count(*) FILTER (gone > k) AS kept, count(*) FILTER (gone = k) AS removed,
         count(*) FILTER (gone < k AND CASE substr(o, k, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END)
           AS redundant,
         count(*) FILTER (a::INTEGER + b::INTEGER + c::INTEGER + d::INTEGER + e::INTEGER = 1
           AND CASE substr(o, k, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS unique_fails,
         coalesce(sum(good) FILTER (gone = k), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone = k), 0) AS toxic_lost
  FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS k) GROUP BY part, o, k)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, kept, removed, redundant, unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM s
""")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return interaction.audit_texts(docs, table(spark, sf_dir, "labels"))


@query("op12_quality_rules")
def op12(spark, sf_dir):
    judged, _ = decision_list.judge(texts(spark, sf_dir), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "rule")


@query("op13_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
