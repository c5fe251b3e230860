"""The registered queries of this subpackage and their SQL twins, where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stallkeeper.llm import (ann, bpe, conversations, embed_dedup, lines, mixing, phrases, pii, sharding, simhash,
                             suffixes, toxicity, wavelet)
from stallkeeper.llm.common import scratch_path, table, tune


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(tune(spark), sf_dir, t) for t in ("documents", "labels"))
    return mixing.mix(docs, labels).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(tune(spark), sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(tune(spark), sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(tune(spark), sf_dir, "embeddings"))


def op5_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(tune(spark), sf_dir, "documents"))


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(tune(spark))
    wavelet.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.read(spark, path)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(tune(spark), sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(tune(spark), sf_dir, t) for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(tune(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(tune(spark), sf_dir, "documents"))


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(tune(spark), sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(tune(spark), sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damaged(table(tune(spark), sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_mixing, op2_simhash, op3_ann, op4_embeddings, op5_kdtree, op6_wavelet, op7_pii, op8_toxicity, op9_bpe,
           op10_lines, op11_suffixes, op12_phrases, op13_conversations, pipeline]
    return {f.__name__: f for f in own}


MIXING_SQL = r"""
WITH best AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
rows AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':7'), 1, 13))::BIGINT::DOUBLE + 0.5)
             / 4503599627370496.0) / CASE b.quality WHEN 1 THEN 4.0 WHEN 0 THEN 1.0 ELSE 2.0 END AS k
  FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id),
sources AS (
  SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source)),
steps AS (
  SELECT *, 2.0 * source_size / weight AS cap_rate, sum(source_size) OVER () AS total,
         coalesce(sum(2 * source_size) OVER w, 0) AS spent, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS free
  FROM sources WINDOW w AS (ORDER BY 2.0 * source_size / weight, source
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (SELECT max((1.5 * total::DOUBLE - spent::DOUBLE) / free::DOUBLE) AS r FROM steps
         WHERE (1.5 * total::DOUBLE - spent::DOUBLE) / free::DOUBLE <= cap_rate),
goals AS (SELECT source, source_size, least(2.0 * source_size, weight * r)::DOUBLE AS target FROM sources, rate),
plan AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM goals),
ordered AS (
  SELECT r.*, p.source_size, p.target, p.epochs,
         (floor(p.target)::BIGINT - p.epochs * p.source_size) AS rest,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY k, r.doc_id, r.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken, source, epochs
FROM ordered
"""

PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
spoken AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
runs AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM spoken, (VALUES (1), (2), (3)) AS lengths(m)),
f AS (SELECT lang, m, phrase, count(*) AS c FROM runs GROUP BY lang, m, phrase),
cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND c >= 10),
cuts AS (
  SELECT x.lang, x.m, x.phrase, x.c AS a, k, l.c AS l, r.c AS r,
         (1000000::HUGEINT * x.c::HUGEINT * x.c::HUGEINT) // (l.c::HUGEINT * r.c::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[1:k], ' ')
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[k + 1:], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, phrase, max(c) AS c FROM (
    SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, c FROM cand WHERE m = 3
    UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), c FROM cand WHERE m = 3) GROUP BY lang, phrase),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, n,
       score::BIGINT AS score
FROM weakest w JOIN totals t ON t.lang = w.lang LEFT JOIN around o ON o.lang = w.lang AND o.phrase = w.phrase
WHERE o.c IS NULL OR 100 * o.c < 50 * a
QUALIFY row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) <= 2000
"""

SUFFIX_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (
  SELECT rid, i, substr(x, 2 * i + 1, 400) AS w
  FROM (SELECT rid, x, unnest(range(0, greatest(0, length(x) // 2 - 199))) AS i FROM texts)),
repeated AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
starts AS (SELECT rid, i FROM windows SEMI JOIN repeated USING (w)),
runs AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER o + 200 THEN 0 ELSE 1 END AS fresh FROM starts
         WINDOW o AS (PARTITION BY rid ORDER BY i)),
numbered AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM runs),
spans AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY rid, run),
cuts AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT c.rid, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head,
                max(b) AS last, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans
         FROM cuts c JOIN texts t ON t.rid = c.rid GROUP BY c.rid)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.rid = t.rid
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": MIXING_SQL, "op11_suffixes": SUFFIX_SQL, "op12_phrases": PHRASES_SQL}
