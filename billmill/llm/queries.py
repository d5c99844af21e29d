"""The registered queries of the operators: thin, whole tables, production parameters. And their SQL, where it can be."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, packing, phrases, quotations, rabitq, secrets, simhash, suffixes, topk

RANKS, VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotations.conversations(table(spark, sf_dir, "conversations"))
    linked = F.size(F.filter("links", lambda x: x["turn"].isNotNull())).cast("long")
    return out.select(F.col("conv").alias("conv_id"), "turn", "role", "reply_to", "thread_root", "reply_depth", "n_quotes", linked.alias("n_linked"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), added=packing.added_tokens(public_tokenizers.path(VOCABULARY)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"), short=True)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_entropy")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("mix_copy").cast("long").alias("copy"), F.round("mix_rate", 9).alias("rate"), F.col("mix_key").alias("shuffle_key"), F.md5("text").alias("text_md5"))


def op8_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_duplicates(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quotations, op2_packing, op3_simhash, op4_topk, op5_suffixes, op6_secrets, op7_mixing, op8_phrases, op9_langid, op10_rabitq, pipeline)
}

#: Documents' rates by source, their distributions by the same recurrence, and the draw from an MD5.
OP7 = f"""
WITH RECURSIVE sizes AS (SELECT source, sum(greatest(coalesce(length(text), 0), 1)) AS size FROM documents GROUP BY source),
weighted AS (SELECT source, size::DOUBLE AS size, pow(size::DOUBLE, {mixing.POWER}) AS weight FROM sizes),
total AS (SELECT sum(size) AS all_, sum(weight::DECIMAL(38,12))::DOUBLE AS weights FROM weighted),
rates AS (SELECT source, weight / weights * all_ / size AS rate FROM weighted, total),
steps AS (
  SELECT source, rate, 0 AS k, -rate AS ln_, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, k + 1, ln_ + ln(rate / (k + 1)), cdf + exp(ln_ + ln(rate / (k + 1))) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 20)
),
drawn AS (
  SELECT doc_id, d.source, rate, text,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~') || ':{mixing.SEED}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
),
counted AS (SELECT d.*, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.cdf <= d.u) AS n FROM drawn d)
SELECT doc_id, source, c AS copy, round(rate, 9) AS rate,
  md5(coalesce(doc_id::VARCHAR, '~') || ':' || c || ':{mixing.SEED}:order') AS shuffle_key, md5(text) AS text_md5
FROM counted, LATERAL (SELECT unnest(range(n)) AS c)
"""

OP4 = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {topk.K}
"""

OP8 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + {phrases.WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {phrases.WINDOW - 2})) AS i FROM w)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + {phrases.WINDOW})) AS j FROM win JOIN rep USING (h)),
gone AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM each ANTI JOIN hit USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {rabitq.COSINE}),
reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u)
SELECT u AS vec_id, (SELECT count(*) FROM links l WHERE l.u = r.u)::BIGINT AS n_links, min(w) AS component_id, u = min(w) AS kept FROM reach r GROUP BY u
"""

ORACLES: dict[str, str] = {"op4_topk": OP4, "op7_mixing": OP7, "op8_phrases": OP8, "op10_rabitq": OP10}
