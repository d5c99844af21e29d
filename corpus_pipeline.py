"""From raw documents to packed training sequences: five operators, each on what the one before has kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billmill.llm import langid, minhash, mixing, packing, secrets, simhash
from billmill.llm.common import components, cut, discard, free, shared_folder

#: SQL can't express the fingerprints, the classifier and the tokenizer; the tests compare the rows with brute force.
ORACLE_SQL = None
#: What a language's one-versus-rest score has to exceed: 0 is its decision boundary (targets are 1 and -1). Of held-out
#: rows of a language that the model hasn't learned, 76 to 97 % are rejected at it (see the README).
CLAIM = 0.0
RANKS, VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; it learns from the labelled ones that aren't held out.

    Rejected are null texts, texts without a letter, and texts that no language claims; texts too short to judge stay.
    Where no row is labelled, nothing is known and nothing stays. Repeated rows and rows that share an id are judged
    one by one; an empty table gives no rows; all columns stay as they are.
    """
    pred = free(docs, "pipeline_lang")
    named = langid.identify(docs, langid.train(docs), pred_col=pred, score_col=free(docs, "pipeline_score"), claim=CLAIM)
    return named.where(F.col(pred) != langid.UNKNOWN).select([f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, the one with the least doc_id (null last; of one id, the least hash of the row).

    Groups are what op3's fingerprints link, and what five-word shingles do at 0.8 or more. A row is known by a hash of
    all its columns, 128 bits: an id can have several texts or be null, and rows equal in all columns are one. Null and
    empty texts, and those without a word, are copies of each other; an empty table gives no rows; all columns stay.
    """
    number = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), *(c for name in docs.columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))))), 16, "0")
    row = free(docs, "pipeline_row")
    keyed = docs.withColumn(row, F.unhex(F.concat(number(1), number(2))))
    prints = simhash.near_duplicates(keyed, id_col=row).select(F.col(row).alias("u"), F.col("component_id").alias("v"))
    group = components(prints.unionByName(minhash.links(keyed, row))).withColumnRenamed("node", row)
    found = keyed.groupBy(row, "doc_id").agg(F.count("*").alias("n")).join(group, row, "left").withColumn("component", F.coalesce("component", row))
    first = cut(found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row, "n")).alias("first")).select(f"first.{row}", "first.n"))
    kept = keyed.join(first, row, "left_semi")
    if not (repeated := first.where("n > 1")).isEmpty():
        kept = keyed.join(first.where("n = 1"), row, "left_semi").unionByName(keyed.join(repeated, row, "left_semi").dropDuplicates([row]))
    return kept.select([f"`{c}`" for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars, if there is such a column, made to fit.

    Null texts stay null, with a null n_chars, and empty ones empty; repeated rows stay repeated; an empty table gives
    no rows; all other columns stay.
    """
    masked = secrets.without_secrets(docs, short=True)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in random order.

    A null source is a source; a null or empty text counts as one character; rows of one id come equally often; an
    empty table gives no rows; all columns stay.
    """
    return mixing.mix(docs).select([f"`{c}`" for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: which part of which document is where. A null or empty text is the end id alone; repeated rows are
    packed one by one; an empty table gives no rows; columns other than doc_id and text are ignored."""
    return packing.pack(docs, public_tokenizers.path(RANKS), added=packing.added_tokens(public_tokenizers.path(VOCABULARY)))


STAGES = [("language", language), ("near duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and deleted when the
    next one is written."""
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if spent:
            discard(spark, spent)
        spent = path
    return docs
