"""Corpus cleaning pipeline: documents in, tokenised clean documents out.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
the columns of ``docs``; the last one adds the token columns. A stage's result is written
to the shared folder and read again, so a lost executor costs one stage at most.

Defined results: NULL and empty texts pass all stages (no toxic clause, no shingle, no window,
no entity, no piece); rows that repeat are copies and one stays, unless their id is NULL; tied
copies keep the smallest id; an empty table stays empty; further columns pass through, whatever
their names, except the three that the last stage adds; texts are read whole, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import decontaminate, near_dup, pii, sentencepiece_codec, toxicity
from meterlake.llm.common import table, unused
from meterlake.llm.registry import PII_KEY, piece_model
from meterlake.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, fitted on the labels, scores below one half."""
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    score = unused(docs, "score")
    return toxicity.score_documents(docs, model, result=score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return near_dup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` follows the new text."""
    out = pii.replace_entities(docs, PII_KEY)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(
        docs.schema["n_chars"].dataType)))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the pieces and of the decoded text; they replace columns of these names."""
    pieces = unused(docs, "pieces")
    found = sentencepiece_codec.encode_documents(docs, piece_model(), "text", pieces, decoded=True)
    digests = found.select(*sentencepiece_codec.digest_columns(pieces)).columns
    kept = [c for c in docs.columns if c.lower() not in digests]
    return found.select(*kept, *sentencepiece_codec.digest_columns(pieces))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", replace_pii),
    ("sentencepiece", encode_pieces),
]

#: Learned scores, signatures and keyed surrogates are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
