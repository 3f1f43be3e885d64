"""Registered corpus queries: thin adapters from the driver tables to the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterlake.llm import alignment, ann, collocations, decontaminate, katz_lm, language_id, licenses, near_dup, packing, pii, \
    secrets, sentencepiece_codec, toxicity
from meterlake.llm.common import table

#: Key of the surrogates in the registered queries; a deployment passes its own secret.
PII_KEY = "meterlake"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


def piece_model() -> str:
    """The public 32k piece model; its library is installed on every worker."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def byte_model() -> str:
    """The public byte-level vocabulary of 50k entries, installed like the piece model."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_ann")
def op1(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query("op2_decontaminate")
def op2(spark, sf_dir):
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_language_id")
def op3(spark, sf_dir):
    return language_id.language_report(table(spark, sf_dir, "documents"))


@query("op4_near_dup")
def op4(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


@query("op5_sentencepiece")
def op5(spark, sf_dir):
    return sentencepiece_codec.token_digests(table(spark, sf_dir, "documents"), piece_model())


@query("op6_license_scan", licenses.oracle())
def op6(spark, sf_dir):
    return licenses.license_report(table(spark, sf_dir, "documents"))


@query("op7_katz_lm")
def op7(spark, sf_dir):
    return katz_lm.language_model_report(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_secret_scan", secrets.oracle())
def op9(spark, sf_dir):
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


@query("op10_pii")
def op10(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"), PII_KEY)


@query("op11_phrase_collocations")
def op11(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_token_alignment")
def op12(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), byte_model(), piece_model())


@query("op13_best_fit_packing")
def op13(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), byte_model())


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
