"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, line_dedup, near_dup, ngram_join, packing, phrase_prints, pii, sharding, telephony, token_counts, toxicity, whitening, word_runs
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")))


def op2_shard_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(sharding.shard(table(spark, sf_dir, "documents"), 8))


def op3_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.digests(telephony.store_audio(table(spark, sf_dir, "documents")))


def op5_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digests(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def op6_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_prints.digests(phrase_prints.fingerprint_documents(table(spark, sf_dir, "documents")))


def op7_bpe_speculative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op9_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))


def op10_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    return line_dedup.digests(line_dedup.dedup_lines(docs))


def op11_whiten_feast(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whitening.quantised(table(spark, sf_dir, "embeddings"))
    return whitening.digests(whitening.whiten(vectors, whitening.fit(vectors, components=4)))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digests(word_runs.word_runs(table(spark, sf_dir, "documents"), edit=word_runs.repeat_tail))


def op13_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_texts(table(spark, sf_dir, "documents"), percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pack_binary, op2_shard_hilbert, op3_minhash_bayes, op4_telephony_audio, op5_toxicity_neighbours, op6_phrase_fingerprints, op7_bpe_speculative, op8_token_counts, op9_pii_weak_supervision, op10_line_winnowing, op11_whiten_feast, op12_word_runs, op13_partenum_join)}


def oracle_sql() -> dict[str, str]:
    return {}
