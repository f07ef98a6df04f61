"""Corpus preparation in five stages, each over all that the stage before kept.

1. toxicity: rows whose calibrated score reaches the threshold go; clean rows stay.
2. line dedup: later copies of repeated passages are cut; rows left without text go.
3. near-dedup: of each group of near copies the row of least id stays.
4. PII: every span of personal data is replaced by its kind in brackets.
5. packing: the pieces of all documents, with their token ids.

Stages 1 to 4 return the columns of their input (n_chars follows the text). Null texts and
null ids pass stages 1 to 4; repeated rows are one document and stay together; an empty
table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import line_dedup, near_dup, packing, pii, toxicity
from tarn.llm.common import dropped, fresh_names, scratch_dir, stored, table, temporary


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.not_toxic(docs, scorer)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (count,) = fresh_names(docs, "n_lines_cut")
    cut = line_dedup.dedup_lines(docs, count_col=count)
    left = cut.filter((F.col(count) == 0) | (F.trim("text") != ""))
    return _measured(left.drop(count))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = stored(near_dup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct())
    if gone.count() <= near_dup.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(pii.redact(docs))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_passages),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_tokens),
]

#: Learned scores, hashed fingerprints and token ids are beyond SQL; tests hold the stages against plain statements of their rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.
    What a stage stored for itself goes with it, its result when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_dir(spark)}/corpus-{uuid.uuid4().hex}"
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
        dropped(spark, before)
        before = [f"{base}/{name}"]
    return STAGES[-1][1](spark, docs, sf_dir)
