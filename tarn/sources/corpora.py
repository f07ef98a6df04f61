"""Corpus files to texts, documents, and results to JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """file, ix, text: the blocks between blank lines, as they are read, so that large files are
    split over tasks; ix rises along a file; blank blocks go."""
    blocks = spark.read.text(path, lineSep="\n\n").select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ix"), T.strip(F.col("value")).alias("text"))
    return blocks.filter("text <> ''")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """file, text: the text of each element of an array of objects, or the element itself as JSON."""
    rows = spark.read.json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("__file"))
    fields = [c for c in rows.columns if c != "__file"]
    whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in fields)))
    return rows.select(F.col("__file").alias("file"), (F.coalesce(F.col("text").cast("string"), whole) if "text" in fields else whole).alias("text"))


def read_lines(spark: SparkSession, path: str, parsed: bool = False) -> DataFrame:
    """text: the lines that are not blank, as they are; `parsed` takes the text field of JSON lines and drops blank texts."""
    lines = spark.read.text(path).filter(T.filled(F.col("value")))
    return lines.select(F.get_json_object("value", "$.text").alias("text")).filter(T.filled(F.col("text"))) if parsed else lines.select(F.col("value").alias("text"))


def documents(rows: DataFrame) -> DataFrame:
    """Rows with a title: their own, else the source, else untitled; empty texts go."""
    named = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("title", "source") if c in rows.columns]
    return rows.filter(F.coalesce(F.col("text"), F.lit("")) != "").withColumn("title", F.coalesce(*named, F.lit("untitled")))


def as_json(rows: DataFrame, *keep: str) -> DataFrame:
    """One JSON text a row, beside the columns to keep."""
    return rows.select(*keep, F.to_json(F.struct(*rows.columns)).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


#: Fields of the records of a debate, by kind, with the columns that name a row.
RECORDS = {
    "claim": (("query_id", "claim_ix"), ("claim", "verdict", "evidence", "support", "anchored")),
    "hit": (("query_id", "rk"), ("span_id", "score", "fused", "rerank_z", "rerank_raw", "text")),
    "round": (("query_id", "round"), ("proposal", "converged", "stalled")),
    "answer": (("query_id",), ("answer", "converged", "rounds", "faithfulness")),
}


def records(rows: DataFrame, kind: str) -> DataFrame:
    """The columns that name a row, and json: one record a row of that kind, with the fields that the rows have. Fields without a
    value are null in the record, not left out."""
    keys, fields = RECORDS[kind]
    own = [c for c in (*keys, *fields) if c in rows.columns]
    return rows.select(*keys, F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("json"))
