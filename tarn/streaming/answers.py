"""Answers as a stream: queries that arrive meet one stored corpus, batch by batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators import debate
from ..sources.scratch import stored, temporary
from .sinks import run_available


def messages(tables: dict[str, DataFrame]) -> DataFrame:
    """query_id, seq, kind, payload (JSON) from the tables of a debate: for each query its evidence by rank,
    its rounds, its answer, and done with the metrics; seq counts from 0 in this order."""

    def part(rows: DataFrame, order: int, kind: str, ix, *payload) -> DataFrame:
        return rows.select("query_id", F.lit(order).alias("order"), ix.cast("long").alias("ix"), F.lit(kind).alias("kind"), F.to_json(F.struct(*payload)).alias("payload"))

    answers, zero = tables["answers"], F.lit(0)
    parts = [
        part(tables["hits"], 0, "evidence", F.col("rk"), "rk", "span_id", "text"),
        part(tables["rounds"], 1, "round", F.col("round"), "round", "proposal", "converged", "stalled"),
        part(answers, 2, "answer", zero, "answer"),
        part(answers, 3, "done", zero, "converged", "rounds", "stability", "claims_total", "claims_anchored", "faithfulness", "evidence_spans"),
    ]
    seq = F.row_number().over(Window.partitionBy("query_id").orderBy("order", "ix")) - 1
    return reduce(DataFrame.unionByName, parts).withColumn("seq", seq).select("query_id", "seq", "kind", "payload")


def answer_stream(corpus: debate.Corpus, queries: DataFrame, out: str, checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Answer a stream of query_id, text up to its present end. Batch i writes the messages of its queries to
    out/batch=i, sorted within files, and replaces what an earlier try of it left; a query that comes
    twice in a batch is answered once."""

    def answer(rows: DataFrame, i: int) -> None:
        with temporary(rows.sparkSession):  # the tables of a batch's rounds go with it
            asked = stored(rows.select("query_id", "text").dropDuplicates(["query_id"]))
            if not asked.isEmpty():
                said = messages(debate.run(corpus, asked, settings))
                said.repartition("query_id").sortWithinPartitions("query_id", "seq").write.mode("overwrite").parquet(f"{out}/batch={i}")

    return run_available(queries, answer, checkpoint, "append")
