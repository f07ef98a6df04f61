"""A batch of queries end to end: tools answer what is routed to them, the debate the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..sources.scratch import stored
from . import debate, memory, reason


def ask(corpus: debate.Corpus, queries: DataFrame, now: Column, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """answers: query_id, answer, route, converged, rounds, faithfulness; turns: query_id, text
    to be remembered. A tool's answer counts as converged and faithful, without rounds;
    where it had none, the error is the answer."""
    routed = stored(reason.answer_tools(queries, now))
    by_tool = reason.trace(routed).select(
        "query_id", F.col("observation").alias("answer"), F.col("tool").alias("route"), F.lit(True).alias("converged"), F.lit(0).cast("long").alias("rounds"), F.lit(1.0).alias("faithfulness")
    )
    rest = stored(queries.join(routed.filter("kind = 'rag'").select("query_id"), "query_id", "left_semi"))
    answers = by_tool
    if not rest.isEmpty():
        debated = debate.run(corpus, rest, settings)["answers"]
        answers = answers.unionByName(debated.select("query_id", "answer", F.lit("rag").alias("route"), "converged", F.col("rounds").cast("long").alias("rounds"), "faithfulness"))
    answers = stored(answers)
    turns = queries.join(answers.select("query_id", "answer"), "query_id").select("query_id", F.concat(F.lit("Q: "), F.col("text"), F.lit("\nA: "), F.col("answer")).alias("text"))
    return {"answers": answers, "turns": turns}


def remember(turns: DataFrame, path: str, session: str = "0") -> DataFrame:
    """Append turns (query_id, text) of ask() to the memory under `path` and return all that it holds: session_id,
    seq, text, created, salience. seq goes on from the last turn of the session, in order of query_id."""
    spark, schema = turns.sparkSession, "session_id string, seq long, text string, created timestamp, salience double"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = spark.read.schema(schema).parquet(path) if at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(at) else spark.createDataFrame([], schema)
    last = held.filter(F.col("session_id") == session).agg(F.max("seq")).first()[0]
    seq = F.row_number().over(Window.orderBy("query_id")) + F.lit(-1 if last is None else last)  # one batch of queries
    new = memory.remembered(turns.select("query_id", "text")).select(F.lit(session).alias("session_id"), seq.cast("long").alias("seq"), "text", F.current_timestamp().alias("created"), F.lit(1.0).alias("salience"))
    stored(new).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def health(corpus: debate.Corpus, settings: Settings = Settings(), memories: DataFrame | None = None) -> DataFrame:
    """One row: the state of a corpus and the settings that results depend on; with `memories` (session_id, working, episodic,
    semantic: memory.stats) also the sizes of the memory."""
    state = _state(corpus, settings)
    if memories is None:
        return state
    sizes = [F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_memory") for c in ("working", "episodic", "semantic")]
    return state.crossJoin(memories.agg(*sizes))  # one row each


def _state(corpus: debate.Corpus, settings: Settings) -> DataFrame:
    return corpus.spans.agg(F.count("*").alias("spans")).crossJoin(corpus.n_terms).select(  # one row each
        F.lit("ok").alias("status"), "spans", "terms", F.lit(settings.retrieval.dim).alias("dim"), F.lit(settings.rerank.enabled).alias("rerank"), F.lit(settings.debate.max_rounds).alias("max_rounds")
    )
