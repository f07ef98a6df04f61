"""Streams against their batch forms: windows, forgetting, events and observers, answers."""

from __future__ import annotations

import datetime as dt
import json
import os
import time
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tarn.config import Debate, Memory, Settings
from tarn.operators import debate, memory
from tarn.sources import scratch
from tarn.streaming import answers, events, sinks
from tarn.streaming import memory as live

DAY = dt.datetime(2024, 1, 1)
TEXTS = [
    "The harbour bridge opened in 1932. It carries trains and cars.", "The bridge was painted grey because grey paint was at hand.", "Ferries cross the harbour every ten minutes.",
    "A tunnel under the harbour opened in 1992. Cars use it at night.", "Bread rises because yeast makes gas. Salt slows yeast.", "Rye bread keeps longer than wheat bread.",
]


@pytest.fixture(scope="module")
def corpus(spark):
    return debate.build(spark.createDataFrame(list(enumerate(TEXTS)), "span_id long, text string"))


def asked(spark):
    return spark.createDataFrame([("a", "when did the harbour bridge open"), ("b", "why does bread rise"), ("c", "tunnel or ferries across the harbour"), ("d", "zzz")], "query_id string, text string")


def test_working_window_restarts(spark, tmp_path):
    """Turns come late, twice and blank, over three goes of one query; the windows are those of the whole table."""
    live.with_state(spark)
    rows = [(s, i, f" turn {s} {i} " if (s + i) % 7 else "  ") for s in range(6) for i in range(5 * s + 1)]
    config, schema = Memory(working_size=4), "session_id long, seq long, text string"
    for go in (2, 0, 1):
        spark.createDataFrame([r for r in rows if r[1] % 3 == go], schema).write.mode("append").parquet(f"{tmp_path}/in")
        windows = live.working_window(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in"), config)
        query = sinks.run_available(windows, sinks.batches_to(f"{tmp_path}/out"), f"{tmp_path}/state")
    got = live.latest(sinks.read_batches(spark, f"{tmp_path}/out", windows.schema)).select("session_id", "slot", "seq", "text")
    want = memory.working(spark.createDataFrame(rows, schema), config)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    state = query.lastProgress["stateOperators"][0]
    assert state["customMetrics"]["rocksdbNumInternalColumnFamilies"] > 0


def test_forgetting_leaves_the_state(spark, tmp_path):
    live.with_state(spark)
    schema = "session_id long, episode_id long, salience double, created timestamp"
    rows = [(i % 3, i, (i % 10) / 10, DAY + dt.timedelta(hours=7 * i)) for i in range(60)]
    held = []
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = live.forgetting(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        sinks.run_available(stream, sinks.batches_to(f"{tmp_path}/out"), f"{tmp_path}/state")
        now = rows[part * 20 + 19][3]
        want = memory.forget(spark.createDataFrame(rows[: part * 20 + 20], schema), F.lit(now)).select("episode_id", "strength")
        state = live.remembered_state(spark, f"{tmp_path}/state")
        got = memory.forget(state, F.lit(now)).select("episode_id", "strength")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5
        held.append((state.count(), want.count()))
    assert held[-1][0] <= held[-1][1] + 2 and held[-1][0] < 30  # what is weak is gone, but for the running hour
    flow = {r.event: r.n for r in sinks.read_batches(spark, f"{tmp_path}/out", stream.schema).groupBy("event").agg(F.sum("n").alias("n")).collect()}
    assert flow["remembered"] - flow["forgotten"] == held[-1][0]
    assert abs(live.lifetime_hours(1.0) - 149.787) < 0.001 and live.lifetime_hours(0.01) == 0


def test_batch_sinks_replace(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,)], "n long")
    write = sinks.batches_to(str(tmp_path / "out"))
    for _ in range(2):
        write(rows, 0)
    write(rows.filter("n = 2"), 1)
    assert sorted(map(tuple, sinks.read_batches(spark, str(tmp_path / "out"), rows.schema).collect())) == [(1, 0), (2, 0), (2, 1)]


@pytest.mark.parametrize("rounds", [1, 3])
def test_events_of_a_debate(spark, corpus, tmp_path, rounds):
    """One retrieval.done and debate.done a query, one debate.round a query and round; a failing handler stops nothing."""
    log = events.EventLog(str(tmp_path / "log"))
    tables = debate.run(corpus, asked(spark), Settings(debate=Debate(max_rounds=rounds)), events=log)
    every = log.read(spark).collect()
    said = Counter((r.query_id, r.round) for r in tables["rounds"].collect())
    assert Counter((r.query_id, json.loads(r.payload)["round"]) for r in every if r.event == "debate.round") == said
    assert sorted(r.query_id for r in every if r.event == "retrieval.done") == sorted(r.query_id for r in every if r.event == "debate.done") == ["a", "b", "c", "d"]
    hits = Counter(r.query_id for r in tables["hits"].collect())
    first = {r.query_id: json.loads(r.payload)["hits"] for r in every if r.event == "retrieval.done"}
    assert all(0 < first[q] <= hits[q] for q in "abc")
    by = defaultdict(list)
    for r in sorted(every, key=lambda r: r.seq):
        by[r.query_id].append(r.event)
    assert all(e[0] == "retrieval.done" and e[-1] == "debate.done" and set(e[1:-1]) == {"debate.round"} for e in by.values())
    done = {r.query_id: json.loads(r.payload) for r in every if r.event == "debate.done"}
    assert {q: d["rounds"] for q, d in done.items()} == {r.query_id: r.rounds for r in tables["answers"].collect()}

    def fails(rows, i):
        raise RuntimeError("broken handler")

    handlers = {"debate.round": sinks.batches_to(str(tmp_path / "rounds")), "debate.done": fails, "*": sinks.batches_to(str(tmp_path / "all"))}
    listener = events.Lifecycle()
    spark.streams.addListener(listener)
    for _ in range(2):  # the second run finds nothing new
        events.observe(log.stream(spark, 2), handlers, str(tmp_path / "ledger"), str(tmp_path / "state"))
    for _ in range(100):  # the listener is called from another thread
        if any(e[0] == "ended" for e in listener.seen):
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert spark.read.parquet(str(tmp_path / "rounds")).count() == sum(said.values()) and spark.read.parquet(str(tmp_path / "all")).count() == len(every)
    fared = Counter((r.name, r.ok) for r in events.read_ledger(spark, str(tmp_path / "ledger")).collect())
    assert set(fared) == {("debate.round", True), ("debate.done", False), ("*", True)} and len(set(fared.values())) == 1
    assert {"started", "ended"} <= {r.event for r in listener.rows(spark).collect()}
    again = events.observers(handlers, str(tmp_path / "ledger"))
    again(log.read(spark).filter("false"), 0)  # batch 0 is done: nothing is written anew
    assert spark.read.parquet(str(tmp_path / "all")).count() == len(every)


def test_answers_as_a_stream(spark, corpus, tmp_path):
    """Each query's messages, in order, are those of the batch; queries that come later are answered by a restart."""
    queries = asked(spark)
    want = {}
    for r in answers.messages(debate.run(corpus, queries)).collect():
        want.setdefault(r.query_id, []).append((r.seq, r.kind, r.payload))
    schema = "query_id string, text string"
    for part in ("query_id < 'c'", "query_id >= 'c'"):
        queries.filter(part).unionByName(queries.filter(part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        answers.answer_stream(corpus, spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault(r.query_id, []).append((r.seq, r.kind, r.payload))
    assert {q: sorted(m) for q, m in got.items()} == {q: sorted(m) for q, m in want.items()} and len(got) == 4
    for m in want.values():
        kinds = [k for _, k, _ in sorted(m)]
        n = kinds.count("evidence")
        assert kinds[:n] == ["evidence"] * n and kinds[-2:] == ["answer", "done"] and set(kinds[n:-2]) == {"round"}
        assert [s for s, _, _ in sorted(m)] == list(range(len(m)))


def test_tables_of_a_block_go(spark):
    """Tables stored in a block are removed with it, also after a failure; others stay, and so do those of other threads."""
    rows = spark.range(3)
    kept = scratch.stored(rows)
    with ThreadPoolExecutor(1) as pool, pytest.raises(RuntimeError), scratch.temporary(spark):
        gone, other = scratch.stored(rows), pool.submit(scratch.stored, rows).result()
        assert gone.count() == 3
        raise RuntimeError
    assert kept.count() == other.count() == 3
    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in gone.inputFiles())
