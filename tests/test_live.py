"""Live replay: history, then live updates, to each subscriber; equal to the batch replay, and forgotten afterwards."""

from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from hazmill.streaming import live
from hazmill.streaming import updates as U

T0 = datetime(2024, 1, 1)
UP, ASK = "analysis_id long, stage string, status string, ts timestamp, seq long", "analysis_id long, subscriber string, ts timestamp"
at = lambda s: T0 + timedelta(seconds=s)


@pytest.fixture()
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def served(spark, folder, steps, name, **options):
    """What subscribers get when each step's updates and subscriptions arrive in a micro-batch of their own, and the state's rows after each."""
    up, ask = str(folder / "up"), str(folder / "ask")
    start = lambda df: df.writeStream.format("memory").queryName(name).outputMode("append").start()
    for p, s in ((up, UP), (ask, ASK)):
        spark.createDataFrame([], s).write.parquet(p)
    query = start(live.live_replay(spark.readStream.schema(UP).parquet(up), spark.readStream.schema(ASK).parquet(ask), **options))
    held = []
    for told, asked in steps:
        for p, s, rows in ((up, UP, told), (ask, ASK, asked)):
            if rows:
                spark.createDataFrame(rows, s).coalesce(1).write.mode("append").parquet(p)
        query.processAllAvailable()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    query.stop()
    return [tuple(r) for r in spark.table(name).collect()], held


def test_history_then_live(rocksdb, tmp_path):
    steps = [
        ([(1, "document_router", "started", at(0), 0), (1, "document_router", "completed", at(1), 1)], [(1, "early", at(2)), (9, "lost", at(2))]),
        ([(1, "risk_scorer", "started", at(5), 2), (2, "risk_scorer", "started", at(5), 0)], [(1, "late", at(6)), (1, "early", at(6))]),
        ([(1, "complete", "completed", at(8), 3), (1, "risk_scorer", "started", at(9), 4)], []),
        ([], [(1, "after", at(10))]),
    ]
    got, _ = served(rocksdb, tmp_path, steps, "live")
    by = defaultdict(list)
    for a, s, place, stage, status in got:
        by[a, s].append((a, stage, status, place))
    up = rocksdb.createDataFrame([r for told, _ in steps for r in told], UP)
    asked = rocksdb.createDataFrame([(1,), (9,)], "analysis_id long")
    want = defaultdict(list)
    for r in U.replay(up, asked).orderBy("place").collect():
        want[r["analysis_id"]].append(tuple(r))
    assert len(want[1]) == 4
    assert by == {(1, "early"): want[1], (1, "late"): want[1], (1, "after"): want[1], (9, "lost"): want[9]}


def test_timeout_and_expiry(rocksdb, tmp_path):
    tick = lambda s: ([(7, "document_router", "started", at(s), s)], [])
    steps = [
        ([(1, "document_router", "started", at(0), 0), (2, "complete", "completed", at(0), 0)], [(1, "x", at(0))]),
        tick(200),
        tick(201),
        ([(1, "risk_scorer", "started", at(202), 1)], [(2, "y", at(202))]),
        tick(900),
        ([], [(2, "z", at(901))]),
    ]
    got, held = served(rocksdb, tmp_path, steps, "expiry", timeout_s=60, ttl_s=300)
    rows = sorted(got)
    assert [r[2:] for r in rows if r[:2] == (1, "x")] == [(0, "document_router", "started"), (1, "error", "error")]
    assert [r[2:] for r in rows if r[:2] == (2, "y")] == [(0, "complete", "completed")]
    assert [r[2:] for r in rows if r[:2] == (2, "z")] == [(0, "error", "error")]


def test_state_goes_with_the_last_analysis(rocksdb, tmp_path):
    many = [(k, "complete", "completed", at(0), 0) for k in range(1, 40)]
    _, held = served(rocksdb, tmp_path, [(many, []), ([(99, "complete", "completed", at(500), 0)], []), ([], [(100, "q", at(501))])], "gone", ttl_s=100)
    assert held[0] >= 39 and held[-1] < held[0] / 5
