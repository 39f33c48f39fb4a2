"""Streams give what their batch twins give; stores keep what is put in."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hazmill.sources import store
from hazmill.streaming import updates as U

T0 = datetime(2024, 1, 1)
SCHEMA = "client_key long, request_id long, ts timestamp"


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_rate_limit(spark, tmp_path):
    rows = [(k, 100 * k + i, T0 + timedelta(minutes=i)) for k in (1, 2) for i in range(8)] + [(1, 199, T0 + timedelta(hours=2))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = U.rate_limit(spark.read.parquet(str(tmp_path / "in")), cap=5)
    got = {r["request_id"]: (r["n"], r["allowed"]) for r in batch.collect()}
    assert got[104] == (5, True) and got[105] == (6, False) and got[199] == (1, True)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    assert {tuple(r) for r in run(spark, U.rate_limit_stream(stream, cap=5), "limits", "append").collect()} == {tuple(r) for r in batch.collect()}


def test_stage_progress_stream(spark, tmp_path):
    rows = [(1, "document_router", "started", T0, 0), (1, "complete", "completed", T0 + timedelta(seconds=9), 1), (2, "risk_scorer", "started", T0, 2)]
    schema = "analysis_id long, stage string, status string, ts timestamp, seq long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = U.stage_progress(spark.read.parquet(str(tmp_path / "in")))
    stream = U.stage_progress(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    assert {tuple(r) for r in run(spark, stream, "progress", "complete").collect()} == {tuple(r) for r in batch.collect()}
    assert {(r["analysis_id"], r["is_over"]) for r in batch.collect()} == {(1, True), (2, False)}


def test_result_cache(spark, tmp_path):
    rows = [("h", 1, T0, False), ("h", 2, T0 + timedelta(minutes=1), True), ("h", 3, T0 + timedelta(minutes=30), True), ("h", 4, T0 + timedelta(minutes=62), True)]
    schema = "content_sha256 string, request_id long, ts timestamp, ok boolean"
    got = U.result_cache(spark.createDataFrame(rows, schema)).orderBy("request_id").collect()
    assert [(r["analysis_id"], r["hit"]) for r in got] == [(1, False), (2, False), (2, True), (4, False)]
    for i in range(2):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    cached = run(spark, U.result_cache_stream(stream.withWatermark("ts", "10 minutes")), "cached", "append")
    assert {tuple(r) for r in cached.collect()} == {tuple(r) for r in got}


def test_store(spark, tmp_path):
    path = str(tmp_path / "reports")
    store.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"), path, "id")
    for _ in range(2):
        store.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string"), path, "id")
    assert {tuple(r) for r in store.read_stored(spark, path, "id").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    # what a crash left is not read and is in nobody's way
    spark.createDataFrame([(9, "lost")], "id long, x string").write.parquet(f"{path}/v=4")
    for i in range(store.COMPACT_AFTER):
        store.upsert(spark.createDataFrame([(2, f"e{i}")], "id long, x string"), path, "id")
    assert len(store.versions(spark, path)) < store.COMPACT_AFTER
    assert {tuple(r) for r in store.read_stored(spark, path, "id").collect()} == {(1, "a"), (2, f"e{store.COMPACT_AFTER - 1}"), (3, "d")}
    assert store.load_index(spark, str(tmp_path / "none"), "incidents").count() == 0
    chunks = spark.createDataFrame([("k", "incidents", "t", "s", "", [1.0])], store.INDEX_SCHEMA)
    store.write_index(chunks, str(tmp_path / "index"))
    store.write_index(chunks.withColumn("collection", F.lit("rules")), str(tmp_path / "index"))
    assert store.load_index(spark, str(tmp_path / "index"), "incidents").count() == 1
    for broken in ([("k", "incidents", None, "s", "", [1.0])], [("k", "incidents", "t", "s", "", [1.0])] * 2, [("k", "incidents", "t", "s", "", [1.0]), ("l", "incidents", "t", "s", "", [1.0, 2.0])]):
        store.write_index(spark.createDataFrame(broken, store.INDEX_SCHEMA), str(tmp_path / "index"))
        assert store.load_index(spark, str(tmp_path / "index"), "incidents").count() == 0
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "b_1.txt").write_text("lock-\nout")
    assert [tuple(r) for r in store.read_text_corpus(spark, str(tmp_path / "txt"), "c").collect()] == [("b_1", "b_1.txt", "c", "lockout")]


def test_graph_store(spark, tmp_path):
    assert [x.count() for x in store.load_graph(spark, str(tmp_path / "none"))] == [0, 0]
    nodes = spark.createDataFrame([("a", "A", "HAZARD", None, None)], "node_id string, label string, node_type string, industry string, severity string")
    edges = spark.createDataFrame([("a", "b", "leads_to", 0)], "src string, dst string, relation string, edge_seq int")
    for _ in range(2):
        store.save_graph(nodes, edges, str(tmp_path / "g"))
    got = store.load_graph(spark, str(tmp_path / "g"))
    assert [tuple(r) for x in got for r in x.collect()] == [("a", "A", "HAZARD", None, None), ("a", "b", "leads_to", 0)]


def test_whole_run_of_updates(spark):
    """A run as the stages report it: each starts and completes, the priority way ends it, the last stage is the end."""
    seq, rows = 0, []
    for stage in [*U.STAGES[:-1], U.ALSO_LAST]:
        for status in ("started", "completed"):
            rows.append((1, stage, status, T0 + timedelta(seconds=seq), seq))
            seq += 1
    rows += [(1, "complete", "completed", T0 + timedelta(seconds=seq), seq), (1, "document_router", "started", T0 + timedelta(seconds=seq + 1), seq + 1)]
    rows += [(2, "document_router", "completed", T0, 0), (2, "incident_parser", "error", T0, 1), (2, "error_handler", "error", T0, 2)]
    up = spark.createDataFrame(rows, "analysis_id long, stage string, status string, ts timestamp, seq long")
    got = {r["analysis_id"]: (r["n_done"], r["is_over"]) for r in U.stage_progress(up).collect()}
    assert got == {1: (7, True), 2: (1, False)}
    states = {(r["analysis_id"], r["stage"]): r["state"] for r in U.stage_states(up).collect()}
    assert all(states[1, s] == ("active" if s == "document_router" else "complete") for s in U.STAGES)
    assert [states[2, s] for s in U.STAGES] == ["complete", "error"] + ["idle"] * 5
    asked = spark.createDataFrame([(1,), (2,), (3,)], "analysis_id long")
    again = sorted((r["analysis_id"], r["place"], r["stage"]) for r in U.replay(up, asked).collect())
    assert [x for x in again if x[0] == 1][-1] == (1, 14, "complete") and len([x for x in again if x[0] == 2]) == 3 and again[-1] == (3, 0, "error")


def test_silence_stream(spark, tmp_path):
    schema = "analysis_id long, stage string, status string, ts timestamp"
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [[(1, "risk_scorer", "started", T0), (2, "complete", "completed", T0)], [(3, "document_router", "started", at(90))], [(3, "incident_parser", "started", at(91))], [(3, "incident_parser", "completed", at(3600))], [(3, "complete", "completed", at(3601))]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = [tuple(r) for r in run(spark, U.silence_stream(stream.withWatermark("ts", "10 seconds")), "silent", "append").collect()]
    mine = [x[1:] for x in got if x[0] == 1]
    assert ("heartbeat", "alive", "risk_scorer", 3) in mine and mine[-1] == ("error", "error", "risk_scorer", 12)
    assert not [x for x in got if x[0] == 2]
