"""Progress of analyses and limits on uploads, over batches and over streams.

Updates are (analysis_id, stage, status, message, ts, seq). A stage says started,
then completed or error; the stages complete and error end an analysis. Functions without
'stream' in their name take a batch; those built of aggregations alone take a
stream as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazmill.operators import reports as A

# The stages in order, the other name of the last one, what a finished stage says, and the stages that end an analysis.
STAGES = ["document_router", "incident_parser", "entity_extractor", "pattern_detector", "regulatory_auditor", "risk_scorer", "alert_synthesizer"]
ALSO_LAST = "priority_alert_synthesizer"
COMPLETED, FAILED = "completed", "error"
TERMINAL = ["complete", "error"]
HEARTBEAT_S, SILENCE_S, WINDOW_S, CAP, TTL_S = 25, 300, 3600, 10, 3600


def shown_stage(stage: Column) -> Column:
    """Both ways of synthesis are one stage."""
    return F.when(stage == ALSO_LAST, STAGES[-1]).otherwise(stage)


def stage_progress(updates: DataFrame) -> DataFrame:
    """analysis_id, stage, status, n_done, is_over: the latest update and how far the analysis is."""
    last = F.max_by(F.struct("stage", "status"), F.struct("ts", "seq"))
    over = F.max(F.col("stage").isin(*TERMINAL))
    finished = F.col("stage").isin(*STAGES, ALSO_LAST) & (F.col("status") == COMPLETED)
    done = F.size(F.collect_set(F.when(finished, shown_stage(F.col("stage")))))
    out = updates.groupBy("analysis_id").agg(last.alias("x"), done.alias("n_done"), over.alias("is_over"))
    return out.select("analysis_id", "x.stage", "x.status", "n_done", "is_over")


def stage_states(updates: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """analysis_id, place, stage, state: idle, active, complete or error for each of the ordered stages."""
    names = stages or STAGES
    shown = updates.withColumn("stage", shown_stage(F.col("stage")))
    latest = shown.groupBy("analysis_id").pivot("stage", names).agg(F.max_by("status", F.struct("ts", "seq")))
    state = lambda c: F.when(F.col(c).isNull(), "idle").when(F.col(c) == FAILED, "error").when(F.col(c) == COMPLETED, "complete").otherwise("active")
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("stage"), state(s).alias("state")) for i, s in enumerate(names)])
    return latest.select("analysis_id", F.explode(rows).alias("x")).select("analysis_id", "x.place", "x.stage", "x.state")


def replay(updates: DataFrame, asked: DataFrame) -> DataFrame:
    """The updates of the asked analyses in order up to the stage that ends one; an unknown id gets one error row."""
    order = Window.partitionBy("analysis_id").orderBy("ts", "seq")
    ended = F.coalesce(F.max(F.col("stage").isin(*TERMINAL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = asked.select("analysis_id").distinct()
    kept = updates.join(ids, "analysis_id", "left_semi").withColumn("ended", ended).where("ended = 0").withColumn("place", F.row_number().over(order) - 1)
    unknown = ids.join(updates.select("analysis_id").distinct(), "analysis_id", "left_anti")
    lost = unknown.select("analysis_id", F.lit("error").alias("stage"), F.lit("error").alias("status"), F.lit(0).alias("place"))
    return kept.select("analysis_id", "stage", "status", "place").unionByName(lost)


def silence_gaps(updates: DataFrame, heartbeat: int = HEARTBEAT_S, timeout: int = SILENCE_S) -> DataFrame:
    """Each pause of an analysis: gap_s, n_heartbeats sent meanwhile, and whether it ran into the timeout."""
    after = F.lead("ts").over(Window.partitionBy("analysis_id").orderBy("ts", "seq"))
    gap = F.unix_micros("next_ts") - F.unix_micros("ts")
    rows = updates.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("next_ts", after).where("next_ts is not null").withColumn("gap", gap).where(F.col("gap") > heartbeat * 1_000_000)
    late = F.col("gap") > timeout * 1_000_000
    beats = F.floor(F.least("gap", F.lit(timeout * 1_000_000)) / (heartbeat * 1_000_000)).cast("int")
    return rows.select("analysis_id", "seq", (F.col("gap") / 1e6).alias("gap_s"), beats.alias("n_heartbeats"), late.alias("timed_out"))


def ordered_fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, object], tuple], out: str, names: list[str]) -> DataFrame:
    """A fold over each key's rows in order: step(state, row) gives (state, output tuple).

    Rows stream through the task sorted by key; only the state of the key at
    hand is held, whatever its number of rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, None, False
        for pdf in batches:
            made = []
            for r in pdf.itertuples(index=False):
                k = getattr(r, key)
                if not begun or k != now:
                    now, state, begun = k, start(), True
                state, row = step(state, r)
                made.append(row)
            yield pd.DataFrame(made, columns=names)

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, key).sortWithinPartitions(key, *order).mapInPandas(run, out)


def rate_limit(uploads: DataFrame, cap: int = CAP, window_s: int = WINDOW_S) -> DataFrame:
    """client_key, request_id, n, allowed: the n-th request of a window that begins with the key's first request in it."""
    span = timedelta(seconds=window_s)

    def step(state, r):
        begun, n = state
        if begun is None or r.ts >= begun + span:
            begun, n = r.ts, 0
        return (begun, n + 1), (r.client_key, r.request_id, n + 1, n + 1 <= cap)

    rows = uploads.select("client_key", "request_id", "ts")
    return ordered_fold(rows, "client_key", ["ts", "request_id"], lambda: (None, 0), step, "client_key long, request_id long, n int, allowed boolean", ["client_key", "request_id", "n", "allowed"])


def result_cache(uploads: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """request_id, analysis_id, hit: the analysis of a successful run of the same content serves later uploads for the TTL."""
    span = timedelta(seconds=ttl_s)

    def step(state, r):
        at, by = state
        if at is not None and r.ts < at + span:
            return state, (r.request_id, by, True)
        return ((r.ts, r.request_id) if r.ok else (None, None)), (r.request_id, r.request_id, False)

    rows = uploads.select("content_sha256", "request_id", "ts", "ok")
    return ordered_fold(rows, "content_sha256", ["ts", "request_id"], lambda: (None, None), step, "request_id long, analysis_id long, hit boolean", ["request_id", "analysis_id", "hit"])


def rate_limit_stream(uploads: DataFrame, cap: int = CAP, window_s: int = WINDOW_S) -> DataFrame:
    """rate_limit over a stream with a watermark on ts; each key's state is its window's begin and count, and goes once the watermark has passed the window."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    span = pd.Timedelta(seconds=window_s)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begun, n = state.get if state.exists else (None, 0)
        begun = None if begun is None else pd.Timestamp(begun)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "request_id"])
        out = []
        for r in rows.itertuples(index=False):
            if begun is None or r.ts >= begun + span:
                begun, n = r.ts, 0
            n += 1
            out.append((key[0], r.request_id, n, n <= cap))
        state.update((begun.isoformat(), n))
        ends = int(rows["ms"].iloc[-1] + ((begun + span) - rows["ts"].iloc[-1]).total_seconds() * 1000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["client_key", "request_id", "n", "allowed"])

    return uploads.where("ts is not null").withColumn("ms", F.unix_millis("ts")).groupBy("client_key").applyInPandasWithState(run, "client_key long, request_id long, n int, allowed boolean", "begun string, n int", "append", GroupStateTimeout.EventTimeTimeout)


def result_cache_stream(uploads: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """result_cache over a stream with a watermark on ts; a content's state is its last successful run, and goes once the watermark has passed its TTL."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    span = pd.Timedelta(seconds=ttl_s)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, by = state.get if state.exists else (None, None)
        at = None if at is None else pd.Timestamp(at)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "request_id"])
        out = []
        for r in rows.itertuples(index=False):
            hit = at is not None and r.ts < at + span
            out.append((r.request_id, by if hit else r.request_id, hit))
            if not hit:
                at, by = (r.ts, r.request_id) if r.ok else (None, None)
        if at is not None:
            state.update((at.isoformat(), by))
            ends = int(rows["ms"].iloc[-1] + ((at + span) - rows["ts"].iloc[-1]).total_seconds() * 1000)
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["request_id", "analysis_id", "hit"])

    keyed = uploads.where("ts is not null").withColumn("ms", F.unix_millis("ts")).groupBy("content_sha256")
    return keyed.applyInPandasWithState(run, "request_id long, analysis_id long, hit boolean", "at string, by long", "append", GroupStateTimeout.EventTimeTimeout)


def silence_stream(updates: DataFrame, heartbeat_s: int = HEARTBEAT_S, timeout_s: int = SILENCE_S) -> DataFrame:
    """analysis_id, stage, status, last_stage, n_heartbeats of analyses that fall silent before they end; updates carry a watermark on ts.

    A silent analysis says (heartbeat, alive) with the beats due since its last
    update whenever time moves on by a beat, and (error, error) once the timeout
    is over, after which it is forgotten.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = ["analysis_id", "stage", "status", "last_stage", "n_heartbeats"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            stage, ms = state.get
            silent = state.getCurrentWatermarkMs() - ms
            if silent >= timeout_s * 1000:
                state.remove()
                yield pd.DataFrame([(key[0], "error", "error", stage, timeout_s // heartbeat_s)], columns=names)
                return
            beats = int(silent // (heartbeat_s * 1000))
            state.setTimeoutTimestamp(ms + min((beats + 1) * heartbeat_s, timeout_s) * 1000)
            yield pd.DataFrame([(key[0], "heartbeat", "alive", stage, beats)], columns=names)
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values("ts")
        last = rows.iloc[-1]
        if rows["stage"].isin(TERMINAL).any():
            state.remove()
            return
        state.update((str(last["stage"]), int(last["ms"])))
        state.setTimeoutTimestamp(max(int(last["ms"]) + heartbeat_s * 1000, state.getCurrentWatermarkMs() + 1))

    keyed = updates.where("ts is not null").withColumn("ms", F.unix_millis("ts")).groupBy("analysis_id")
    out = "analysis_id long, stage string, status string, last_stage string, n_heartbeats int"
    return keyed.applyInPandasWithState(run, out, "stage string, ms long", "append", GroupStateTimeout.EventTimeTimeout)


def streaming_analyze(reports: DataFrame, history: DataFrame, regulations: DataFrame, path: str, checkpoint: str, keep: Callable[[DataFrame, str, str], None] | None = None):
    """Starts the analysis of a stream of reports: each micro-batch is analysed and stored once, whatever is retried.

    keep puts rows by their key into the table at the path: store.upsert, or keyed.put for a table of buckets.
    """
    from hazmill.sources.store import upsert

    def store(batch: DataFrame, batch_id: int) -> None:
        (keep or upsert)(A.analyze(batch, history, regulations), path, "analysis_id")

    return reports.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
