"""Subscriptions to running analyses: what was said so far, then what is said from now on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hazmill.streaming.updates import SILENCE_S, TERMINAL, TTL_S

OUT = "analysis_id long, subscriber string, place int, stage string, status string"


class _Channel(StatefulProcessor):
    """An analysis: its updates in order of arrival as a list, its open subscriptions with their deadlines, and when it ended.

    A timer stands at each deadline and, once the analysis is over, at the end
    of its time to live. The list is read for new subscribers alone; live
    updates go out without it.
    """

    def __init__(self, timeout_ms: int, ttl_ms: int) -> None:
        self.timeout_ms, self.ttl_ms = timeout_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getListState("said", "stage string, status string")
        self.open = handle.getMapState("open", "subscriber string", "deadline long")
        self.summary = handle.getValueState("summary", "n int, ended long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, ended = self.summary.get() if self.summary.exists() else (0, -1)
        first = n
        past: list[tuple] | None = None
        subscribers = {k[0]: v[0] for k, v in self.open.iterator()} if n else {}
        known, fresh, out = set(subscribers), [], []
        now = timerValues.getCurrentWatermarkInMs()
        for r in pd.concat(list(rows), ignore_index=True).sort_values(["ms", "asks", "seq"], kind="stable").itertuples(index=False):
            if r.asks:
                if not n:
                    out.append((key[0], r.subscriber, 0, "error", "error"))
                    continue
                if r.subscriber in subscribers:
                    continue
                if past is None:
                    past = [tuple(x) for x in self.said.get()] if first else []
                out += [(key[0], r.subscriber, i, *x) for i, x in enumerate(past + fresh)]
                if ended < 0:
                    subscribers[r.subscriber] = max(int(r.ms) + self.timeout_ms, now + 1)
            elif ended < 0:
                fresh.append((r.stage, r.status))
                out += [(key[0], s, n, r.stage, r.status) for s in subscribers]
                n += 1
                if r.stage in TERMINAL:
                    ended, subscribers = max(int(r.ms), now), {}
                    self.handle.registerTimer(ended + self.ttl_ms)
        if fresh:
            self.said.appendList(fresh)
        if n:
            self.summary.update((n, ended))
        for s in known - set(subscribers):
            self.open.removeKey((s,))
        for s in set(subscribers) - known:
            self.open.updateValue((s,), (subscribers[s],))
            self.handle.registerTimer(subscribers[s])
        yield pd.DataFrame(out, columns=["analysis_id", "subscriber", "place", "stage", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        n, ended = self.summary.get() if self.summary.exists() else (0, -1)
        late = [k[0] for k, v in self.open.iterator() if v[0] <= at]
        for s in late:
            self.open.removeKey((s,))
        if ended >= 0 and at >= ended + self.ttl_ms:
            self.said.clear()
            self.open.clear()
            self.summary.clear()
        yield pd.DataFrame([(key[0], s, n, "error", "error") for s in late], columns=["analysis_id", "subscriber", "place", "stage", "status"])

    def close(self) -> None:
        pass


def live_replay(updates: DataFrame, subscriptions: DataFrame, timeout_s: int = SILENCE_S, ttl_s: int = TTL_S, watermark: str = "10 seconds") -> DataFrame:
    """analysis_id, subscriber, place, stage, status: for each of the streamed subscriptions (analysis_id, subscriber, ts) the analysis's
    updates so far in order, then the live ones, until the stage that ends it.

    Within a micro-batch rows go by ts, an update before a subscription of the
    same ts. An analysis nobody has heard of gives one error row at once. A
    subscription open for timeout_s ends with an error row; an ended analysis
    answers for ttl_s more and is then forgotten, so that it is unknown again.
    What comes after the end is left out. A subscriber who asks twice at a time
    is served once. Rows without ts or analysis_id are left out; so are rows
    later than the watermark. The session's state store must be that of RocksDB.
    """
    told = updates.select("analysis_id", "ts", F.lit(False).alias("asks"), F.lit(None).cast("string").alias("subscriber"), "stage", "status", F.col("seq").cast("long").alias("seq"))
    asked = subscriptions.select("analysis_id", "ts", F.lit(True).alias("asks"), F.col("subscriber").cast("string").alias("subscriber"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("seq"))
    rows = told.unionByName(asked).where("ts is not null and analysis_id is not null").withWatermark("ts", watermark).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("analysis_id").transformWithStateInPandas(_Channel(timeout_s * 1000, ttl_s * 1000), OUT, "Append", "EventTime")
