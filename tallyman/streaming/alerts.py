"""Stall alerts: each transfer's clock kept as state, with a timer that ends it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyman.operators.sync import STALL_AFTER_S, STALL_BYTES_PER_S, STALL_TICK_S

#: A worker has no session that could read a DDL string.
CLOCK = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("started", "last_tick", "last_row", "got", "late")]
    + [T.StructField("stalled", T.BooleanType())]
)
ALERT = "at_us long, elapsed_us long, got long, late long, status string"
#: A transfer that is silent for so long, by event time, is over.
IDLE_S = 86_400
#: The state store that timers and typed state need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StallClock(StatefulProcessor):
    """One transfer's clock: ``stalled`` when it falls below the rate, ``ended`` when it falls silent."""

    def __init__(self, tick_us: int, after_us: int, floor: float, idle_us: int):
        self.tick, self.after, self.floor, self.idle = tick_us, after_us, floor, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", CLOCK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.clock.exists()
        started, tick, last, got, late, stalled = self.clock.get() if known else (None, None, None, 0, 0, False)
        # Three numbers a row are kept of a micro-batch, which the source's trigger limit bounds.
        at, seq, sizes = (np.concatenate(c) for c in zip(*((d["at_us"].to_numpy(), d["seq"].to_numpy(), d["bytes"].to_numpy()) for d in rows)))
        order = np.lexsort((seq, at))
        at, sizes = at[order], sizes[order]
        if started is None:
            started = tick = int(at[0])
        timely = at >= tick
        late += int((~timely).sum())
        at, sizes = at[timely], sizes[timely]
        alert = None
        if len(at) and not stalled:
            upto, i = got + np.cumsum(sizes), 0
            while (i := max(i, int(np.searchsorted(at, tick + self.tick)))) < len(at):
                tick, elapsed, moved = int(at[i]), int(at[i]) - started, int(upto[i])
                if elapsed >= self.after and moved * 1_000_000 < self.floor * elapsed:
                    stalled, alert = True, (tick, elapsed, moved)
                    break
                i += 1
            got = int(upto[-1])
        if len(at):
            last = int(at[-1]) if last is None else max(last, int(at[-1]))
        self.clock.update((started, tick, last, got, late, stalled))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.idle) // 1000 + 1)
        if alert:
            yield self._row(key, *alert, late, "stalled")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, _, last, got, late, stalled = self.clock.get()
        self.clock.clear()
        if not stalled:
            yield self._row(key, last, last - started, got, late, "ended")

    @staticmethod
    def _row(key, at: int, elapsed: int, got: int, late: int, status: str) -> pd.DataFrame:
        return pd.DataFrame(
            {"transfer": [key[0]], "at_us": [at], "elapsed_us": [elapsed], "got": [got], "late": [late], "status": [status]}
        )

    def close(self) -> None:
        pass


def stall_alerts(
    progress: DataFrame,
    tick_s: int = STALL_TICK_S,
    after_s: int = STALL_AFTER_S,
    min_bytes_per_s: float = STALL_BYTES_PER_S,
    idle_s: int = IDLE_S,
    lateness: str = "1 hour",
) -> DataFrame:
    """``(transfer, at_us, elapsed_us, got, late, status)`` from a stream ``(transfer, at, seq, bytes)``.

    One ``stalled`` row for each transfer that stalls. One that falls silent for ``idle_s``, by
    the watermark, without a stall gives an ``ended`` row; then nothing of it is kept, and a
    later row begins a new transfer. ``transfer`` may be of any type.

    Rows of one micro-batch are put in order before they are folded. A row older than the
    transfer's last tick comes too late to change it: it is not added, but counted in ``late``.
    Rows older than the watermark, ``lateness`` behind the newest, are dropped by Spark, and
    counted in the query's progress. A transfer's rows of one micro-batch go through one
    task as three numbers each, so set a trigger limit on the source. The session's state store
    is set to RocksDB, without which timers don't work.
    """
    progress.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = progress.withWatermark("at", lateness).select(
        "transfer", "at", F.unix_micros("at").alias("at_us"), F.col("seq").cast("long"), F.col("bytes").cast("long")
    )
    alert = T.StructType([rows.schema["transfer"], *T.StructType.fromDDL(ALERT).fields])
    clock = StallClock(tick_s * 1_000_000, after_s * 1_000_000, min_bytes_per_s, idle_s * 1_000_000)
    return rows.groupBy("transfer").transformWithStateInPandas(
        statefulProcessor=clock, outputStructType=alert, outputMode="append", timeMode="EventTime"
    )
