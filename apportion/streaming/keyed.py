"""Queues of a stream with keyed state: one value per worker, expired by event-time timers."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from apportion.session import scratch_dir
from apportion.streaming.runner import run_to_table

# Processors travel whole, so that the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUT = "kind string, seq bigint, start_us bigint, finish_us bigint, samples bigint"


class FifoWorker(StatefulProcessor):
    """A worker that takes its samples in ``seq`` order.

    Its state is the time at which it becomes free, the last sample it took and how many it has
    taken. A timer is set to that time: once event time has passed it, whatever still arrives finds the worker idle
    however long it worked before, so the worker reports that it is idle and its state is removed.
    """

    def __init__(self, lanes: Sequence[str]):
        self._lanes = list(lanes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("worker", "free_at bigint, last bigint, samples bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values("seq", kind="stable")
        if table.empty:
            return
        free_at, last, samples = self._state.get() if self._state.exists() else (None, None, 0)
        seq = table["seq"].to_numpy()
        if last is not None and seq[0] <= last:
            raise ValueError(f"sample {seq[0]} arrives after sample {last}")
        service = table["service_us"].to_numpy()
        before = np.cumsum(service) - service
        idle = table["arrival_us"].to_numpy() - before
        if free_at is not None:
            idle[0] = max(idle[0], free_at)
        start = before + np.maximum.accumulate(idle)
        finish = start + service
        # Where a start lies after the finish before it, the worker had run out of work.
        ended = np.append(start[0] if free_at is None else free_at, finish[:-1])
        gaps = np.flatnonzero(start > ended)
        taken = np.diff(np.append(-samples, gaps))
        self._state.update((int(finish[-1]), int(seq[-1]), int(len(seq) - gaps[-1]) if len(gaps) else samples + len(seq)))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        # Timers count milliseconds; the one after the last microsecond is safe.
        self._handle.registerTimer(int(finish[-1]) // 1000 + 1)
        yield self._rows(key, "sample", seq, start, finish, 1)
        if len(gaps):
            before_gap = np.append(-1 if last is None else last, seq[:-1])[gaps]
            yield self._rows(key, "idle", before_gap, ended[gaps], ended[gaps], taken)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        free_at, last, samples = self._state.get()
        self._state.clear()
        yield self._rows(key, "idle", [last], [free_at], [free_at], [samples])

    def _rows(self, key, kind, seq, start, finish, samples) -> pd.DataFrame:
        lanes = dict(zip(self._lanes, key, strict=True))
        return pd.DataFrame({**lanes, "kind": kind, "seq": seq, "start_us": start, "finish_us": finish, "samples": samples})

    def close(self) -> None:
        pass


def worker_events(routed: DataFrame, lanes: Sequence[str], delay: str) -> DataFrame:
    """What the workers of a routed stream do: a ``sample`` row each with start and finish, and ``idle`` rows.

    ``routed`` has the lanes, seq, arrival, arrival_us and service_us. Micro-batches follow
    one another in the order of ``seq``; a worker refuses a sample from before its last one. ``delay``
    bounds how far arrivals go back along that order; later ones are dropped, as by any watermark, and so
    are arrivals before 1970.
    An idle row says after which sample and when a worker ran out of work, and how many samples it took since it
    last had been idle. It comes with the worker's next sample, or before that once event time has passed
    the moment; so it does not depend on the micro-batches. The state is one row per busy worker.
    """
    types = dict(routed.dtypes)
    schema = ", ".join(f"{lane} {types[lane]}" for lane in lanes) + f", {OUT}"
    rows = routed.select(*lanes, "seq", "arrival", "arrival_us", "service_us").withWatermark("arrival", delay)
    return rows.groupBy(*lanes).transformWithStateInPandas(
        statefulProcessor=FifoWorker(lanes), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def keyed_backlog(routed: DataFrame, lanes: Sequence[str], delay: str, base: str | None = None) -> DataFrame:
    """Run :func:`worker_events` over everything available, exactly once, and read all events so far.

    Called again on the same ``base`` folder it goes on where the last run stopped: the state is
    in the checkpoint.
    """
    spark = routed.sparkSession
    base = base or scratch_dir(spark, "workers")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return run_to_table(worker_events(routed, lanes, delay), "workers", f"{base}/checkpoint", f"{base}/rows")
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)

