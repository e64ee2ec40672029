"""Keyed stream state that hands over a key's rows in time order, once each.

Rows wait in the key's state until the watermark has passed them; an event-time timer then releases all that are ready,
so results do not depend on how rows are cut into micro-batches or in which order they came. A row is late if its time is
at or before what its key has released, or if the watermark had passed it when its micro-batch began; late rows are
dropped. Of rows of one key and time that wait together, the greatest ``revision`` counts.

Processors see columns of one release as numpy arrays; what they carry from one release to the next is a row of state.
A key whose last row is ``idle_ms`` behind the watermark is forgotten, so state is bounded by the keys that are active.
State needs the RocksDB provider (``start`` sets it for the query it starts).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Column that holds a row's event time in milliseconds; what stands for a missing whole number in arrays.
AT, NONE = "at_ms", -(2**63)
_ARRAYS = {"bigint": (np.int64, NONE), "double": (np.float64, np.nan), "boolean": (np.bool_, False)}

Columns = dict[str, np.ndarray]


class InOrder(StatefulProcessor):
    """Subclasses give ``carried`` (DDL of their own state), ``fresh`` (its first value) and ``release``.

    Rows have columns of type bigint (missing: ``NONE``), double (missing: NaN) and boolean (missing: false).
    """

    carried: str
    fresh: tuple

    def __init__(self, keys: T.StructType, rows: T.StructType, out: T.StructType, idle_ms: int):
        self.keys, self.rows, self.out, self.idle_ms = keys, rows, out, idle_ms
        self.kinds = [_ARRAYS[f.dataType.simpleString()] for f in rows]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # waiting rows, as columns; how far rows are released, when the last of them was, and the timer that is set
        self.waiting = handle.getValueState("waiting", ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in self.rows))
        self.clock = handle.getValueState("clock", "done long, last long, timer long")
        self.carry = handle.getValueState("carry", self.carried)

    def close(self) -> None:
        pass

    def _held(self) -> Columns:
        held = self.waiting.get() if self.waiting.exists() else [[]] * len(self.kinds)
        return {f.name: np.array(v, kind) for f, v, (kind, _) in zip(self.rows, held, self.kinds, strict=True)}

    def _hold(self, rows: Columns) -> None:
        if len(rows[AT]):
            self.waiting.update(tuple(rows[f.name].tolist() for f in self.rows))
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, last, timer = self.clock.get() if self.clock.exists() else (NONE, NONE, NONE)
        parts = [self._held()]
        for came in rows:
            parts.append({f.name: came[f.name].fillna(missing).to_numpy(kind) for f, (kind, missing) in zip(self.rows, self.kinds, strict=True)})
        every = {f.name: np.concatenate([p[f.name] for p in parts]) for f in self.rows}
        order = np.lexsort((every["revision"], every[AT]))
        order = order[every[AT][order] > done]
        at = every[AT][order]
        order = order[np.append(at[1:] != at[:-1], True)] if len(at) else order
        every = {name: v[order] for name, v in every.items()}
        self._hold(every)
        if len(order):
            first = int(every[AT][0])
            if timer == NONE or first < timer:
                if timer != NONE:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
                timer = first
            self.clock.update((done, last, timer))
        yield self._framed(key, {})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentWatermarkInMs())
        done, last, _ = self.clock.get()
        held = self._held()
        due = int(np.searchsorted(held[AT], now, side="right"))
        ready, rest = {n: v[:due] for n, v in held.items()}, {n: v[due:] for n, v in held.items()}
        out, carry, wake = self.release(ready, tuple(self.carry.get()) if self.carry.exists() else self.fresh, now)
        last = int(ready[AT][-1]) if due else last
        following = [x for x in (int(rest[AT][0]) if len(rest[AT]) else None, wake, last + self.idle_ms) if x is not None and x > now]
        if following:
            self._hold(rest)
            self.carry.update(carry)
            self.handle.registerTimer(min(following))
            self.clock.update((max(done, last, self.settled(carry)), last, min(following)))
        else:
            for state in (self.waiting, self.clock, self.carry):
                state.clear()
        yield self._framed(key, out)

    def _framed(self, key, out: dict) -> pd.DataFrame:
        n = len(next(iter(out.values()))) if out else 0
        own = dict(zip(self.keys.names, key, strict=True))
        # strings as objects: of pandas' own strings Arrow makes chunks, which the state server does not take
        return pd.DataFrame({f.name: pd.Series([own[f.name]] * n if f.name in own else out.get(f.name, []), dtype=object if f.name in own else None) for f in self.out})

    def settled(self, carry: tuple) -> int:
        """Time up to which ``release`` has given out rows of its own, so that none can come in."""
        return NONE

    def release(self, rows: Columns, carry: tuple, now: int) -> tuple[dict, tuple, int | None]:
        """(columns of the result, the next carry, when to wake at the latest or None) of rows in time order; there may be none."""
        raise NotImplementedError


def in_order(rows: DataFrame, by: list[str], time: str, late: str, processor: type[InOrder], out: str, idle_ms: int, revision: str | None = None, **settings) -> DataFrame:
    """Run ``processor`` over a stream, keyed by ``by``; event time is the timestamp ``time``, rows may be ``late`` by so much."""
    spark_rows = rows.withWatermark(time, late).withColumns({AT: F.unix_millis(time), "revision": F.col(revision).cast("long") if revision else F.lit(0).cast("long")})
    keys = T.StructType([rows.schema[k] for k in by])
    held = T.StructType([f for f in spark_rows.schema if f.name not in (*by, time)])
    schema = T.StructType.fromDDL(out)
    # a worker beside the driver also loads the processor, and gets no files that were added to the application: send code, not names
    own = {sys.modules[c.__module__] for c in processor.__mro__ if issubclass(c, InOrder)}
    for module in own:
        cloudpickle.register_pickle_by_value(module)
    try:
        return spark_rows.groupBy(*by).transformWithStateInPandas(processor(keys, held, schema, idle_ms, **settings), schema, "Append", "EventTime")
    finally:
        for module in own:
            cloudpickle.unregister_pickle_by_value(module)


def start(df: DataFrame, path: str, marks: str) -> StreamingQuery:
    """Append a stream's result to a Parquet folder until its input is used up; state in RocksDB."""
    spark = df.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
