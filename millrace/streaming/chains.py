"""Chains of numbered records as keyed state: each stream's head, what came early, and a timer for what does not come.

A record is accepted when its number is next.  One that comes early waits; when its stream has waited ``patience``, the numbers before the
least one waiting are given up (a ``gap``) and the chain goes on from there.  So the batches that records come in do not matter, only
what is there when patience ends.  Only streams with records in a batch, or with a timer that ends, are touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Numbers behind the head whose digests are remembered, to tell a repeat from a fork; beyond it both are ``late``.
HISTORY = 1000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Chains(StatefulProcessor):
    """``(stream_id, seq, fault)`` of records ``(stream_id, seq, prev, own)``; ``prev`` names the digest ``own`` of the record before.

    Faults: ``repeat`` (the same record again), ``fork`` (another one of that number), ``late`` (after its number was given up, or
    too old to be known), ``start`` and ``gap`` (at the first record behind what is given up), ``link``.
    """

    def __init__(self, patience_ms: int, history: int = HISTORY):
        self.patience_ms, self.history = max(1, patience_ms), history  # a timer of the present batch would end unseen

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "seq long, own string, waits boolean")
        self.early = handle.getMapState("early", "seq long", "prev string, own string")
        self.seen = handle.getMapState("seen", "seq long", "own string, there boolean")

    def _rows(self, key: tuple, faults: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        if faults:
            yield pd.DataFrame({"stream_id": [key[0]] * len(faults), "seq": [s for s, _ in faults], "fault": [f for _, f in faults]})

    def _state(self) -> tuple[int, str | None, bool]:
        return tuple(self.head.get()) if self.head.exists() else (-1, None, False)

    def _advance(self, seq: int, own: str | None, faults: list) -> tuple[int, str | None]:
        """Accept what is next for as long as it is there."""
        while self.early.containsKey((seq + 1,)):
            prev, after = self.early.getValue((seq + 1,))
            self.early.removeKey((seq + 1,))
            # the record before was given up if its digest is not known
            if not (seq >= 0 and own is None) and prev != own:
                faults.append((seq + 1, "link"))
            seq, own = seq + 1, after
            self._remember(seq, own, True)
        return seq, own

    def _remember(self, seq: int, own: str | None, there: bool) -> None:
        self.seen.updateValue((seq,), (own, there))
        if self.seen.containsKey((seq - self.history,)):
            self.seen.removeKey((seq - self.history,))

    def _waiting(self) -> list[int]:
        return [int(k[0]) for k in self.early.keys()]

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        seq, own, waits = self._state()
        faults = []
        given = pd.concat([*rows]).sort_values(["seq", "own", "prev"], kind="stable")
        for number, prev, digest in zip(given["seq"].tolist(), given["prev"].tolist(), given["own"].tolist(), strict=True):
            prev, digest = (None if pd.isna(v) else v for v in (prev, digest))
            if self.early.containsKey((number,)):
                faults.append((number, "repeat" if tuple(self.early.getValue((number,))) == (prev, digest) else "fork"))
            elif number > seq:
                self.early.updateValue((number,), (prev, digest))
            elif self.seen.containsKey((number,)) and self.seen.getValue((number,))[1]:
                faults.append((number, "repeat" if self.seen.getValue((number,))[0] == digest else "fork"))
            else:
                faults.append((number, "late"))
        seq, own = self._advance(seq, own, faults)
        if not waits and self._waiting():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
            waits = True
        self.head.update((seq, own, waits))
        yield from self._rows(key, faults)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        seq, own, _ = self._state()
        faults, waiting = [], self._waiting()
        if waiting:
            least = min(waiting)
            faults.append((least, "start" if seq < 0 else "gap"))
            for lost in range(max(seq + 1, least - self.history), least):
                self._remember(lost, None, False)
            seq, own = self._advance(least - 1, None, faults) if least else self._advance(-1, None, faults)
            waiting = self._waiting()
        if waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        self.head.update((seq, own, bool(waiting)))
        yield from self._rows(key, faults)

    def close(self) -> None:
        pass


def chain_stream(records: DataFrame, patience_ms: int, history: int = HISTORY) -> DataFrame:
    """The faults of a stream of records ``(stream_id, seq, prev, own)`` as they are found."""
    given = records.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.col("prev").cast("string").alias("prev"), F.col("own").cast("string").alias("own"))
    return given.groupBy("stream_id").transformWithStateInPandas(Chains(patience_ms, history), "stream_id string, seq long, fault string", "Append", "ProcessingTime")


def run_chains(records: DataFrame, checkpoint: str, act: Callable[[DataFrame], None], patience_ms: int, history: int = HISTORY, every: str = "1 second") -> StreamingQuery:
    """Hand the faults of each batch to ``act``; state lives in the checkpoint.

    The query goes on until it is stopped: timers end in batches without data too.
    """
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    found = chain_stream(records, patience_ms, history)
    return found.writeStream.foreachBatch(lambda batch, _: act(batch)).option("checkpointLocation", checkpoint).trigger(processingTime=every).outputMode("append").start()
