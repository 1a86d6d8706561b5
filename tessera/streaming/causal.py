"""Causal lag triples over a stream: state by episode, ticks in any order, each triple once.

A tick's values wait in the episode's list state until the ticks one and two strides away have come; the last of the three to arrive, whichever it is, emits
the triple, so late ticks only delay it.  Ticks that no tick to come can reach any more, by the watermark, leave the state, at the latest by a timer.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ensure_importable

_STATE = "tick long, sec double, x double, ok boolean"


class Triples(StatefulProcessor):
    """``most``: greatest gap in seconds between ticks one stride apart; ``names``: columns of tick, seconds, value and validity."""

    def __init__(self, episode: str, stride: int, most: float, names: tuple[str, str, str, str]):
        self.episode, self.stride, self.most, self.names = episode, stride, most, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ticks = handle.getListState("ticks", _STATE)

    def _kept(self, held: dict[int, tuple], watermark: float) -> dict[int, tuple]:
        # a row before the watermark is never seen again, so one that is further back than two gaps has no use
        return {t: v for t, v in held.items() if v[0] + 2 * self.most >= watermark}

    def _store(self, held: dict[int, tuple], timed: bool) -> None:
        # ``timed``: a timer is there since the state was first filled; it renews itself when it expires, so it needs no call for each batch
        if held:
            self.ticks.put([(t, *v) for t, v in sorted(held.items())])
            if not timed:
                self.handle.registerTimer(int((max(v[0] for v in held.values()) + 2 * self.most) * 1000) + 1000)
        else:
            self.ticks.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        held = {t: (sec, x, ok) for t, sec, x, ok in self.ticks.get()}
        timed, new = bool(held), set()
        for frame in rows:
            for t, sec, x, ok in zip(*(frame[c].tolist() for c in self.names), strict=True):
                if t not in held:  # a tick that comes again changes nothing
                    held[int(t)] = (float(sec), float(x), bool(ok))
                    new.add(int(t))
        s, found = self.stride, []
        for t in sorted({t + k * s for t in new for k in (0, 1, 2)}):
            three = [held.get(t - k * s) for k in (2, 1, 0)]
            if None in three or not all(v[2] for v in three):
                continue
            if three[1][0] - three[0][0] <= self.most and three[2][0] - three[1][0] <= self.most:
                found.append((key[0], t, three[2][0], *(v[1] for v in three)))
        self._store(self._kept(held, timerValues.getCurrentWatermarkInMs() / 1000), timed)
        if found:
            yield pd.DataFrame(found, columns=[self.episode, "tick", "sec", "x0", "x1", "x2"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        held = {t: (sec, x, ok) for t, sec, x, ok in self.ticks.get()}
        self._store(self._kept(held, timerValues.getCurrentWatermarkInMs() / 1000), False)
        yield from ()

    def close(self) -> None:
        pass


def causal_triples(stream: DataFrame, stride: int, value: str, most_gap: float, late: str, episode: str = "user_id", tick: str = "tick", seconds: str = "sec", time: str = "ts", valid: str | None = None) -> DataFrame:
    """(episode, tick, sec, x0, x1, x2) for each tick whose values two strides and one stride ago are known, valid and at most ``most_gap`` seconds apart each.

    ``time`` is the event time of ``seconds``; rows later than ``late`` are dropped.  Needs the RocksDB state store.  Equals the batch operator with that gap on all rows that came in time.
    """
    spark = stream.sparkSession
    ensure_importable(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the process that starts a stateful query has no files of this package
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = stream.schema[episode].dataType.simpleString()
    rows = stream.withColumn("at_ok", F.lit(True) if valid is None else F.coalesce(F.col(valid), F.lit(False))).where(F.col(value).isNotNull() & F.col(tick).isNotNull())
    narrow = rows.select(episode, time, F.col(tick).cast("long").alias("at_tick"), F.col(seconds).cast("double").alias("at_sec"), F.col(value).cast("double").alias("at_x"), "at_ok")
    processor = Triples(episode, stride, most_gap, ("at_tick", "at_sec", "at_x", "at_ok"))
    out = f"`{episode}` {kind}, tick long, sec double, x0 double, x1 double, x2 double"
    return narrow.withWatermark(time, late).groupBy(episode).transformWithStateInPandas(processor, out, "Append", "EventTime")


def run_to_end(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Process what is there, batch by batch, into Parquet files, and return these; a run that was cut off goes on from its checkpoint."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)
