"""Keyed state of tick streams: a book of price levels and a ring of recent ticks per symbol.

State lives in the store Spark checkpoints (`session.SETTINGS` names the RocksDB provider that
it needs), so a restarted stream goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

HIT = "position_id string, symbol string, direction string, ts timestamp, price double, exit_flag string"
DOWN, UP = 0, 1  # a level is met at or below, or at or above, its price


class LevelBook(StatefulProcessor):
    """Stops and targets of a symbol, sorted by price; a tick meets only the levels it crosses.

    The nearest level on either side is kept apart: ticks between them never touch the book.
    A level that is crossed makes its position pending, with its earliest tick by (ts, event_id);
    it fires when the watermark has passed that tick, so late ticks within the watermark count
    as in `first_hits`. A position fires once and leaves the book.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getValueState("levels", "price array<double>, side array<int>, id array<string>, long array<boolean>, stop array<boolean>")
        self.nearest = handle.getValueState("nearest", "down double, up double")
        self.pending = handle.getMapState("pending", "id string", "ts timestamp, event_id long, price double, stop boolean, long boolean")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        rows = []
        for p in initialState.itertuples():
            long = p.direction == "LONG"
            rows += [(float(p.stop_loss), DOWN if long else UP, p.position_id, long, True), (float(p.take_profit), UP if long else DOWN, p.position_id, long, False)]
        self.store(rows)

    def store(self, rows: list[tuple]) -> None:
        rows = sorted(r for r in rows if r[0] == r[0])
        self.levels.update(tuple(list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [], []))
        down, up = [r[0] for r in rows if r[1] == DOWN], [r[0] for r in rows if r[1] == UP]
        self.nearest.update((max(down, default=float("-inf")), min(up, default=float("inf"))))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if self.nearest.exists():
            down, up = self.nearest.get()
            book = None
            for pdf in rows:
                if not ((pdf["price"] <= down) | (pdf["price"] >= up)).any():
                    continue
                book = book or [np.array(c) for c in self.levels.get()]
                self.meet(pdf.sort_values(["ts", "event_id"]), *book)
        return iter(())

    def meet(self, ticks: pd.DataFrame, price: np.ndarray, side: np.ndarray, ids: np.ndarray, long: np.ndarray, stop: np.ndarray) -> None:
        seen = ticks["price"].to_numpy()
        low, high = np.minimum.accumulate(seen), np.maximum.accumulate(seen)
        first = np.searchsorted(price, low[-1])  # levels are sorted: what was crossed is a slice at either end
        last = np.searchsorted(price, high[-1], side="right")
        crossed = [i for i in range(first, len(price)) if side[i] == DOWN] + [i for i in range(last) if side[i] == UP]
        for i in crossed:
            at = np.searchsorted(-low, -price[i]) if side[i] == DOWN else np.searchsorted(high, price[i])
            tick = ticks.iloc[int(at)]
            self.propose(str(ids[i]), tick["ts"].to_pydatetime(), int(tick["event_id"]), float(tick["price"]), bool(stop[i]), bool(long[i]))

    def propose(self, position: str, ts, event: int, price: float, stop: bool, long: bool) -> None:
        key = (position,)
        if self.pending.containsKey(key):
            old = self.pending.getValue(key)
            if (old[0], old[1], not old[3]) <= (ts, event, not stop):
                return
        self.pending.updateValue(key, (ts, event, price, stop, long))
        self.handle.registerTimer(int(pd.Timestamp(ts).timestamp() * 1000) + 1)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        done = [(k[0], v) for k, v in self.pending.iterator() if pd.Timestamp(v[0]).timestamp() * 1000 <= mark]
        if not done:
            return iter(())
        fired = {k for k, _ in done}
        for k in fired:
            self.pending.removeKey((k,))
        self.store([r for r in zip(*self.levels.get(), strict=True) if r[2] not in fired])
        return iter([pd.DataFrame([(k, key[0], "LONG" if v[4] else "SHORT", v[0], v[2], "SL_HIT" if v[3] else "TP_HIT") for k, v in done],
                                  columns=["position_id", "symbol", "direction", "ts", "price", "exit_flag"])])

    def close(self) -> None:
        pass


class TickRing(StatefulProcessor):
    """The last `size` ticks of a symbol by (ts, event_id); ticks repeated in the stream count once.

    Emits the whole ring of each symbol that changed. A symbol without ticks for `idle_ms` of
    event time is forgotten.
    """

    def __init__(self, size: int, idle_ms: int):
        self.size, self.idle = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "ts timestamp, event_id long, price double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = {(r[0], r[1]): r for r in self.ring.get()} if self.ring.exists() else {}
        for pdf in rows:
            for r in zip(pdf["ts"].dt.to_pydatetime(), pdf["event_id"].tolist(), pdf["price"].tolist(), strict=True):
                held[r[0], r[1]] = r
            if len(held) > 2 * self.size:
                held = dict(sorted(held.items())[-self.size:])
        kept = [held[k] for k in sorted(held)[-self.size:]]
        self.ring.put(kept)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(pd.Timestamp(kept[-1][0]).timestamp() * 1000) + self.idle)
        yield pd.DataFrame({"symbol": [key[0]], "ticks": [[{"ts": t, "event_id": e, "price": p} for t, e, p in kept]]})

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        return iter(())

    def close(self) -> None:
        pass


def monitor(ticks: DataFrame, positions: DataFrame, watermark: str = "5 minutes") -> DataFrame:
    """Stream form of `feeds.first_hits`: the first hit of each position, once no earlier tick can come.

    `ticks` is a stream of symbol, ts, price, event_id; `positions` a table of position_id, symbol,
    direction, stop_loss, take_profit that fills the books before the first tick.
    """
    some = ticks.withWatermark("ts", watermark).select("symbol", "ts", F.col("price").cast("double").alias("price"), "event_id")
    held = positions.select(F.col("position_id").cast("string").alias("position_id"), "symbol", "direction",
                            F.col("stop_loss").cast("double").alias("stop_loss"), F.col("take_profit").cast("double").alias("take_profit"))
    return some.groupBy("symbol").transformWithStateInPandas(LevelBook(), HIT, "Append", "EventTime", held.groupBy("symbol"))


def tick_rings(ticks: DataFrame, size: int = 5000, idle: int = 86_400_000, watermark: str = "5 minutes") -> DataFrame:
    """Stream form of `feeds.recent_ticks`: symbol and its last ticks as an array, in update mode."""
    some = ticks.withWatermark("ts", watermark).select("symbol", "ts", F.col("price").cast("double").alias("price"), "event_id")
    return some.groupBy("symbol").transformWithStateInPandas(
        TickRing(size, idle), "symbol string, ticks array<struct<ts: timestamp, event_id: bigint, price: double>>", "Update", "EventTime")
