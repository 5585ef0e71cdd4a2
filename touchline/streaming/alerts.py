"""Structured Streaming versions of the market alerts and table updates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from touchline.operators.market import ODDS_KEY, TRADE_TEXTS, attribute_trades
from touchline.functions.text import is_tournament_trade
from touchline.sources import versions
from touchline.sources.sinks import live_rows

CHANGE_SCHEMA = """event_id bigint, match_id string, pool_code string, outcome string, fetched_at timestamp, odds double,
  previous_odds double, odds_change double, odds_change_pct double"""


class LastOdds(StatefulProcessor):
    """Reports moves of at least ``min_change`` between a key's odds in event order, whatever order they arrive in.

    Rows wait in state, by (time, event), until the watermark has passed them; an event-time timer then compares them in
    order with the odds before them. So a row that is late within the watermark's delay is compared with what was known at
    its time; later ones are left out, mostly by Spark, which counts them (``numRowsDroppedByWatermark``). Odds
    older than ``keep`` are forgotten, and a key without newer ones leaves the state. Rows of a micro-batch come in frames, one is held at a time.
    """

    def __init__(self, min_change: float, keep_ms: int):
        self.min_change, self.keep_ms = min_change, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "odds double, at bigint")
        self.waiting = handle.getMapState("waiting", "at bigint, event_id bigint", "odds double")
        self.due = handle.getValueState("due", "at bigint")

    def _wake(self, at_ms: int) -> None:
        """One timer per key: at the earliest waiting row, or when the key is to be forgotten."""
        if self.due.exists():
            if self.due.get()[0] == at_ms:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(at_ms)
        self.due.update((at_ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = None
        for frame in rows:
            at = frame["fetched_at"].astype("datetime64[us]").astype("int64")
            for moment, event, odds in zip(at, frame["event_id"], frame["odds"], strict=True):
                self.waiting.updateValue((int(moment), int(event)), (float(odds),))
            earliest = int(at.min()) if earliest is None else min(earliest, int(at.min()))
        if earliest is not None:
            ready = -(-earliest // 1000)
            pending = self.due.get()[0] if self.due.exists() and not self._idle() else ready
            self._wake(min(ready, pending))
        return iter(())

    def _idle(self) -> bool:
        """Whether the timer set is the one that forgets the key."""
        return self.last.exists() and self.due.get()[0] >= self.last.get()[1] // 1000 + self.keep_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        ready, later = [], None
        for (at, event), (odds,) in self.waiting.iterator():
            if at <= passed:
                ready.append((at, event, odds))
            else:
                later = at if later is None else min(later, at)
        ready.sort()
        out = []
        before = self.last.get() if self.last.exists() else None
        for at, event, odds in ready:
            self.waiting.removeKey((at, event))
            if before is not None and at < before[1]:
                continue
            if before is not None and at - before[1] > self.keep_ms * 1000:
                before = None
            if before is not None and abs(odds - before[0]) >= self.min_change:
                change = odds - before[0]
                out.append((event, *key, pd.Timestamp(at, unit="us"), odds, before[0], change, change / before[0] if before[0] else None))
            before = (odds, at)
        if ready:
            self.last.update(before)
        if later is not None:
            self._wake(-(-later // 1000))
        elif before is not None and before[1] // 1000 + self.keep_ms > passed // 1000:
            self._wake(before[1] // 1000 + self.keep_ms)
        else:
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=[
                "event_id", *ODDS_KEY, "fetched_at", "odds", "previous_odds", "odds_change", "odds_change_pct"])

    def close(self) -> None:
        pass


def odds_change_alerts(stream: DataFrame, min_change: float = 0.02, lateness: str = "1 hour", keep_days: float = 14.0) -> DataFrame:
    """Alert when the odds of (match, pool, outcome) move since their last observation, in order of ``fetched_at``.

    An alert is told when the watermark (``lateness`` behind the newest row) has passed its row. Needs the RocksDB state
    store provider.
    """
    rows = stream.select("event_id", *ODDS_KEY, "fetched_at", "odds").withWatermark("fetched_at", lateness)
    return rows.groupBy(*ODDS_KEY).transformWithStateInPandas(
        statefulProcessor=LastOdds(min_change, int(keep_days * 86_400_000)), outputStructType=_schema(rows),
        outputMode="Append", timeMode="EventTime")


def _schema(rows: DataFrame) -> StructType:
    return rows.sparkSession.createDataFrame([], CHANGE_SCHEMA).schema


def large_buy_alerts(stream: DataFrame, min_notional: float = 500.0, lateness: str = "1 day",
                     texts: Sequence[str] = TRADE_TEXTS) -> DataFrame:
    """Big tournament BUY trades, each trade id once within the watermark."""
    notional = F.coalesce("size", F.lit(0.0)) * F.coalesce("price", F.lit(0.0))
    big = stream.withColumn("notional", notional).where(
        is_tournament_trade(*[F.coalesce(F.col(t), F.lit("")) for t in texts if t in stream.columns]) & (F.upper("side") == "BUY") & (F.col("notional") >= min_notional))
    return big.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["trade_id"])


def match_buy_alerts(stream: DataFrame, matches: DataFrame, min_notional: float = 500.0) -> DataFrame:
    """Large exact-score buys attributed to the static match list."""
    return attribute_trades(large_buy_alerts(stream, min_notional), matches)


def history_append(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Live snapshot rows appended to the history table, exactly once."""
    return (live_rows(stream).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint))


def upsert_stream(stream: DataFrame, base_path: str, root: str, checkpoint: str) -> DataStreamWriter:
    """Finished matches replace base rows of the same key in a versioned table (``sources.versions``).

    A micro-batch rewrites the days it touches, beside the former ones, and then moves the version pointer; a repeated batch
    finds its version committed and does nothing. Of several updates of a key in a batch the one with the greatest ``seq``
    (if there is such a column, else the greatest row) wins; the others go to the reject table of the batch.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        versions.upsert(batch, root, batch_id, base_path)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
