"""Sessions of events with arbitrary state (an extension of T04): open sessions are kept by key, joined by what comes late, and handed on when the watermark has passed them.

A session is a run of events of one key of which each comes at most ``gap`` milliseconds after the one before. Rows may come in any order: one that falls between two open sessions makes
one of them. What is older than the watermark (``late`` behind the newest event) is dropped, as everywhere in streams. The state of a key is its open sessions, not its events.
``of_table`` gives the same sessions of a table, by a prefix scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import prefix

SPAN = "start long, end long, n long, total double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(spans: list[tuple], gap: int) -> list[tuple]:
    """Spans (start, end, n, total), those that come within the gap of each other made one."""
    out: list[tuple] = []
    for start, end, n, total in sorted(spans):
        if out and start - out[-1][1] <= gap:
            a, b, m, t = out[-1]
            out[-1] = (a, max(b, end), m + n, t + total)
        else:
            out.append((start, end, n, total))
    return out


class Sessions(StatefulProcessor):
    def __init__(self, by: list[str], gap: int):
        self.by, self.gap = by, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", SPAN)

    def _keep(self, spans: list[tuple]) -> None:
        """Put the open sessions, and one timer for the moment that the first of them can grow no more: what is closed by then is handed on together, the rest gets the next timer."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if spans:
            self.open.put(spans)
        else:
            self.open.clear()
        if spans:
            self.handle.registerTimer(min(end for _, end, _, _ in spans) + self.gap + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of Spark's interface
        spans = [tuple(r) for r in self.open.get()]
        for part in rows:
            # Joined batch by batch, so that what is held is open sessions and one batch.
            spans = joined(spans + [(at, at, 1, value) for at, value in zip(part["at_"].tolist(), part["value_"].tolist(), strict=True)], self.gap)
        self._keep(spans)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        spans = [tuple(r) for r in self.open.get()]
        done = [s for s in spans if s[1] + self.gap < now]
        if done:
            self._keep([s for s in spans if s[1] + self.gap >= now])
            yield pd.DataFrame([(*key, *s) for s in done], columns=[*self.by, "start", "end", "n", "total"])

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, by: list[str], at: str, value: str, gap: int, late: str) -> DataFrame:
    """Closed sessions of a stream: by, start and end in milliseconds, number of events and total of their values. Needs the state store that keeps lists and timers, which it sets."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in by)
    rows = stream.select(*by, F.col(at).cast("timestamp").alias("ts_"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value_"))
    return rows.withWatermark("ts_", late).groupBy(*by).transformWithStateInPandas(Sessions(by, gap), f"{kinds}, {SPAN}", "append", "EventTime")


def of_table(df: DataFrame, by: list[str], at: str, value: str, gap: int) -> DataFrame:
    """All sessions of a table, of groups of any size."""
    rows = df.where(F.col(at).isNotNull()).select(*by, F.unix_millis(F.col(at).cast("timestamp")).alias("at_"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value_"))
    cut = prefix.islands(rows, by, "at_", F.lit(gap))
    return cut.groupBy(*by, "island").agg(F.min("at_").alias("start"), F.max("at_").alias("end"), F.count("*").alias("n"), F.sum("value_").alias("total")).drop("island")
