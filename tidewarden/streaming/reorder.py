"""A buffer that puts a stream of writes in order before it is screened.

Rows wait in state until the watermark has passed their time (secs): then no earlier ones can come any more, and all rows up to it go
on in one micro-batch, whichever order and batch they came in. What follows sorts a batch by seq, so the screening sees the
order of seq, as long as time does not fall with it. Rows are dealt to shards, so the buffer is spread. A row that comes after
the watermark has passed its time is late: it is left out and counted (see late()).

A row with a null seq is a tick: it moves the time on, and is nothing else; the last rows of a stream wait for one. A null secs
counts as zero. An empty stream gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SHARDS = 32
_LOG = {"seq": "long", "secs": "long", "content": "string", "spiffe_id": "string", "trust_tier": "string", "scope": "string", "source": "string", "key": "string"}
_DDL = ", ".join(f"{name} {kind}" for name, kind in _LOG.items())


class Buffer(StatefulProcessor):
    """Rows of a shard by time; a timer for the earliest one that waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "secs long", "rows array<struct<" + ", ".join(f"{n}:{t}" for n, t in _LOG.items()) + ">>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch = batch[batch["seq"].notna()]
        for secs, some in batch.groupby("secs"):
            at = (int(secs),)
            listed = [tuple(None if pd.isna(v) else int(v) if n in ("seq", "secs") else v for n, v in zip(_LOG, row, strict=True)) for row in some[list(_LOG)].itertuples(index=False)]
            held = [tuple(r) for r in self.waiting.getValue(at)[0]] if self.waiting.containsKey(at) else []
            self.waiting.updateValue(at, (held + listed,))
            self.handle.registerTimer(int(secs) * 1000)
        yield pd.DataFrame({n: pd.Series(dtype="object") for n in _LOG})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs() // 1000,)
        if self.waiting.containsKey(at):
            rows = [tuple(r) for r in self.waiting.getValue(at)[0]]
            self.waiting.removeKey(at)
            yield pd.DataFrame(rows, columns=list(_LOG))

    def close(self) -> None:
        pass


def reordered(log: DataFrame, delay: int) -> DataFrame:
    """A stream of writes in which each batch has all rows up to some time; rows may come up to `delay` seconds late."""
    rows = log.select(*[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) if n == "secs" else F.col(n).cast(t).alias(n) for n, t in _LOG.items()])
    rows = rows.withColumns({"at": F.timestamp_seconds("secs"), "shard": F.pmod(F.xxhash64("seq"), F.lit(SHARDS)).cast("int")})
    return rows.withWatermark("at", f"{delay} seconds").groupBy("shard").transformWithStateInPandas(Buffer(), _DDL, "append", "eventtime")


def late(query: StreamingQuery) -> DataFrame:
    """batch and rows that came too late, of the micro-batches that a query remembers."""
    from pyspark.sql import SparkSession

    seen = [(p["batchId"], sum(int(o["numRowsDroppedByWatermark"]) for o in p["stateOperators"])) for p in query.recentProgress]
    return SparkSession.active().createDataFrame([(b, n) for b, n in seen if n], "batch long, n long")
