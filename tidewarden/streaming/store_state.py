"""The store as stream state with a second index: entries by id, and the ids of each content, kept up as operations come.

Two stateful steps follow each other. The first keeps the entry of each id; a put or delete that changes an id's content tells the
second what to unlink and what to link. The second keeps the set of ids of each content, and a content without ids leaves its
state, so an overwrite leaves no stale link. Both states live in the checkpoint and are read back by the state data source.

Operations have seq, op (put or delete), id and content; within a micro-batch they are put in order of seq, later batches must
have later ones. Deleting an id that isn't there does nothing, putting the same content again changes no link, a null content is
empty, rows with a null id or another op are ignored; an empty stream keeps nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewarden.streaming.guard import rocks

PUT, DELETE = "put", "delete"
_CHANGE = "content string, id string, seq long, linked boolean"


class Entries(StatefulProcessor):
    """The last put of each id; the links that its operations of a batch leave dropped or made.

    What a batch links and drops again is no change, so a content passes on only if it was or stays linked.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "seq long, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.entry.get()[1] if self.entry.exists() else None
        last = None
        for batch in rows:
            r = batch.loc[batch["seq"].idxmax()]
            if last is None or r["seq"] > last["seq"]:
                last = r
        seq, then = int(last["seq"]), last["content"] if last["op"] == PUT else None
        if then is not None:
            self.entry.update((seq, then))
        elif now is not None:
            self.entry.clear()
        out = []
        if then != now:
            out += [(now, key[0], seq, False)] * (now is not None) + [(then, key[0], seq, True)] * (then is not None)
        yield pd.DataFrame(out, columns=["content", "id", "seq", "linked"])

    def close(self) -> None:
        pass


class Links(StatefulProcessor):
    """The ids of each content; emits the links that a batch leaves changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "id string", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("seq").drop_duplicates("id", keep="last")
        for r in last.itertuples():
            if r.linked:
                self.ids.updateValue((r.id,), (int(r.seq),))
            elif self.ids.containsKey((r.id,)):
                self.ids.removeKey((r.id,))
        yield last[["content", "id", "seq", "linked"]]

    def close(self) -> None:
        pass


def links(ops: DataFrame) -> DataFrame:
    """content, id, seq and linked of each link that a stream of operations makes or drops."""
    known = ops.where(F.col("op").isin(PUT, DELETE) & F.col("id").isNotNull())
    slim = known.select(F.col("seq").cast("long").alias("seq"), "op", "id", F.coalesce("content", F.lit("")).alias("content"))
    changed = slim.groupBy("id").transformWithStateInPandas(Entries(), _CHANGE, "append", "none")
    return changed.groupBy("content").transformWithStateInPandas(Links(), _CHANGE, "append", "none")


def kept(ops: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the store of a stream of operations in `checkpoint`; the changes of links go to the folder `out`."""
    stream = links(ops).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    with rocks(ops.sparkSession):
        return (stream.trigger(**trigger) if trigger else stream).start()


def _state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """The state of a variable, from whichever step has it."""
    for operator in (0, 1):
        meta = spark.read.format("state-metadata").load(checkpoint).where(F.col("operatorId") == operator)
        if any(f'"{variable}"' in (r["operatorProperties"] or "") for r in meta.select("operatorProperties").collect()):
            return spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable).load(checkpoint)
    raise ValueError(f"no state of {variable} in {checkpoint}")


def entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """id, seq and content of all entries, from the state."""
    return _state(spark, checkpoint, "entry").select("key.id", "value.seq", "value.content")


def content_index(spark: SparkSession, checkpoint: str) -> DataFrame:
    """content and ids of the second index, from the state: what store.content_index gives of the entries."""
    rows = _state(spark, checkpoint, "ids").select("key.content", F.col("user_map_key.id").alias("id"))
    return rows.groupBy("content").agg(F.sort_array(F.collect_set("id")).alias("ids"))
