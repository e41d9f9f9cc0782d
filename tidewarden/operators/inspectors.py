"""Inspectors of writes that are plugged in: one class gives the batch and the stream form.

An inspector looks back over a bounded number of the same key's writes. It says which writes take part and what it needs to know
of one (columns), and judges a write by a memory that it updates. The batch form replays parts of a key with a halo of
`window` rows (see rolling), the stream form keeps the last `window` rows of each key as state, so both see the same. What a
write is known by passes as JSON: numbers, strings, booleans and lists of them.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.operators import rolling


class Lookback(ABC):
    """A plugged-in inspector; its memory must depend on the last `window` writes only."""

    flag: str
    window: int

    @abstractmethod
    def columns(self) -> dict[str, Column]:
        """What it needs of a write, from the columns of a log with detection (content, source, bound_key, ...)."""

    def takes(self) -> Column:
        """Which writes take part; others are neither judged nor remembered."""
        return F.lit(True)

    @abstractmethod
    def start(self) -> Any:
        """An empty memory."""

    @abstractmethod
    def see(self, memory: Any, row: dict[str, Any]) -> bool:
        """Whether a write (secs and columns()) is flagged; the memory then knows it."""


def known(inspectors: tuple[Lookback, ...]) -> Column:
    """What each inspector needs of a write, as JSON; null where the write takes no part."""
    if not inspectors:
        return F.array().cast("array<string>")
    row = lambda i: F.to_json(F.struct(F.col("secs"), *[c.alias(n) for n, c in i.columns().items()]))
    return F.array(*[F.when(i.takes(), row(i)) for i in inspectors])


def flagged(passed: DataFrame, inspector: Lookback, place: int, part: int = rolling.PART) -> DataFrame:
    """seq of the writes (seq, bound_key, more) that an inspector flags; place: which of `more` is its own."""
    rows = passed.select("seq", "bound_key", F.get("more", F.lit(place)).alias("row")).where("row IS NOT NULL")
    cut = rolling.parts(rolling.numbered(rows, "bound_key", "seq"), inspector.window, part)
    n = max(1, int(passed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.select("bound_key", "part", "pos", "own", "seq", "row").repartition(n, "bound_key", "part").sortWithinPartitions("bound_key", "part", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, memory = None, None
        for b in batches:
            out = []
            for key, part, own, seq, row in zip(*(b.column(c).to_pylist() for c in ("bound_key", "part", "own", "seq", "row")), strict=True):
                if (key, part) != last:
                    last, memory = (key, part), inspector.start()
                if inspector.see(memory, json.loads(row)) and own:
                    out.append(seq)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["seq"])

    return dealt.mapInArrow(run, "seq long")


def replayed(inspector: Lookback, past: list[str], rows: list[str | None]) -> tuple[list[bool], list[str]]:
    """The stream form: whether each new row is flagged, and what is to be kept, from the rows kept before."""
    memory, kept, out = inspector.start(), list(past), []
    for row in past:
        inspector.see(memory, json.loads(row))
    for row in rows:
        out.append(row is not None and bool(inspector.see(memory, json.loads(row))))
        kept += [row] * (row is not None)
    return out, kept[-inspector.window :] if inspector.window else []
