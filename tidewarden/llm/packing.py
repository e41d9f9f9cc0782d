"""Packing documents into sequences of a fixed capacity.

Method: bulk-synchronous best-fit over classes. Pieces are range-sorted by length in the cluster and ranked within their
length. Gaps are held by size, as runs of sequences of equal gap. Round by round, from the longest length down, all
pieces of a length sweep over the smallest gaps that hold them (the successors) and fill them; the k-th piece of a length
takes the k-th place, so ranks resolve conflicts; the gaps shrink, and what fits nowhere opens sequences.

Pieces of one length are alike, so a round needs only the number of pieces of a length and the runs of gaps: at most
`capacity` classes, whatever the number of documents. So the rounds run on class counts on the driver, and the pieces
are touched once, to take their places from the finished table of rounds. A piece goes where sequential best-fit
decreasing puts it (or to a sequence of the same gap), so there are as many sequences as it makes.

Edge cases: a null text is empty and has the end id only; repeated rows are packed as often as they occur (a piece is
(doc_id, piece) of each row); a null doc_id is kept; an empty table gives no rows; texts longer than the capacity are cut into whole sequences
and a rest; ties in length are ordered by doc_id and piece. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewarden.llm import common, tokens

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Each document's ids and end id in pieces of at most `capacity`, with the crc32 of a piece's ids."""
    path = path or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in common.steps(batches):
            ids, bounds = enc.encode(b.column(1))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            per = -(-sizes // capacity)
            piece = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(np.repeat(sizes, per) - start, capacity)
            at = np.repeat(bounds[:-1], per) + start
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            who = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), per)))
            yield common.as_batch(pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]), [who, piece.astype(np.int32), start, length, crc])

    return common.texts(docs).mapInArrow(run, PIECES)


def rounds(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length: (first rank, first sequence, pieces in a sequence, offset) of each run of places, by rank.

    counts: pieces of each length. Places of one run fill sequences with consecutive numbers, one after the other.
    """
    runs: dict[int, list[list[int]]] = {}  # gap -> runs of [first sequence, number of sequences]
    sizes: list[int] = []  # gaps that have runs, ascending
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if not gap or not n:
            return
        if gap not in runs:
            runs[gap] = []
            bisect.insort(sizes, gap)
        at = runs[gap]
        if at and at[-1][0] + at[-1][1] == first:
            at[-1][1] += n
        else:
            at.append([first, n])

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        mine = places.setdefault(length, [])
        while left:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):  # fits nowhere: open what these pieces need on their own
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            # A sequence with the smallest gap that holds the piece still has the smallest one after it, so it is filled.
            gap = sizes[k]
            first, n = runs[gap].pop(0)
            per = gap // length
            take = min(left, n * per)
            mine.append((rank, first, per, capacity - gap))
            rank, left = rank + take, left - take
            full, rest = divmod(take, per)
            if not runs[gap]:
                del runs[gap]
                sizes.pop(k)
            put(gap - per * length, first, full)
            if rest:
                put(gap - rest * length, first + full, 1)
            put(gap, first + full + (rest > 0), n - full - (rest > 0))
    return places


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (with a column length, from 1 to capacity)."""
    spark = parts.sparkSession
    schema = pa.schema([(f.name, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()]) for f in parts.schema])
    ranked = pa.schema([*schema, ("part", pa.int32()), ("rank", pa.int64())])
    with_rank = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", part int, rank long"

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            length = b.column("length").to_numpy()
            starts = np.flatnonzero(np.diff(length, prepend=length[0] - 1)) if len(length) else np.zeros(0, np.int64)
            runs = np.diff(starts, append=len(length))
            out = np.arange(len(length)) - np.repeat(starts, runs)
            if len(length):
                if length[0] == last:
                    out[: runs[0]] += n
                n = int(out[-1]) + 1
                last = length[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(out), part, np.int32)), pa.array(out.astype(np.int64))], schema=ranked)

    keys = ["length", *[c for c in ("doc_id", "piece") if c in parts.columns]]
    local = common.written(parts.repartitionByRange(common.partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(rank, with_rank), "ranked-pieces")
    # Parts are ranges of lengths, so this has a row for each part and each length at most, not for each pair.
    by_part = local.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = {n: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for n, v in rounds(counts, capacity).items()}
    final = pa.schema([*schema, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, at = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("before").to_numpy()
            seq, offset = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                ranks, first, per, off = table[int(n)]
                k = np.searchsorted(ranks, at[mine], side="right") - 1
                nth = at[mine] - ranks[k]
                seq[mine], offset[mine] = first[k] + nth // per[k], off[k] + nth % per[k] * n
            yield pa.RecordBatch.from_arrays([*b.columns[: len(schema)], pa.array(seq), pa.array(offset)], schema=final)

    joined = local.join(before.select("length", "part", "before"), ["length", "part"]).select(*schema.names, "rank", "before")
    return joined.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.written(pieces(common.table(spark, sf_dir, "documents")), "pieces"))
