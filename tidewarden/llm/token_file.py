"""Token ids in a compressed block file.

Method: canonical, length-limited Huffman coding of ids from counts over the whole corpus, decoded by table in
independent blocks that carry bit-offset checkpoints.

File format: a Parquet folder `blocks` (one row is one block of whole documents, in ascending doc_id order by
(part, block)) and a Parquet folder `code` with the code length of each id that occurs; canonical codes follow from
the lengths. A block row has: part, block (its order), start (ids of all documents before it), doc_ids and n_tokens of
its documents, checkpoints (bit offset of every 256th id) and payload (the bits, most significant first).

Edge cases: a null text is empty and has the end id only; rows that share a doc_id are kept, ordered by a hash of their
text; a null doc_id sorts first; an empty table gives empty folders; a very long text is a block of its own, which the
checkpoints let a reader decode in parallel lanes. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import common, tokens

#: Ids after which a block is closed, ids between checkpoints, and the longest code in bits.
BLOCK_IDS, STRIDE, LONGEST = 1 << 16, 256, 20

RAW = "part int, block int, doc_ids array<long>, n_tokens array<long>, ids binary"
BLOCKS = "part int, block int, start long, doc_ids array<long>, n_tokens array<long>, checkpoints array<long>, payload binary"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes of more than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    # Each level's list is the ids and the pairs of the level below, by weight; is_id says which an entry is.
    levels, merged = [], weights
    is_id = np.ones(len(weights), bool)
    levels.append(is_id)
    for _ in range(longest - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        merged, is_id = both[by], by < len(weights)
        levels.append(is_id)
    take, lengths = 2 * (len(order) - 1), np.zeros(len(order), np.int64)
    for is_id in reversed(levels):
        ids = int(is_id[:take].sum())
        lengths[:ids] += 1
        take = 2 * (take - ids)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes: by length, then by id."""
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0]:
        code <<= int(lengths[i]) - last
        codes[i], last = code, int(lengths[i])
        code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """The bits of ids, and the bit offset of every stride-th of them."""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ids) else 0
    out = np.zeros(total // 8 + 5)
    word = codes[ids] << (32 - (at & 7) - size)
    for k in range(4):
        out += np.bincount((at >> 3) + k, weights=(word >> (24 - 8 * k)) & 255, minlength=len(out))
    return out[: (total + 7) // 8].astype(np.uint8).tobytes(), at[::stride]


class Decoder:
    """Looks up the next `longest` bits of many lanes at once; a lane starts at each checkpoint."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        codes = canonical(lengths)
        order = np.lexsort((codes, lengths))
        order = order[lengths[order] > 0]
        self.ids, self.sizes = np.zeros(1 << self.bits, np.int32), np.ones(1 << self.bits, np.int32)
        spans = 1 << (self.bits - lengths[order])
        filled = int(spans.sum())
        self.ids[:filled], self.sizes[:filled] = np.repeat(order, spans), np.repeat(lengths[order], spans)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int, stride: int = STRIDE) -> np.ndarray:
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        lanes, at = len(checkpoints), np.array(checkpoints, np.int64)
        out, mask = np.zeros((stride, lanes), np.int32), (1 << self.bits) - 1
        for k in range(stride):
            live = lanes if (lanes - 1) * stride + k < n else lanes - 1  # only the last lane may be short
            if not live:
                break
            p = at[:live]
            got = (words[p >> 3] >> (32 - self.bits - (p & 7)).astype(np.uint32)) & mask
            out[k, :live] = self.ids[got]
            p += self.sizes[got]
        return out.T.reshape(-1)[:n]


def raw_blocks(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Documents in range-sorted parts, encoded and gathered into blocks of 16- or 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, block = tokens.encoder(path), TaskContext.get().partitionId(), 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("ids", pa.binary())])
        who: list = []
        sizes: list = []
        held: list = []
        count = 0
        for b in common.steps(batches):
            ids, bounds = enc.encode(b.column(1))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u2" if enc.size <= 1 << 16 else "<u4")
            bounds = bounds + np.arange(len(bounds))
            names = b.column(0).to_pylist()
            at = 0
            while at < len(names):
                to = int(np.searchsorted(bounds, bounds[at] + BLOCK_IDS - count, side="left"))
                to = min(max(to, at + 1), len(names))
                who += names[at:to]
                sizes += np.diff(bounds[at : to + 1]).tolist()
                held.append(ids[bounds[at] : bounds[to]])
                count += int(bounds[to] - bounds[at])
                at = to
                if count >= BLOCK_IDS:
                    yield common.as_batch(schema, [[part], [block], [who], [sizes], [np.concatenate(held).tobytes()]])
                    block, count, who, sizes, held = block + 1, 0, [], [], []
        if who:
            yield common.as_batch(schema, [[part], [block], [who], [sizes], [np.concatenate(held).tobytes()]])

    spark = docs.sparkSession
    dealt = common.texts(docs).withColumn("h", F.xxhash64("text")).repartitionByRange(common.partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return dealt.select("doc_id", "text").mapInArrow(run, RAW)


def id_counts(raw: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all blocks (a table bounded by the vocabulary)."""
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in common.steps(batches, "ids"):
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in raw.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2) -> str:
    """Writes the file format into `folder` (any path that Spark can write) and returns the folder."""
    path, spark = path or tokens.vocabulary_path(), docs.sparkSession
    size = max(tokens.encoder(path).size, end_id + 1)
    wide = tokens.encoder(path).size > 1 << 16
    raw = common.written(raw_blocks(docs, path, end_id), "token-blocks")
    lengths = code_lengths(id_counts(raw, size))
    some = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": some.astype(np.int32), "bits": lengths[some].astype(np.int32)})).coalesce(1).write.mode("overwrite").parquet(f"{folder}/code")
    # One row for each part (bounded by the number of partitions): where its ids start.
    parts = sorted((r["part"], r["n"]) for r in raw.groupBy("part").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("n")).collect())
    first, at = {}, 0
    for part, n in parts:
        first[part], at = at, at + n
    in_part = "aggregate(n_tokens, 0L, (a, x) -> a + x)"
    starts = raw.select("part", "block", F.expr(in_part).alias("n"))
    # Blocks are numbered within a part of bounded size, so this window is short and shuffles a few numbers a block.
    from pyspark.sql import Window

    offsets = starts.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")).select("part", "block", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                ids = np.frombuffer(row.column("ids")[0].as_buffer(), "<u4" if wide else "<u2").astype(np.int64)
                bits, marks = pack(ids, codes, lengths)
                part = row.column("part")[0].as_py()
                yield common.as_batch(
                    pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())]),
                    [row.column("part"), row.column("block"), [first[part] + row.column("before")[0].as_py()], row.column("doc_ids"), row.column("n_tokens"), [marks.tolist()], [bits]],
                )

    joined = raw.join(offsets, ["part", "block"]).select("part", "block", "before", "doc_ids", "n_tokens", "ids")
    joined.mapInArrow(run, BLOCKS).write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks")
    common.dropped(raw)
    return folder


def read_tokens(spark: SparkSession, folder: str, schema: str, each) -> DataFrame:
    """Decodes every block; each(doc_ids, n_tokens, start, ids) returns the columns of `schema` for one block."""
    code = spark.read.parquet(f"{folder}/code").collect()
    lengths = np.zeros(max([r["id"] for r in code], default=0) + 1, np.int64)
    for r in code:
        lengths[r["id"]] = r["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for b in batches:
            for k in range(b.num_rows):
                sizes = b.column("n_tokens")[k].values.to_numpy()
                marks = b.column("checkpoints")[k].values.to_numpy()
                ids = decoder.decode(b.column("payload")[k].as_py(), marks, int(sizes.sum()))
                yield each(b.column("doc_ids")[k].values, sizes, b.column("start")[k].as_py(), ids)

    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").mapInArrow(run, schema)


def digests(doc_ids: pa.Array, sizes: np.ndarray, start: int, ids: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(sizes)
    raw = memoryview(ids.astype("<u4")).cast("B")
    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    return common.as_batch(pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]), [doc_ids, start + ends - sizes, sizes, crc])


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_tokens(common.table(spark, sf_dir, "documents"), common.new_folder(spark, "token-file"))
    return read_tokens(spark, folder, DOCS, digests)
