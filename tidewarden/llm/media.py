"""Media columns: payloads in content-addressed tar shards, rows with digest, offset and length.

Method: a payload is stored as an 8-bit greyscale PNG of 64 samples a line (lossless), named by the sha256 of the
payload, in a tar shard; a row carries the digest, the shard, and offset and length of the PNG in it. Range reads of
the first 33 bytes fill the metadata columns (width, height, depth); range reads of the whole fill features. Each task
writes a payload once however many of its rows have it, and a catalogue keeps one place for each digest, so each
digest is read back once. Shards have a name of their own for each attempt and the manifest is a committed
table: a repeated task leaves at most an unreferenced file.

Edge cases: a null or empty text is one line of zeros; equal texts share a digest; texts that differ only in zero bytes
at the end share a payload and differ in n_bytes; a payload over `SHARD_BYTES` fills a shard of its own; repeated
rows and null doc_ids are kept; an empty table gives no rows and no shards. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import common

LINE, SHARD_BYTES, LEVEL = 64, 256 << 20, 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and the header chunk.
HEADER_BYTES = 33

MANIFEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
MANIFEST_DDL = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % LINE or (0 if text else LINE))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = LEVEL) -> bytes:
    lines = np.zeros((len(payload) // LINE, LINE + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first bytes of a file."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR" or struct.unpack(">I", first[29:33])[0] != zlib.crc32(first[12:29]):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", first[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data[:HEADER_BYTES])
    at, parts = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


class ShardWriter:
    """Appends members to tar shards in a folder that any pyarrow file system can write."""

    def __init__(self, folder: str, most: int = SHARD_BYTES):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.most, self.out, self.at = most, None, 0

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > self.most:
            self.close()
            self.name = f"shard-{uuid.uuid4().hex}.tar"
            self.fs.create_dir(self.root, recursive=True)
            self.out, self.at = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.PAX_FORMAT)
        self.out.write(head)
        self.out.write(data)
        self.out.write(bytes(-len(data) % 512))
        offset = self.at + len(head)
        self.at = offset + len(data) + -len(data) % 512
        return self.name, offset, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the payloads of documents into shards under folder; returns the manifest (one row for each document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, places = ShardWriter(folder), {}
        for b in common.steps(batches):
            at, raw = common.value_offsets(b.column(1)), memoryview(b.column(1).buffers()[2] or b"")
            rows = []
            for doc, x, y in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                payload = padded(bytes(raw[x:y]))
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in places:
                    places[digest] = shards.add(f"{digest}.png", to_png(payload))
                rows.append((doc, y - x, digest, *places[digest]))
            yield common.as_batch(MANIFEST, list(zip(*rows, strict=True)))
        shards.close()

    return common.written(common.texts(docs).mapInArrow(run, MANIFEST_DDL), "manifest")


def catalogue(manifest: DataFrame) -> DataFrame:
    """One place for each digest."""
    one = manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return one.select("digest", "at.shard", "at.offset", "at.length")


def read_ranges(places: DataFrame, folder: str, schema: pa.Schema, ddl: str, each, most: int | None = None) -> DataFrame:
    """each(bytes) for the first `most` bytes (all if None) of each place, read in order of shard and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for b in batches:
            rows = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != name:
                    name, source = shard, system.open_input_file(f"{root}/{shard}")
                rows.append((digest, *each(source.read_at(length if most is None else min(most, length), offset))))
            if rows:
                yield common.as_batch(schema, list(zip(*rows, strict=True)))

    spark = places.sparkSession
    return places.repartitionByRange(common.partitions(spark), "shard", "offset").sortWithinPartitions("shard", "offset").mapInArrow(run, ddl)


HEADERS = pa.schema([("digest", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("depth", pa.int64())])
FEATURES = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def headers(places: DataFrame, folder: str) -> DataFrame:
    """Metadata columns of each digest, from header-only range reads."""
    return read_ranges(places, folder, HEADERS, "digest string, width long, height long, depth long", png_header, HEADER_BYTES)


def feature_of(payload: bytes) -> str:
    """Mean, deviation, entropy, mean step and a 16-bin histogram (per mille) of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    values = np.arange(256)
    mean = float(counts @ values) / len(x)
    deviation = float(np.sqrt(max(0.0, float(counts @ (values * values)) / len(x) - mean * mean)))
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    bins = counts.reshape(16, 16).sum(axis=1) * 1000 // len(x)
    return f"mean={mean:.4f};dev={deviation:.4f};entropy={-float(p @ np.log2(p)) + 0.0:.4f};step={step:.4f};hist=" + ",".join(map(str, bins.tolist()))


def features(places: DataFrame, folder: str) -> DataFrame:
    """Digests and features of each stored payload, from the stored bytes."""

    def each(data: bytes) -> tuple:
        payload = from_png(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-LINE:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload)

    return read_ranges(places, folder, FEATURES, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", each)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "media")
    manifest = store(common.table(spark, sf_dir, "documents"), folder)
    places = common.written(catalogue(manifest), "catalogue")
    found = features(places, folder).join(headers(places, folder), "digest")
    rows = manifest.select("doc_id", "n_bytes", "digest").join(found, "digest")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
