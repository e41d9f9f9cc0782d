"""What the operators share: the cluster's shared folder, written tables, and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python worker holds at a time (a single longer text is one step).
STEP_BYTES = 8 << 20
#: Spark's setting by which a query's shuffle files are deleted at its end, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes of a batch that goes to a Python worker: 10,000 texts at a time are held twice, by the executor and its worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What holds while a table is written.
SETTINGS = {CLEANUP: "true", BATCH_BYTES: str(4 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset (tests on one machine), one of our own.

    On a cluster a machine-local folder would lose data, so an unset folder is an error there.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.gettempdir()}/tidewarden-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewarden/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it survives lost executors and is computed once. Its shuffle files go when it is written, and texts go
    to Python workers in batches of a few MB."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewarden_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later step reads."""
    for t in tables:
        if path := getattr(t, "_tidewarden_path", None):
            jvm, spark = t.sparkSession.sparkContext._jvm, t.sparkSession
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of a documents table; a null text counts as empty, other columns are dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with pos, a row's place within its group by `order` (from 0), and n, the group's rows, both long.

    Rows are range-sorted and counted by part, so a group of any size is numbered by many tasks; only the counts, a row for
    each part and group in it, meet in a window. Rows that are equal in all of `order` are dealt by a number of their own.
    """
    tied = written(df.withColumn("_tie", F.monotonically_increasing_id()), "unnumbered")
    keys = [group, *order, "_tie"]
    part = tied.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).drop("_tie")
    dealt = written(part.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "dealt")
    counts = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.withColumns({"_before": before, "n": F.sum("_n").over(w)}).drop("_n")
    return dealt.join(places, [group, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).select(*df.columns, "pos", "n")


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of `column`, or of one row."""
    for b in batches:
        i = b.schema.get_field_index(column)
        if not b.num_rows:
            continue
        c = b.column(i)
        offsets = value_offsets(c)
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), b.num_rows)
            yield b.slice(at, to - at)
            at = to


def value_offsets(c: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, as int64."""
    kind = np.int64 if pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type) else np.int32
    return np.frombuffer(c.buffers()[1], kind, len(c) + 1, c.offset * np.dtype(kind).itemsize).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs start..start+length-1, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def binary_slices(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose values are data[bounds[i]:bounds[i + 1]] (bounds in items of data)."""
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def as_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
