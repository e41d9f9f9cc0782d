"""Document fingerprints by Order MinHash.

Method: a text's k-mers of code points are numbered by occurrence, so each is distinct. Each of `functions` hash
functions selects the `chosen` k-mers of least hash; they are put back in text order, and the tuple is hashed to one
component of the signature. The share of equal components estimates a likeness that falls with edit distance: it needs
the same k-mers, as often, in the same order.

Edge cases: a null text is empty; a text of fewer than k code points is one k-mer; two texts of none are alike; equal
texts have equal fingerprints; rows that share a doc_id are ordered by a hash of their text, a null doc_id comes last;
an only document is its own next; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import common

K, FUNCTIONS, CHOSEN = 5, 64, 2
#: k-mers hashed at a time; a longer text is gone through in such pieces.
PIECE = 1 << 15
_RANDOM = np.random.default_rng(20240501)
_ODD = _RANDOM.integers(0, 2**63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
_MASK = _RANDOM.integers(0, 2**64, 256, np.uint64, endpoint=False)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_LAST = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered(codes: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each k-mer and its occurrence number, in text order."""
    n = max(1, len(codes) - k + 1) if len(codes) else 0
    h = np.zeros(n, np.uint64)
    for j in range(min(k, len(codes))):
        h = h * _BASE + codes[j : j + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if n else np.zeros(0, np.int64)
    occurrence = np.arange(n) - np.repeat(first, np.diff(first, append=n))
    out = np.empty(n, np.uint64)
    out[order] = _mixed(s + _STEP * (occurrence.astype(np.uint64) + np.uint64(1)))
    return out


def signature(codes: np.ndarray, k: int = K, functions: int = FUNCTIONS, chosen: int = CHOSEN) -> np.ndarray:
    """The components, as 32-bit numbers."""
    g = numbered(codes, k)
    take = min(chosen, len(g))
    best = np.full((functions, 0), 0, np.int64)
    keys = np.zeros((functions, 0), np.uint64)
    rows = np.arange(functions)
    for at in range(0, len(g), PIECE):
        x = (g[None, at : at + PIECE] ^ _MASK[:functions, None]) * _ODD[:functions, None]
        for _ in range(min(take, x.shape[1])):
            p = x.argmin(axis=1)
            best, keys = np.column_stack([best, p + at]), np.column_stack([keys, x[rows, p]])
            x[rows, p] = _LAST
        if keys.shape[1] > take:
            least = np.argsort(keys, axis=1, kind="stable")[:, :take]
            best, keys = np.take_along_axis(best, least, 1), np.take_along_axis(keys, least, 1)
    out = np.full(functions, len(g) > 0, np.uint64)
    for column in np.sort(best, axis=1).T:
        out = _mixed(out * _BASE + g[column])
    return (out >> np.uint64(32)).astype("<u4")


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def neighbours(docs: DataFrame) -> DataFrame:
    """Documents dealt to parts that are ranges of descending doc_id, each in order and followed by the next part's first.

    Columns: ahead (a following part's first document), doc_id, text. The bounds of each part come to the driver; texts
    are shuffled once.
    """
    spark = docs.sparkSession
    rows = common.texts(docs).withColumn("at", F.coalesce("doc_id", F.lit(-(2**63))))
    ranged = rows.select("at").repartitionByRange(common.partitions(spark), F.desc("at"))
    bounds = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("at").alias("low"), F.max("at").alias("high")).collect()
    bounds = sorted(((r["low"], r["high"]) for r in bounds), reverse=True)
    lows, highs = np.array([b[0] for b in bounds][::-1], np.int64), np.array([b[1] for b in bounds], np.int64)
    n = max(1, len(bounds))

    @F.pandas_udf("int")
    def part(at: pd.Series) -> pd.Series:
        return pd.Series(n - np.searchsorted(lows, at.to_numpy(), side="right"), dtype="int32")

    @F.pandas_udf("boolean")
    def leads(at: pd.Series) -> pd.Series:
        return pd.Series(np.isin(at.to_numpy(), highs))

    dealt = rows.withColumn("part", part("at")).withColumn("lead", leads("at"))
    here, there = F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead")), F.struct(F.pmod(F.col("part") - 1, F.lit(n)).alias("part"), F.lit(True).alias("ahead"))
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("lead"), F.array(here, there)).otherwise(F.array(here))))
    dealt = dealt.select(F.col("to.part").alias("part"), F.col("to.ahead").alias("ahead"), "at", "doc_id", F.xxhash64("text").alias("h"), "text")
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "ahead", F.desc("at"), "h").select("ahead", "doc_id", "text")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text with its last half replaced by the beginning of the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None
        for b in common.steps(batches, limit=1 << 20):
            for ahead, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is None and ahead:
                    continue
                codes = codes_of(text)
                now = (doc, text, codes, signature(codes))
                if held is not None:
                    out.append(edited(held, now))
                held = None if ahead else now
            if out:
                yield common.as_batch(SCHEMA, list(zip(*out, strict=True)))
                out = []

    def edited(a: tuple, b: tuple) -> tuple:
        doc, text, codes, sig = a
        half = len(codes) // 2
        other = text[: len(text) - half] + b[1][:half]
        sig2 = signature(codes_of(other))
        return doc, len(codes), hashlib.sha256(other.encode()).hexdigest(), sig.tobytes().hex(), sig2.tobytes().hex(), likeness(sig, sig2), likeness(sig, b[3])

    return neighbours(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(common.table(spark, sf_dir, "documents"))
