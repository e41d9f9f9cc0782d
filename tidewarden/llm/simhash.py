"""Near-duplicates by SimHash.

Method: generalised pigeonhole. The 64 bits are grouped into partitions of correlated bits; a dynamic programme gives
each partition its own Hamming threshold (-1 leaves it out) from estimated candidate counts, such that two
fingerprints within `distance` bits must agree within its threshold on some partition. Fingerprints probe by partition
values with threshold-many bits masked; those that share a key are verified on all 64 bits.

Only distinct fingerprints are compared, so exact copies cost nothing, and a group of sharers gives a spanning forest of
its links, not all pairs. A key with more than HOT sharers is dealt out in pairs of blocks. Correlations, counts and
probes cover all documents.

Edge cases: a null text is empty; a text without words has fingerprint zero, linked like any other; repeated rows
(also of one doc_id) share a fingerprint; a null doc_id is kept and takes its component's least non-null doc_id (null if it
has none); an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import common
from tidewarden.llm.components import connected

BITS, SEED, WORDS, DISTANCE = 64, 42, 4, 4
#: Sharers of a key that one task compares; rows that a task compares at a time; cost of a probe in comparisons.
HOT, STEP_ROWS, PROBE_COST = 20_000, 200_000, 400


def shingles(text: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """Hashes of the word shingles (repeats included) of UTF-8 text, some at a time; fewer words make one shingle."""
    w = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return
    s, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        yield np.array([digest(s, SEED)], "<u8")
        return
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    a, b = starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist()
    for at in range(0, len(a), 1 << 16):
        yield np.array([digest(s[x:y], SEED) for x, y in zip(a[at : at + (1 << 16)], b[at : at + (1 << 16)], strict=True)], "<u8")


def mixed(h: np.ndarray, table: int) -> np.ndarray:
    """Hashes of another function for each table; table 0 has the hashes themselves."""
    if not table:
        return h
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * table)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sketch(text: bytes, words: int = WORDS, tables: int = 1) -> list[int]:
    """SimHashes of a text, one for each table, as signed 64-bit integers."""
    total, n = np.zeros((tables, BITS), np.int64), 0
    for h in shingles(text, words):
        n += len(h)
        for k in range(tables):
            total[k] += np.unpackbits(mixed(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of the word shingles (repeats included) of UTF-8 text, as a signed 64-bit integer."""
    return sketch(text, words)[0]


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches):
            at, raw = common.value_offsets(b.column(1)), memoryview(b.column(1).buffers()[2] or b"")
            fp = np.array([fingerprint(bytes(raw[x:y]), words) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return common.texts(docs).mapInArrow(run, "doc_id long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the correlation of each pair of bits over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = _bits(b.column(0).to_numpy()).astype(np.float32)
            total, n = total + (x.T @ x).astype(np.float64), n + len(x)
        cell = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cell), dtype=np.int32)), pa.array(cell)], ["cell", "n"])

    flat = np.zeros(BITS * BITS + 1)
    for r in nodes.select("fp").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        flat[r["cell"]] = r["n"]
    n = int(flat[-1])
    both = flat[:-1].reshape(BITS, BITS) / max(n, 1)
    p = np.diag(both)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    return n, np.where(spread > 0, (both - np.outer(p, p)) / np.where(spread > 0, spread, 1), 0)


def grouped(corr: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of bits of nearly equal width; each takes the bits most correlated with those it has."""
    left, out = set(range(BITS)), []
    strength = np.abs(corr)
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        mine = [max(left, key=lambda b: (strength[b, list(left)].sum(), -b))]
        left.remove(mine[0])
        while len(mine) < width:
            best = max(left, key=lambda b: (strength[b, mine].sum(), -b))
            mine.append(best)
            left.remove(best)
        out.append(sorted(mine))
    return out


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The partition's bits as a number."""
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> b) & 1) << k
    return out


def histograms(nodes: DataFrame, parts: list[list[int]]) -> list[np.ndarray]:
    """How often each value of each partition (its first 16 bits, if wider) occurs over all fingerprints."""
    cut = [p[:16] for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << len(p), np.int64) for p in cut]
        for b in batches:
            for t, p in zip(total, cut, strict=True):
                t += np.bincount(values(b.column(0).to_numpy(), p), minlength=len(t))
        for k, t in enumerate(total):
            some = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(t[some])], ["part", "value", "n"])

    out = [np.zeros(1 << len(p), np.int64) for p in cut]
    found = nodes.select("fp").mapInArrow(run, "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    part, value, n = (found.column(k).to_numpy() for k in range(3))
    for k, t in enumerate(out):
        t[value[part == k]] = n[part == k]
    return out


def candidates(counts: np.ndarray, width: int, threshold: int) -> float:
    """Estimated comparisons if pairs within `threshold` bits on a partition are candidates."""
    have = int(math.log2(len(counts)))
    near, total, scale = counts.astype(float), 0.0, 2.0 ** (have - width)
    for t in range(threshold + 1):
        if t:  # values one more bit away
            near = sum(near[np.arange(len(near)) ^ (1 << b)] for b in range(have)) / t
        total += max(0.0, float(counts @ near) - (counts.sum() if not t else 0)) / 2 * scale * math.comb(width - t, threshold - t) * (math.comb(width, t) / max(1, math.comb(have, t)))
    return total


def allocate(cost: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds t >= -1 for each partition, with sum(t + 1) = distance + 1, at the least cost; cost[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, distance - used + 1):
                key, new = used + t + 1, c + row[t + 1]
                if key not in after or new < after[key][0]:
                    after[key] = (new, [*ts, t])
        best = after
    return best[distance + 1]


def plan(nodes: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed."""
    n, corr = correlations(nodes)
    choices = []
    for m in range(2, distance + 3):
        parts = grouped(corr, m)
        cost = []
        for p, h in zip(parts, histograms(nodes, parts), strict=True):
            cost.append([0.0] + [n * math.comb(len(p), t) * PROBE_COST + candidates(h, len(p), t) if t <= min(3, len(p)) else math.inf for t in range(distance + 1)])
        total, ts = allocate(cost, distance)
        choices.append((total, [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def probes(nodes: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp): each fingerprint under each of its partition values with threshold-many bits masked."""
    from itertools import combinations

    masks = [np.array([sum(1 << b for b in c) for c in combinations(range(len(p)), t)], np.int64) for p, t in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for k, ((p, _), ms) in enumerate(zip(chosen, masks, strict=True)):
                v = values(fp, p)
                for at in range(0, len(ms), 64):
                    some = ms[at : at + 64]
                    key = (v[:, None] & ~some[None, :]) | (((np.arange(at, at + len(some)) << 3 | k) << 33)[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(fp, len(some)))], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def _roots(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels of 0..n-1 (least member) once u[i] and v[i] are joined, given those so far."""
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while not (label[label] == label).all():
            label = label[label]


def forest(key: np.ndarray, fp: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the close pairs within equal keys (sorted); pairs of two sides only, or all if side is 0."""
    n = len(key)
    label, i, lag = np.arange(n), np.arange(n), 0
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(i):
        lag += 1
        i = i[i + lag < n]
        i = i[key[i] == key[i + lag]]
        j = i + lag
        open_ = label[i] != label[j]
        x, y = i[open_], j[open_]
        close = (np.bitwise_count((fp[x] ^ fp[y]).view(np.uint64)) <= distance) & ((side[x] != side[y]) | (side[x] == 0))
        x, y = x[close], y[close]
        while len(x):  # each pass joins every x's tree to one other
            a, b = label[x], label[y]
            _, first = np.unique(np.maximum(a, b), return_index=True)
            us.append(x[first])
            vs.append(y[first])
            label = _roots(n, x[first], y[first], label)
            more = label[x] != label[y]
            x, y = x[more], y[more]
    u, v = np.concatenate(us), np.concatenate(vs)
    return fp[u], fp[v]


def links(nodes: DataFrame, distance: int = DISTANCE, chosen: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Links (u, v) between fingerprints within `distance`, enough to connect what any such links connect.

    chosen: a plan for this distance (plan() of nodes, if not given).
    """
    spark, chosen = nodes.sparkSession, chosen or plan(nodes, distance)
    rows = probes(nodes, chosen)
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key", F.ceil(F.col("n") / (HOT // 2)).cast("int").alias("blocks"))
    # Each sharer of a hot key meets every block: block b is compared within itself once and with each other block once.
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = rows.join(hot, "key", "left").withColumn("b", F.when(F.col("blocks").isNotNull(), block).otherwise(0).cast("int"))
    dealt = dealt.withColumn("c", F.explode(F.when(F.col("blocks").isNotNull(), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))))
    dealt = dealt.select("key", F.least("b", "c").alias("low"), F.greatest("b", "c").alias("high"), F.when(F.col("b") == F.col("c"), 0).when(F.col("b") < F.col("c"), 1).otherwise(2).cast("int").alias("side"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> pa.RecordBatch:
            u, v = forest(*(np.concatenate(c) for c in zip(*parts, strict=True)), distance)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held: list = []
        rows_held, group, last = 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy() for k in range(5)]
            same = np.all([np.concatenate([[last is not None and c[0] == last[k]], c[1:] == c[:-1]]) for k, c in enumerate(cols[:3])], axis=0)
            ids = group + np.cumsum(~same)
            part = (ids, cols[4], cols[3])
            if rows_held + len(ids) > STEP_ROWS and ids[-1] != group:
                k = int(np.searchsorted(ids, ids[-1]))  # the last group may go on
                yield out([*held, tuple(c[:k] for c in part)])
                held, rows_held, part = [], 0, tuple(c[k:] for c in part)
            held.append(part)
            rows_held += len(part[0])
            group, last = int(ids[-1]), [c[-1] for c in cols[:3]]
        if held:
            yield out(held)

    keys = ["key", "low", "high"]
    return dealt.repartition(common.partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable by links) and root (a fingerprint that names the component) of each row."""
    prints = common.written(fingerprints(docs, words), "fingerprints")
    nodes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = connected(links(nodes, distance))
    member = found.union(found.select(F.col("root"), F.col("root"))).distinct().withColumnRenamed("node", "fp")
    least = member.join(nodes, "fp").groupBy("root").agg(F.min("rep").alias("component_id"))
    named = member.join(least, "root").select("fp", "component_id", "root")
    final = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return prints.join(final, "fp").select("doc_id", "fp", "component_id", "root")


def text_key(text: str = "text") -> Column:
    """What names a text; a null text is empty."""
    return F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256), 1, 32)


def alike(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 8, tables: int = 4) -> DataFrame:
    """(node, root): text_key() of each text that has a near-duplicate, and that of its group.

    Texts within `distance` bits in any of `tables` SimHashes are candidates; those whose sets of word shingles have a
    Jaccard similarity of `similarity` or more are linked, and groups are the components of links. Texts without
    words are alike.
    """
    keyed = docs.select(text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    columns = [f"fp{k}" for k in range(tables)]

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches):
            at, raw = common.value_offsets(b.column(1)), memoryview(b.column(1).buffers()[2] or b"")
            fp = np.array([sketch(bytes(raw[x:y]), words, tables) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64).reshape(-1, tables)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in fp.T)], ["key", *columns])

    prints = keyed.mapInArrow(sketches, "key string, " + ", ".join(f"{c} long" for c in columns))
    nodes = common.written(prints.groupBy("key").agg(*(F.first(c).alias(c) for c in columns)), "sketches")
    chosen, pairs = None, None
    for c in columns:
        # Texts of one fingerprint are compared with one of them, and those with each other along the links.
        first = nodes.groupBy(F.col(c).alias("fp")).agg(F.min("key").alias("first"))
        first = common.written(first, "fingerprints")
        chosen = chosen or plan(first, distance)
        found = links(first, distance, chosen).join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v").select("a", "b")
        same = nodes.join(first.withColumnRenamed("fp", c), c).where("key != first").select(F.col("first").alias("a"), F.col("key").alias("b"))
        mine = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(same)
        pairs = mine if pairs is None else pairs.union(mine)
    pairs = common.written(pairs.distinct(), "alike-pairs")
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches):
            held = [np.unique(np.concatenate([np.zeros(0, "<u8"), *shingles(t.encode(), words)])).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], ["key", "words"])

    have = common.written(keyed.join(wanted, "key").mapInArrow(sets, "key string, words binary").dropDuplicates(["key"]), "shingles")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    sided = pairs.join(have.select(F.col("key").alias("a"), F.col("words").alias("x")), "a").join(have.select(F.col("key").alias("b"), F.col("words").alias("y")), "b").select("a", "b", "x", "y")
    out = connected(sided.mapInArrow(near, "u string, v string"))
    common.dropped(nodes, have)
    return out


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
