"""Periodic run detection: words that repeat with a period, by Karp-Miller-Rosenberg names of power-of-two windows.

Method: the words of a step of documents stand one after the other, longest document first, each document closed by a mark that
occurs once. Level k names the windows of 2**k words: equal windows share a number, and a window that occurs once has a
negative one of its own. Level 0 numbers the words; level k + 1 ranks pairs of names of level k. A run of period q has 3 q
equal pairs (i, i + q) in a row, so one of the grid's points i = 0, 3 q, 6 q, ... lies among them, and on one side of it 1.5 q
pairs are equal. Grid points are thus tried at the level whose windows are that long, all periods of a level at once; those
that pass are extended to both sides by descending levels. No hashes and no suffix array are made, and a level at which no
window occurs twice ends the search, so ordinary text stops early.

There is no shuffle: a task reads its part of the table and holds the words of one step (STEP_BYTES of text, or one longer text)
and one number a word for each level that has repeated windows.

Edge cases: a null or empty text, or one of white space only, has no words and no runs; a null doc_id is not altered (its text is
taken as it is); repeated rows give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewarden.llm import common

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Names:
    """Names of windows by level; the text ends with a word that occurs once."""

    def __init__(self, words: np.ndarray):
        self.levels = [_ranked(words.astype(np.int64), np.arange(len(words)), len(words))]

    def repeated(self) -> bool:
        """Whether any window of the last level occurs twice."""
        return bool((self.levels[-1] >= 0).any())

    def grow(self) -> None:
        """Adds the next level, from pairs of names that both occur twice."""
        last, half = self.levels[-1], 1 << (len(self.levels) - 1)
        n = len(last)
        at = np.flatnonzero(last[: n - half] >= 0) if half < n else np.zeros(0, np.int64)
        at = at[last[at + half] >= 0]
        self.levels.append(_ranked(last[at].astype(np.int64) * (int(last.max()) + 1) + last[at + half], at, n))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on are equal."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            x, y = names[np.minimum(i + out, len(names) - 1)], names[np.minimum(j + out, len(names) - 1)]
            out += ((x == y) & (x >= 0)).astype(np.int64) << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and j (i < j) are equal."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, x = self.levels[k], i - out - (1 << k)
            some = x >= 0
            a, b = names[np.maximum(x, 0)], names[np.maximum(j - out - (1 << k), 0)]
            out += (some & (a == b) & (a >= 0)).astype(np.int64) << k
        return out


def _ranked(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Names of n windows, those at `at` by rank of their keys among keys that occur twice; all others have names of their own."""
    out = -1 - np.arange(n, dtype=np.int32)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] - 1))
        sizes = np.diff(starts, append=len(keys))
        many = sizes > 1
        rank = np.repeat(np.where(many, np.cumsum(many) - 1, -1), sizes)
        out[at[order[rank >= 0]]] = rank[rank >= 0]
    return out


def runs(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of all runs of documents that stand one after the other, in order of start, then period.

    lengths: words of each document with its mark, not rising; words: numbers, where the mark of each document is a number of
    its own.
    """
    names, found = Names(words), []
    ends = np.cumsum(lengths)
    most = int(lengths[0] - 1) // TIMES if len(lengths) else 0
    q = 1
    while q <= most and names.repeated():
        # All periods whose 1.5 q lies between this level's window and the next one's.
        k = len(names.levels) - 1
        last = min(most, (4 << k) // 3)
        if last >= q:
            qs = np.arange(q, last + 1)
            # Documents that can hold the period are a prefix.
            fit = np.searchsorted(-(lengths - 1), -np.maximum(LEAST, TIMES * qs), side="right")
            reach = np.where(fit > 0, ends[np.maximum(fit - 1, 0)], 0)
            counts = np.maximum(0, -(-(reach - qs) // (3 * qs)))
            i = common.ragged(np.zeros(len(qs), np.int64), counts) * np.repeat(3 * qs, counts)
            period = np.repeat(qs, counts)
            level, width = names.levels[k], 1 << k
            right = (level[i] >= 0) & (level[i] == level[i + period])
            left = i - width + 1 >= 0
            back = level[np.maximum(i - width + 1, 0)]
            left &= (back >= 0) & (back == level[np.maximum(i + period - width + 1, 0)])
            some = right | left
            found.append((i[some], period[some]))
            q = last + 1
        if q <= most:
            names.grow()
    i, period = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    while names.repeated() and len(i):
        names.grow()  # the extension starts with windows that occur once at most
    ahead, behind = names.ahead(i, i + period), names.behind(i, i + period)
    good = (ahead > 0) & (ahead + behind >= np.maximum(LEAST - period, (TIMES - 1) * period))
    start, length, period = (i - behind)[good], (ahead + behind + period)[good], period[good]
    # The same stretch also has multiples of its period, and several points of the grid.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def altered(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where the repetition that a document's number asks for begins, and its period; None where there is none."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    return None if h % 10 else (g % n, 1 + (n - g % n) // (3 + g % 8))


def _described(doc_ids: list, texts: list[bytes]) -> pa.RecordBatch:
    """The result's rows of a step of documents."""
    split = [t.split() for t in texts]  # of bytes: at 0x20 and 0x09 to 0x0D
    order = sorted(range(len(split)), key=lambda d: -len(split[d]))
    lengths = np.array([len(split[d]) + 1 for d in order], np.int64)
    flat = pa.array([w for d in order for w in split[d]], pa.large_binary()).dictionary_encode()
    codes, known = flat.indices.to_numpy(), len(flat.dictionary)
    ends = np.cumsum(lengths)
    words = np.empty(int(lengths.sum()), np.int64)
    at = 0  # of codes
    for r, d in enumerate(order):
        n = len(split[d])
        own, here = codes[at : at + n], int(ends[r] - lengths[r])
        if (repeat := altered(doc_ids[d], n)) is not None:
            a, p = repeat
            index = np.arange(n)
            index[a:] = a + (index[a:] - a) % p
            own = own[index]
            split[d] = [split[d][x] for x in index.tolist()]
        words[here : here + n], words[here + n] = own, known + r
        at += n
    start, length, period = runs(words, lengths)
    of = np.searchsorted(ends, start, side="right")
    bounds = np.searchsorted(of, np.arange(len(order) + 1))
    out: list[tuple | None] = [None] * len(order)
    for r, d in enumerate(order):
        mine = slice(bounds[r], bounds[r + 1])
        s, m, q = start[mine] - (ends[r] - lengths[r]), length[mine], period[mine]
        kept = split[d]
        top: tuple = (None, None, None, None)
        if len(s):
            cover = np.zeros(len(kept) + 1, np.int64)
            np.add.at(cover, s + q, 1)
            np.add.at(cover, s + m, -1)
            kept = [kept[x] for x in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
            best = np.lexsort((q, s, -m))[0]
            top = (int(s[best]), int(m[best]), int(q[best]), 1000 * int(m[best]) // int(q[best]))
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), m.tolist(), q.tolist(), strict=True))
        out[d] = (doc_ids[d], len(s), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())
    return common.as_batch(SCHEMA, list(zip(*out, strict=True)))


def described(docs: DataFrame) -> DataFrame:
    """Runs of each document: their number, the longest one, digests of the list of all and of the text without repetitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches):
            at, raw = common.value_offsets(b.column(1)).tolist(), memoryview(b.column(1).buffers()[2] or b"")
            yield _described(b.column(0).to_pylist(), [bytes(raw[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)])

    return common.texts(docs).mapInArrow(run, DDL)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(common.table(spark, sf_dir, "documents"))
