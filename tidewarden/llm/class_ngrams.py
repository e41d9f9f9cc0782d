"""Brown class-based n-grams: exchange clustering of words, class transitions and word emissions, perplexity of every text.

Method: documents are encoded in blocks with word lists of their own; words are counted over all training documents by parts of
the vocabulary, and the counts go back to the blocks' lists, so tokens themselves never meet the vocabulary in a shuffle. The most frequent words (whole bands
of counts that double, at most HEAD words) are clustered by exchange: a word goes to the class that raises the class-bigram
likelihood most, by the exact change for its left and right neighbours, one in PARTS words at a time, ROUNDS times; of the
states on the way the likeliest stays. Every pair of neighbours of the whole corpus counts; they are kept by word, so a round reads them where they lie and shuffles
nothing, and the driver holds a class for each clustered word and CLASSES**2 sums. Every other word has the class of its
band of counts, and words that training lacks have a class of their own.

The model: log10 P(word | history) = log10 P(class | context) + log10 P(word | class). The context is the last clustered
word's class, or that of the end mark at the start; rarer words are transparent. Transitions are counted with a word's own
occurrence left out where it decides the class (a word seen once stands for an unknown one, one seen twice for one seen once),
and discounted by DISCOUNT towards the classes' shares. Emissions are shares of counts within a class. The probabilities
of all training words, the end mark and the unknown word add up to one in every context.

Edge cases: a null or empty text is the end mark alone; a null doc_id is not held out, so it trains; repeated rows count each; with
no training documents all words are unknown (score and base are 0 for each token, as one outcome is all there is); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import common

#: Most words that are clustered, their longest spelling in bytes, exchange classes, discount of transitions.
HEAD, SPELLING, CLASSES, DISCOUNT = 1 << 15, 64, 64, 0.5
#: Of the clustered words one in PARTS may move in a round: too many at once would move for the same reason.
ROUNDS, PARTS = 16, 6
#: Text of a block; pairs of neighbours that a task holds before it passes them on.
BLOCK_BYTES, HELD_PAIRS = 4 << 20, 1 << 21
#: Bands of counts: 1, 2 to 3, 4 to 7, ...
BANDS = 64
#: Classes after the exchange classes: the end mark, unknown words, bands of counts.
END, UNKNOWN, BAND = CLASSES, CLASSES + 1, CLASSES + 2
ALL = BAND + BANDS

BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("codes", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
BLOCKS_DDL = "block long, doc_ids array<long>, sizes array<long>, codes binary, words array<string>, counts array<long>"
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _logs(x: np.ndarray) -> np.ndarray:
    """x log x, 0 at 0."""
    return x * np.log(np.maximum(x, 1.0))


# Blocks


def encoded(docs: DataFrame) -> DataFrame:
    """Blocks of documents: words without the end mark as codes into the block's list, with counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in common.steps(batches, limit=BLOCK_BYTES):
            ids = b.column(0).to_pylist()
            at, raw = common.value_offsets(b.column(1)).tolist(), memoryview(b.column(1).buffers()[2] or b"")
            tokens: list[bytes] = []
            sizes = np.zeros(len(ids), np.int64)
            for d, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
                tokens += bytes(raw[x:y]).lower().split()  # of bytes: A-Z only; 0x20, 0x09 to 0x0D
                sizes[d] = len(tokens)
            sizes = np.diff(sizes, prepend=0)
            flat = pa.array(tokens, pa.binary()).dictionary_encode()
            del tokens
            codes = flat.indices.to_numpy().astype(np.int32)
            train = np.repeat(np.array([not held_out(d) for d in ids], bool), sizes)
            counts = np.bincount(codes[train], minlength=len(flat.dictionary))
            yield common.as_batch(BLOCKS, [[block], [ids], [sizes.tolist()], [codes.tobytes()], pa.ListArray.from_arrays(pa.array([0, len(flat.dictionary)], pa.int32()), flat.dictionary.cast(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int64()))])
            block += 1
            pa.default_memory_pool().release_unused()

    return common.texts(docs).mapInArrow(run, BLOCKS_DDL)


def counted(blocks: DataFrame) -> DataFrame:
    """Training counts of all words: for each part of the vocabulary and block where the block's words (at) and their n are, and
    for each part its words and their n (with a null block).

    Words are dealt to parts by hash, as many as there are blocks, so a part is as large as a block's list; a row is a list, so
    Spark moves few rows.
    """
    parts = max(1, blocks.count())
    dealt = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words, counts = b.column("words")[k].values, b.column("counts")[k].values.to_numpy()
                part = np.array([zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()], np.int64) % parts
                order = np.argsort(part, kind="stable")
                at = np.flatnonzero(np.diff(part[order], prepend=-1))
                bounds = np.append(at, len(order))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.take(pa.array(order)))
                yield common.as_batch(dealt, [part[order][at].astype(np.int32), pa.array(np.full(len(at), b.column("block")[k].as_py()), pa.int64()), common.binary_slices(order.astype(np.int32), bounds), lists, common.binary_slices(counts[order], bounds)])

    out = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("words", pa.list_(pa.string())), ("n", pa.binary())])

    def count(t: pa.Table) -> pa.Table:
        lists = t.column("words").combine_chunks()
        codes = lists.flatten().dictionary_encode()
        index = codes.indices.to_numpy()
        total = np.zeros(len(codes.dictionary), np.int64)
        np.add.at(total, index, np.concatenate([np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist()]))
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        some = np.flatnonzero(total)
        known = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), codes.dictionary.take(pa.array(some)))
        every = pa.table([t.column("block"), t.column("at"), pa.nulls(t.num_rows, out.field("words").type), common.binary_slices(total[index], bounds)], schema=out)
        return pa.concat_tables([every, pa.table([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), known, pa.array([total[some].tobytes()])], schema=out)])

    lists = blocks.select("block", "words", "counts").mapInArrow(deal, "part int, block long, at binary, words array<string>, counts binary")
    return common.written(lists.groupBy("part").applyInArrow(count, "block long, at binary, words array<string>, n binary"), "words")


def _bands(n: np.ndarray) -> np.ndarray:
    """floor(log2 n), exactly."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1


class Vocabulary:
    """Counts of all training words by band, and the clustered words by count, then spelling.

    The words themselves are a table; here is what is bounded: a number for each band, and at most HEAD words of at most
    SPELLING bytes with their counts.
    """

    def __init__(self, blocks: DataFrame, words: DataFrame, head: int = HEAD):
        known = words.where("block IS NULL").select("words", "n")

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = np.concatenate([np.frombuffer(x, np.int64) for x in b.column("n").to_pylist()]) if b.num_rows else np.zeros(0, np.int64)
                types = np.bincount(_bands(n), minlength=BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(range(BANDS), pa.int32()), pa.array(types), pa.array(np.bincount(_bands(n), weights=n, minlength=BANDS).astype(np.int64))], ["band", "types", "n"])

        bands = known.mapInArrow(tally, "band int, types long, n long").groupBy("band").agg(F.sum("types").alias("types"), F.sum("n").alias("n")).collect()
        types, self.band_tokens = np.zeros(BANDS, np.int64), np.zeros(BANDS, np.int64)
        for r in bands:
            types[r["band"]], self.band_tokens[r["band"]] = r["types"], r["n"]
        self.documents = blocks.select(F.explode("doc_ids").alias("doc_id")).where(F.col("doc_id").isNull() | (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)).count()
        self.tokens = int(self.band_tokens.sum()) + self.documents
        self.types = int(types.sum()) + (self.documents > 0)
        # Words seen once to three times are never clustered: they stand for unknown words and those seen once.
        least = self.least = next(h for h in range(2, BANDS) if types[h:].sum() <= head)

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    n = np.frombuffer(b.column("n")[k].as_py(), np.int64)
                    listed = b.column("words")[k].values
                    some = np.flatnonzero((n >= 1 << least) & (pa.compute.binary_length(listed).to_numpy() <= SPELLING))
                    yield pa.RecordBatch.from_arrays([listed.take(pa.array(some)), pa.array(n[some])], ["word", "n"])

        top = sorted(((-r["n"], r["word"].encode()) for r in known.mapInArrow(frequent, "word string, n long").collect()))  # at most HEAD words
        self.words = [w.decode() for _, w in top]
        self.counts = np.array([-n for n, _ in top], np.int64)
        self.head = len(top)
        self.band_tokens -= np.bincount(_bands(self.counts), weights=self.counts, minlength=BANDS).astype(np.int64)


class Block:
    """A block's tokens, an end mark after each document: counts, ranks, and whose they are."""

    def __init__(self, b: pa.RecordBatch, k: int, documents: int):
        self.documents, self.doc_ids = documents, b.column("doc_ids")[k].as_py()
        sizes = b.column("sizes")[k].values.to_numpy()
        codes = np.frombuffer(b.column("codes")[k].as_buffer(), np.int32)
        n, rank = np.frombuffer(b.column("n")[k].as_buffer(), np.int64), np.frombuffer(b.column("rank")[k].as_buffer(), np.int32)
        self.sizes = sizes + 1
        self.ends = np.cumsum(self.sizes) - 1
        word = np.ones(int(self.sizes.sum()), bool)
        word[self.ends] = False
        self.end = ~word
        self.n, self.rank = np.full(len(word), documents, np.int64), np.full(len(word), -1, np.int64)
        self.n[word], self.rank[word] = n[codes], rank[codes]
        self.held = np.array([held_out(d) for d in self.doc_ids], bool)
        self.train = np.repeat(~self.held, self.sizes)

    def classes(self, of: np.ndarray, left_out: bool) -> np.ndarray:
        """The class of each token; of: those of clustered words. left_out: as if this occurrence hadn't been counted."""
        n = np.maximum(self.n - left_out, 0)
        out = np.where(n > 0, BAND + np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1, UNKNOWN)
        some = self.rank >= 0
        out[some] = of[self.rank[some]]
        out[self.end] = END if self.documents else UNKNOWN
        return out

    def contexts(self, classes: np.ndarray) -> np.ndarray:
        """The class of the last clustered word or end mark before each token."""
        at = np.where(self.end | (self.rank >= 0), np.arange(len(classes)), -1)
        last = np.maximum.accumulate(np.concatenate([[-1], at[:-1]]))
        return np.where(last >= 0, classes[np.maximum(last, 0)], END)


def _each(batches: Iterator[pa.RecordBatch], documents: int) -> Iterator[Block]:
    for b in batches:
        for k in range(b.num_rows):
            yield Block(b, k, documents)


# Exchange


def _sides(key: np.ndarray, n: np.ndarray, size: int, head: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of sorted pairs (a * size + b) with counts: for each clustered a, its bs and their counts."""
    a = key // size
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True):
        if a[x] < head:
            yield int(a[x]), (key[x:y] % size).astype(np.int32), n[x:y]


MERGED = pa.schema([("w", pa.int32()), ("other", pa.binary()), ("n", pa.binary()), ("before", pa.binary())])


def merged_sides(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """One row of each w from its lists (w, before, other, n), in order of w. Holds 2 size sums, however many lists there are."""
    sums, last = np.zeros(2 * size, np.int64), None

    def row() -> pa.RecordBatch:
        key = np.flatnonzero(sums)
        out = common.as_batch(MERGED, [[last], [(key % size).astype(np.int32).tobytes()], [sums[key].tobytes()], [(key >= size).tobytes()]])
        sums[:] = 0
        return out

    for b in batches:
        for k in range(b.num_rows):
            w = b.column("w")[k].as_py()
            if last is not None and w != last:
                yield row()
            last = w
            key = np.frombuffer(b.column("other")[k].as_buffer(), np.int32) + size * np.int64(b.column("before")[k].as_py())
            sums[key] += np.frombuffer(b.column("n")[k].as_buffer(), np.int64)  # a list has each word once
    if last is not None:
        yield row()


def neighbours(coded: DataFrame, v: Vocabulary) -> DataFrame:
    """For each clustered word w the words after it and before it: other (int32), n (int64) and before (bool), as bytes.

    Words that aren't clustered are symbols after the clustered ones, one for each class. A row is a list, so Spark moves few
    rows; a clustered word has at most 2 (HEAD + ALL) neighbours.
    """
    head, documents = v.head, v.documents
    size = head + ALL
    lists = pa.schema([("w", pa.int32()), ("before", pa.bool_()), ("other", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0

        def sums() -> Iterator[pa.RecordBatch]:
            whole = np.concatenate(keys)
            keys.clear()
            key, n = np.unique(whole, return_counts=True)
            del whole
            for before in (False, True):
                if before:
                    key = key % size * size + key // size
                    order = np.argsort(key)
                    key, n = key[order], n[order]
                rows = [(w, before, o.tobytes(), c.tobytes()) for w, o, c in _sides(key, n, size, head)]
                for at in range(0, len(rows), 5000):
                    yield common.as_batch(lists, list(zip(*rows[at : at + 5000], strict=True)))

        same = np.arange(head)
        for block in _each(batches, documents):
            symbols = block.classes(same, False)
            symbols[block.rank < 0] += head
            a, b = np.concatenate([[head + END], symbols[:-1]]), symbols
            some = block.train & ((a < head) | (b < head))
            keys.append(a[some] * size + b[some])
            held += len(keys[-1])
            if held > HELD_PAIRS:
                yield from sums()
                held = 0
        if held:
            yield from sums()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merged_sides(batches, size)

    # A frequent word has a list of each flush of each task, which together grow with the input: they are added one by one, never held.
    n = common.partitions(coded.sparkSession)
    near = coded.mapInArrow(run, "w int, before boolean, other binary, n binary").repartition(n, "w").sortWithinPartitions("w")
    return common.written(near.mapInArrow(merge, "w int, other binary, n binary, before binary"), "neighbours")


def _near(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """w, and of each neighbour: row, other, n, before."""
    read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in b.column(name)]
    other = read("other", np.int32)
    rows = np.repeat(np.arange(b.num_rows), [len(x) for x in other])
    none = np.zeros(0, np.int64)
    return b.column("w").to_numpy(), rows, np.concatenate([none, *other]), np.concatenate([none, *read("n", np.int64)]).astype(np.float64), np.concatenate([none.astype(bool), *read("before", bool)])


def gains(m: np.ndarray, totals: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, n: np.ndarray, a: np.ndarray) -> np.ndarray:
    """How much the likelihood rises if a word of class a goes to each exchange class (rows: words; 0 for a itself).

    m: transitions between classes; totals: tokens of each; right, left: a word's transitions to and from each class but
    itself; own: to itself; n: its tokens.
    """
    words, k = len(a), CLASSES
    row, at = np.arange(words), np.arange(k)
    logs = _logs(m)
    out = np.zeros((words, k))
    for x in range(words):
        c = np.flatnonzero(right[x])
        out[x] += (_logs(m[:k, c] + right[x, c]) - logs[:k, c]).sum(1) if len(c) else 0
        c = np.flatnonzero(left[x])
        out[x] += (_logs(m[c, :k].T + left[x, c]) - logs[c, :k].T).sum(1) if len(c) else 0
    fall = (_logs(m[a] - right) - logs[a]).sum(1) + (_logs(m[:, a].T - left) - logs[:, a].T).sum(1)
    out += fall[:, None]
    # The four cells of a and b changed twice.
    ra, la, rb, lb = right[row, a][:, None], left[row, a][:, None], right[:, :k], left[:, :k]
    aa, bb, ab, ba = m[a, a][:, None], m[at, at][None, :], m[a][:, :k], m[:k, a].T
    change = lambda cell, by: _logs(cell + by) - _logs(cell)
    out -= change(ba, ra) + change(bb, rb) + change(ab, la) + change(bb, lb) + change(aa, -ra) + change(ab, -rb) + change(aa, -la) + change(ba, -lb)
    s = own[:, None]
    out += change(aa, -ra - la - s) + change(bb, rb + lb + s) + change(ab, la - rb) + change(ba, ra - lb)
    t = totals[:k][None, :]
    out -= 2 * (change(t, n[:, None]) + change(totals[a][:, None], -n[:, None]))
    out[row, a] = 0
    return out


def transitions(near: DataFrame, of: np.ndarray) -> np.ndarray:
    """Transitions between classes that a clustered word is part of; of: the class of each symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(ALL * ALL)
        for b in batches:
            w, rows, other, n, before = _near(b)
            # A pair of clustered words is with both; it counts where it is the one before.
            some = ~before | (other >= len(of) - ALL)
            x, y = of[w[rows[some]]], of[other[some]]
            m += np.bincount(np.where(before[some], y * ALL + x, x * ALL + y), weights=n[some], minlength=ALL * ALL)
        cells = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(m[cells].astype(np.int64))], ["cell", "n"])

    out = np.zeros(ALL * ALL)
    for r in near.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(ALL, ALL)


def _symbol_classes(classes: np.ndarray) -> np.ndarray:
    return np.concatenate([classes, np.arange(ALL)])


def first_classes(near: DataFrame, v: Vocabulary) -> np.ndarray:
    """The most frequent words have a class each; another has that of the one which precedes it most, or one by its rank."""
    out = np.arange(v.head) % CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, rows, other, n, before = _near(b)
            some = before & (other < CLASSES)
            r, o, c = rows[some], other[some], n[some]
            order = np.lexsort((o, -c, r))
            r, o = r[order], o[order]
            first = np.flatnonzero(np.diff(r, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(w[r[first]].astype(np.int32)), pa.array(o[first].astype(np.int32))], ["w", "class"])

    for r in near.mapInArrow(run, "w int, class int").collect():  # at most HEAD rows
        if r["w"] >= CLASSES:
            out[r["w"]] = r["class"]
    return out


def likelihood(m: np.ndarray, totals: np.ndarray) -> float:
    """What exchange raises: the part of the log-likelihood that depends on the classes."""
    return float(_logs(m).sum() - 2 * _logs(totals[:CLASSES]).sum())


def exchanged(near: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """The class of each clustered word, and the likelihood before each round and after the last."""
    classes, counts = first_classes(near, v), v.counts.astype(np.float64)
    best_classes, course = classes, []
    for turn in range(rounds + 1):
        of = _symbol_classes(classes)
        m, totals = transitions(near, of), np.bincount(classes, weights=counts, minlength=ALL)
        course.append(likelihood(m, totals))
        if course[-1] == max(course):
            best_classes = classes.copy()
        if turn == rounds:
            break

        def run(batches: Iterator[pa.RecordBatch], of: np.ndarray = of, m: np.ndarray = m, totals: np.ndarray = totals, turn: int = turn) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    w, rows, other, n, before = _near(b.slice(at, 256))
                    own = np.bincount(rows, weights=n * ((other == w[rows]) & ~before), minlength=len(w))
                    n = np.where(other == w[rows], 0, n)
                    cell = rows * ALL + of[other]
                    left = np.bincount(cell, weights=n * before, minlength=len(w) * ALL).reshape(-1, ALL)
                    right = np.bincount(cell, weights=n * ~before, minlength=len(w) * ALL).reshape(-1, ALL)
                    mine = np.flatnonzero(w % PARTS == turn % PARTS)
                    if len(mine):
                        a = of[w[mine]]
                        g = gains(m, totals, right[mine], left[mine], own[mine], counts[w[mine]], a)
                        best = g.argmax(1)
                        moved = np.flatnonzero(g[np.arange(len(mine)), best] > 1e-6)
                        yield pa.RecordBatch.from_arrays([pa.array(w[mine[moved]].astype(np.int32)), pa.array(best[moved].astype(np.int32))], ["w", "class"])

        for r in near.mapInArrow(run, "w int, class int").collect():  # at most HEAD rows
            classes[r["w"]] = r["class"]
    return best_classes, course


# The model


class Model:
    """Log10 probabilities of classes in contexts (rows: exchange classes, then the end mark) and of words in their classes."""

    def __init__(self, v: Vocabulary, classes: np.ndarray, m: np.ndarray):
        self.of, self.documents, self.tokens, self.types = classes, v.documents, v.tokens, v.types
        size = np.bincount(classes, weights=v.counts, minlength=ALL).astype(np.float64)
        size[BAND:] = v.band_tokens
        members = size > 0
        members[END], members[UNKNOWN] = v.documents > 0, True
        share = np.where(members, m.sum(0) + 0.5, 0)
        share /= share.sum()
        # Transitions go to classes with members only, but a left-out occurrence may fall into a band without.
        m = np.where(members, m, 0)
        row, kinds = m.sum(1, keepdims=True), (m > 0).sum(1, keepdims=True)
        p = np.where(row > 0, (np.maximum(m - DISCOUNT, 0) + DISCOUNT * kinds * share) / np.maximum(row, 1), share)
        with np.errstate(divide="ignore"):
            self.transition, self.size = np.log10(p), np.log10(np.maximum(size, 1))

    def scores(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: log10 probability by the model, and by the base."""
        classes = block.classes(self.of, False)
        emitted = np.where((classes == END) | (classes == UNKNOWN), 0, np.log10(np.maximum(block.n, 1)) - self.size[classes])
        return self.transition[block.contexts(classes), classes] + emitted, np.log10((block.n + 1) / (self.tokens + self.types + 1))


def fitted(coded: DataFrame, v: Vocabulary, classes: np.ndarray) -> Model:
    documents = v.documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(ALL * ALL, np.int64)
        for block in _each(batches, documents):
            c = block.classes(classes, True)
            some = block.train
            m += np.bincount(block.contexts(c)[some] * ALL + c[some], minlength=ALL * ALL)
        cells = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(m[cells])], ["cell", "n"])

    m = np.zeros(ALL * ALL)
    for r in coded.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        m[r["cell"]] = r["n"]
    return Model(v, classes, m.reshape(ALL, ALL))


def coded_blocks(docs: DataFrame, head: int = HEAD) -> tuple[DataFrame, Vocabulary]:
    """Blocks with the counts (n, int64) and ranks (int32, -1: not clustered) of their words, and the vocabulary."""
    blocks = common.written(encoded(docs), "blocks")
    words = counted(blocks)
    v = Vocabulary(blocks, words, head)
    clustered = pa.array(v.words, pa.string())
    out = pa.schema([("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("codes", pa.binary()), ("n", pa.binary()), ("rank", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                listed, known = b.column("words")[k].values, b.column("known")[k]
                n = np.zeros(len(listed), np.int64)
                for x in known.values if known.is_valid else ():
                    n[np.frombuffer(x["at"].as_buffer(), np.int32)] = np.frombuffer(x["n"].as_buffer(), np.int64)
                rank = pa.compute.index_in(listed, clustered).fill_null(-1).to_numpy().astype(np.int32)
                yield common.as_batch(out, [b.column("doc_ids").slice(k, 1), b.column("sizes").slice(k, 1), b.column("codes").slice(k, 1), [n.tobytes()], [rank.tobytes()]])

    known = words.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("at", "n")).alias("known"))
    joined = blocks.select("block", "doc_ids", "sizes", "codes", "words").join(known, "block", "left")
    coded = common.written(joined.mapInArrow(run, "doc_ids array<long>, sizes array<long>, codes binary, n binary, rank binary"), "coded")
    common.dropped(blocks, words)
    return coded, v


def scored(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    coded, v = coded_blocks(docs, head)
    classes = exchanged(neighbours(coded, v), v, rounds)[0] if v.head else np.zeros(0, np.int64)
    model = fitted(coded, v, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _each(batches, model.documents):
            score, base = model.scores(block)
            starts = block.ends + 1 - block.sizes
            yield common.as_batch(SCORES, [block.doc_ids, block.held, block.sizes, np.add.reduceat(block.n > 0, starts, dtype=np.int64), np.full(len(starts), model.tokens), np.add.reduceat(base, starts), np.add.reduceat(score, starts)])

    return coded.mapInArrow(run, SCORES_DDL)


def op11_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.table(spark, sf_dir, "documents"))
