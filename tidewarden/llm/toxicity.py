"""Toxicity of documents whose words may be disguised.

Method: noisy channel. A disguised token is a lattice of characters: leetspeak signs may stand for letters, separators
between letters and repeated letters may be noise, single letters in a row may be words that were spaced out, with
boundaries anywhere. Signs without a letter are decoded too. Viterbi decoding under a character trigram model of the
whole corpus restores the word, in time linear in the token's length. The restored text is scored by
log-odds of its words and word beginnings between labelled toxic and other texts, and a logistic function of the
strongest of them gives the score.

The character model counts all words of all documents. Log-odds and the logistic function are fitted on at most
SAMPLE labelled texts of each class (each distinct text once, chosen by hash); classes are weighted to their shares.

Edge cases: a null or empty text has no words and the lowest score; repeated rows are scored alike; a null doc_id counts
as the text ''; rows whose label is null teach nothing; without labels of both classes every score is 0; an empty
table gives no rows. Labels, lang, source and doc_id are no inputs of a score; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import common

#: Labelled texts of each class that fit the classifier; strongest words of a document that count; decision.
SAMPLE, TOP, LIMIT = 10_000, 5, 0.3
#: Toxic texts that must have a feature for it to count, other texts that it is taken to be in besides those it is in,
#: and log-odds below which it doesn't count.
LEAST, PRIOR, LEAN = 5, 1.0, 3.0
#: Bytes of restored words that a task keeps.
CACHE = 16 << 20
#: The column that marked() adds.
MARK = "_tidewarden_toxic"
#: The alphabet of the character model; 0 is a word's edge, 1 any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
CODE = {c: i + 2 for i, c in enumerate(LETTERS)}
SIZE = len(LETTERS) + 2
#: Signs and the letters they may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l"}
#: Costs in nats: a sign read as a letter, a sign or separator as noise, a masked letter, a repeated letter as noise.
SIGN, DROP_SIGN, DROP, MASK, REPEAT = 0.5, 6.0, 0.5, 1.0, 0.3
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¿¡…“”‘’—–"
TWICE, RUN = re.compile(r"(.)\1"), re.compile(r"(.)\1+")
MASKS = "*#%?"
#: Words that need no decoding: letters, none of them doubled (longer alternatives are left to TWICE).
PLAIN, DOUBLE = r"^[a-zß-öø-ÿœ]*$", "|".join(c * 2 for c in LETTERS)


def char_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities [a, b, c] of letter c after a and b: trigrams interpolated with bigrams and letters."""
    two, one = counts.sum(axis=0), counts.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (counts + 10 * p2[None]) / (counts.sum(axis=2, keepdims=True) + 10)
    return np.log(p3).astype(np.float32)


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """Letter trigrams of all words of all documents, by how often each word occurs."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches):
            flat = pc.ascii_split_whitespace(pc.utf8_lower(b.column(0))).flatten()
            found = pc.value_counts(flat)
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3)
        table = np.zeros(0x250, np.int64)
        for c, i in CODE.items():
            table[ord(c)] = i
        for b in batches:
            kept = [(s, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (s := w.strip(EDGES)).isalpha()]
            if not kept:
                continue
            codes = np.frombuffer("\0".join(["", "", *(f"{s}\0" for s, _ in kept)]).encode("utf-32-le"), "<u4").astype(np.int64)
            edge = codes == 0
            x = np.where(codes < 0x250, table[np.minimum(codes, 0x24F)], 1)
            x = np.where(edge, 0, np.where(x == 0, 1, x))
            owner = np.cumsum(edge & np.roll(edge, 1))  # words are two edges apart
            weight = np.concatenate([[0.0], [n for _, n in kept], [0.0, 0.0]])
            live = np.flatnonzero(~(edge[2:] & edge[1:-1])) + 2
            total += np.bincount((x[live - 2] * SIZE + x[live - 1]) * SIZE + x[live], weights=weight[np.minimum(owner[live], len(kept))], minlength=SIZE**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counted.mapInArrow(trigrams, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE**3)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.reshape(SIZE, SIZE, SIZE)


def longest_mask(model: np.ndarray) -> int:
    """Signs of a run of MASKS that can matter. Reading one as a letter costs over MASK - REPEAT more than dropping it and gains
    at most the costs of the letters next to it, so the best reading of a longer run drops what is over this number."""
    return int(5 * -float(model.min()) / (MASK - REPEAT)) + 1


def _mask_step(states: dict, model: np.ndarray, drop: float) -> dict:
    """What the general step does for a masked letter, for many states at once."""
    score, nodes = np.full((SIZE, SIZE), -np.inf), {}
    for (a, b), (x, node) in states.items():
        score[a, b], nodes[a, b] = x, node
    letters = slice(2, 28)
    all_ = score[:, :, None] - MASK + model[:, :, letters]
    best = all_.argmax(axis=0)
    value = np.take_along_axis(all_, best[None], axis=0)[0]
    after = {key: (x - drop, node) for key, (x, node) in states.items()}
    for b, k in zip(*(v.tolist() for v in np.nonzero(value > -np.inf)), strict=True):
        x = float(value[b, k])
        if (b, k + 2) not in after or x > after[b, k + 2][0]:
            after[b, k + 2] = (x, (nodes[int(best[b, k]), b], LETTERS[k]))
    return after


def decode(token: str, model: np.ndarray, split: bool = False) -> str:
    """The most likely word behind a lower-case token; split: words, as blanks may have been left out between letters.

    Time is linear in the token: a path is a chain of back-pointers, and runs of masks count up to longest_mask().
    """
    most = longest_mask(model)
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before, masks = "", 0
    for c in token:
        masks = masks + 1 if c in MASKS else 0
        if masks > most:
            continue
        options = []  # (letter or '', cost)
        if c.isalpha():
            options.append((c, 0.0))
            if c == before:
                options.append(("", REPEAT))
        else:
            options += [(x, SIGN) for x in LEET.get(c, "")]
            if masks:
                options += [(x, MASK) for x in LETTERS[:26]]
            options.append(("", REPEAT if c == before or masks > 1 else DROP_SIGN if c in LEET and c not in "!|(" else DROP))
        before = c
        if split:  # a word may end here
            ends = [(score + float(model[a, b, 0]), (node, " ")) for (a, b), (score, node) in states.items() if (a, b) != (0, 0)]
            if ends:
                states[0, 0] = max(ends, key=lambda x: x[0])
        if len(options) == 1 and not options[0][0]:
            continue  # the same cost for all
        if masks and len(states) > 40:
            states = _mask_step(states, model, options[-1][1])
            continue
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, node) in states.items():
            for letter, cost in options:
                if letter:
                    k = CODE.get(letter, 1)
                    key, new = (b, k), (score - cost + float(model[a, b, k]), (node, letter))
                else:
                    key, new = (a, b), (score - cost, node)
                if key not in after or new[0] > after[key][0]:
                    after[key] = new
        states = after
    node, out = max(states.items(), key=lambda x: x[1][0] + float(model[x[0][0], x[0][1], 0]))[1][1], []
    while node:
        node, letter = node
        out.append(letter)
    return "".join(reversed(out))


def collapsed(word: str, model: np.ndarray) -> str:
    """decode() of a word of letters alone: only repeated letters may be noise, and each run of them is a choice of its own."""

    def kept(m: re.Match) -> str:
        x, at, end = m[1], m.start(), m.end()
        p, k, n = CODE.get(word[at - 1], 1) if at else 0, CODE.get(x, 1), CODE.get(word[end], 1) if end < len(word) else 0
        long = end - at
        one = (long - 1) * -REPEAT + float(model[p, k, n])
        more = float(model[p, k, k]) + float(model[k, k, n]) + (long - 2) * max(-REPEAT, float(model[k, k, k]))
        return x if one >= more else x * (2 if -REPEAT >= float(model[k, k, k]) else long)

    return RUN.sub(kept, word)


def restore(token: str, model: np.ndarray) -> str:
    """A lower-case chunk between white space as a word: without punctuation around it, and decoded if disguised.

    A single sign at an end may be punctuation or a letter; both readings are given, with a blank between them.
    """
    core = token.strip(EDGES)
    if not core:
        return core
    # Signs alone may be a word if three or more of them can be letters; numbers are read as they are, too.
    if not any(c.isalpha() for c in core):
        return f"{core} {decode(core, model)}".strip() if sum(c in LEET for c in core) >= 3 else core
    word = collapsed(core, model) if core.isalpha() else decode(core, model)
    if word != core and core.isalpha():  # the model may take a real double letter for noise, so both readings count
        word = f"{core} {word}"
    at = token.find(core)
    before, after = token[:at], token[at + len(core) :]
    first = before[-1:] if before[-1:] in LEET and before[-2:-1] != before[-1:] else ""
    last = after[:1] if after[:1] in LEET and after[1:2] != after[:1] else ""
    if first or last:
        other = decode(first + core + last, model)
        return word if other in word.split(" ") else f"{word} {other}"
    return word


def segmented(letters: str, model: np.ndarray) -> str:
    """The words that a run of single letters may be: the likeliest boundaries, and the run without some of its ends."""
    words = decode(letters, model, True).split()
    # A one-letter word beside a spaced-out word.
    words += [decode(part, model) for part in (letters[1:], letters[:-1], letters[1:-1]) if len(part) > 2]
    return " ".join(dict.fromkeys(words))


def features_of(word: str) -> list[str]:
    """Each reading of a word and its beginnings."""
    return [f for w in word.split(" ") for f in (w, *(f"^{w[:k]}" for k in range(3, 9) if len(w) > k))]


class Reader:
    """Restored words of batches of texts; restored words are kept over the batches of a task up to CACHE bytes."""

    def __init__(self, model: np.ndarray):
        self.model, self.known, self.held = model, {}, 0

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(row, number of word) pairs, and the words, one for each number."""
        if self.held > CACHE:
            self.known, self.held = {}, 0
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        flat = lists.flatten().dictionary_encode()
        chunks = flat.dictionary
        core = pc.utf8_trim(chunks, characters=EDGES)
        # A sign beside a word may be one of its letters; words of letters without it are as they are.
        edge = pc.and_(pc.not_equal(chunks, core), pc.match_substring_regex(chunks, "[" + re.escape("".join(c for c in LEET if c in EDGES)) + "]"))
        plain = pc.and_not(pc.and_not(pc.match_substring_regex(core, PLAIN), pc.match_substring_regex(core, DOUBLE)), edge).to_numpy(zero_copy_only=False)
        words = core.to_numpy(zero_copy_only=False).tolist()
        other = np.flatnonzero(~plain)
        for k, c in zip(other.tolist(), chunks.take(pa.array(other)).to_pylist(), strict=True):
            words[k] = self._word(c)
        index = flat.indices.to_numpy(zero_copy_only=False)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
        # Words that were spaced out: three or more single letters or signs in a row.
        single = np.zeros(len(chunks), bool)
        for k in np.flatnonzero(pc.less_equal(pc.utf8_length(chunks), 2).to_numpy(zero_copy_only=False)).tolist():
            c = chunks[k].as_py()
            single[k] = len(c) == 1 and (c.isalpha() or c in LEET) or len(c) == 2 and c[0].isalpha() and c[1] in ".-_*"
        ones = np.flatnonzero(single[index]) if len(chunks) else np.zeros(0, np.int64)
        more_rows, more = [], []
        if len(ones):
            cut = np.flatnonzero((np.diff(ones) != 1) | (np.diff(rows[ones]) != 0)) + 1
            for run in np.split(ones, cut):
                if len(run) >= 3:
                    letters = "".join(chunks[k].as_py() for k in index[run].tolist())
                    more_rows += [rows[run[0]]] * 2
                    more += [len(words), len(words) + 1]
                    words += [self._word(letters), self._word(letters, True)]
        return np.concatenate([rows, np.array(more_rows, np.int64)]), np.concatenate([index.astype(np.int64), np.array(more, np.int64)]), words

    def _word(self, chunk: str, run: bool = False) -> str:
        """A chunk's word, or the words that a run of single letters may be."""
        key = f"{chunk} " if run else chunk  # no chunk has a blank
        word = self.known.get(key)
        if word is None:
            word = segmented(chunk, self.model) if run else restore(chunk, self.model)
            if self.held <= CACHE:
                self.known[key] = word
                self.held += 200 + len(key) + len(word)
        return word


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most `size` labelled distinct texts of each class that aren't held out: doc_id, toxic, fit, weight."""
    hashes = docs.select("doc_id", F.xxhash64("text").alias("h"))
    known = labels.select("doc_id", "toxic").where("toxic IS NOT NULL").where(~held_out()).join(hashes, "doc_id")
    # Copies of a text count once; copies that disagree are left out.
    texts = known.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).where("toxic = high").drop("high")
    texts = common.written(texts, "labelled-texts")
    parts = []
    for toxic in (0, 1):
        mine = texts.where(F.col("toxic") == toxic)
        n = mine.count()
        if not n:
            return texts.where("false").select("doc_id", "toxic", F.lit(True).alias("fit"), F.lit(1.0).alias("weight"))
        few = mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        parts.append(few.select("doc_id", "toxic", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 3).alias("fit"), F.lit(max(1.0, n / size)).alias("weight")))
    return common.written(parts[0].unionByName(parts[1]), "sample")


def strongest(rows: np.ndarray, numbers: np.ndarray, weights: np.ndarray, n: int, top: int = TOP) -> np.ndarray:
    """For n rows: the greatest, the sum of the `top` greatest weights, and the number of distinct words of weight > 0."""
    w = weights[numbers]
    keep = w > 0
    pair = np.unique(np.column_stack([rows[keep], numbers[keep]]), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
    out = np.zeros((n, 3))
    if len(pair):
        value = weights[pair[:, 1]]
        order = np.lexsort((-value, pair[:, 0]))
        row, value = pair[order, 0], value[order]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(starts, append=len(row)))
        out[row[starts], 0] = value[starts]
        np.add.at(out[:, 1], row[rank < top], value[rank < top])
        np.add.at(out[:, 2], row, 1)
        out[:, 2] = np.log1p(out[:, 2])
    return out


def weigh(words: list[str], table: dict[str, float]) -> np.ndarray:
    """The greatest weight of each word's features (see features_of)."""
    out = np.zeros(len(words))
    if not table or not words:
        return out
    lists = pc.split_pattern(pa.array(words, pa.string()), " ")
    parts, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    names, weights = pa.array(list(table), pa.string()), np.append(np.array(list(table.values())), 0.0)
    long = pc.utf8_length(parts).to_numpy()

    def add(features: pa.Array, who: np.ndarray) -> None:
        at = pc.fill_null(pc.index_in(features, names), len(names)).to_numpy()
        some = np.flatnonzero(at < len(names))
        np.maximum.at(out, who[some], weights[at[some]])

    add(parts, owner)
    for k in range(3, 9):
        some = np.flatnonzero(long > k)
        add(pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(parts.take(pa.array(some)), 0, k), ""), owner[some])
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients and, last, the intercept, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, size: int = SAMPLE) -> tuple[dict[str, float], np.ndarray] | None:
    """Log-odds of features, learned on one part of the sample, and the logistic function, fitted on the other."""
    chosen = sample(docs, labels, size)
    # At most 2 * size rows of four numbers: 10,000 each are under 1 MB.
    picked = common.written(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", "fit", "weight"), "sample-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in common.steps(batches):
            rows, numbers, words = reader.read(b.column(0))
            toxic = b.column(1).to_pylist()
            seen: list = [set() for _ in toxic]
            for r, k in np.unique(np.column_stack([rows, numbers]), axis=0).tolist():
                if w := words[k]:
                    seen[r].update(features_of(w))
            total: dict = defaultdict(lambda: [0, 0])
            for t, s in zip(toxic, seen, strict=True):
                for f in s:
                    total[f][1 if t else 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v[1] for v in total.values()], pa.int64()), pa.array([v[0] for v in total.values()], pa.int64())], ["feature", "t", "n"])

    sizes = {(r["toxic"], r["fit"]): r["n"] for r in chosen.groupBy("toxic", "fit").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(sizes.get((t, f)) for t in (0, 1) for f in (True, False)):
        return None
    big_t, big_n = sizes[1, True], sizes[0, True]
    odds = F.log(((F.col("t") + 0.5) / (big_t + 1)) / ((F.col("n") + PRIOR) / (big_n + PRIOR)))
    found = picked.where("fit").select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "feature string, t long, n long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    # Features of a bounded sample that lean to the toxic side.
    table = {r["feature"]: r["w"] for r in found.where(F.col("t") >= LEAST).select("feature", odds.alias("w")).where(F.col("w") > LEAN).collect()}

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in common.steps(batches):
            rows, numbers, words = reader.read(b.column(0))
            x = strongest(rows, numbers, weigh(words, table), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2]), b.column(1), b.column(2)], ["a", "b", "c", "toxic", "weight"])

    got = picked.where("NOT fit").select("text", F.col("toxic").cast("int").alias("toxic"), "weight").mapInArrow(values, "a double, b double, c double, toxic int, weight double").toArrow()
    x = np.column_stack([got.column(k).to_numpy() for k in range(3)])
    return table, logistic(x, got.column("toxic").to_numpy().astype(float), got.column("weight").to_numpy())


def classifier(docs: DataFrame, labels: DataFrame, size: int = SAMPLE):
    """A function from an Arrow array of texts to scores (made once in each task), or None without labels of both classes."""
    model = char_model(corpus_counts(docs))
    fitted = fit(docs, labels, model, size)
    if fitted is None:
        return None
    table, beta = fitted

    def made():
        reader = Reader(model)

        def scores(texts: pa.Array) -> np.ndarray:
            rows, numbers, words = reader.read(texts)
            x = strongest(rows, numbers, weigh(words, table), len(texts))
            return 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -700, 700)))

        return scores

    return made


def scored(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    docs = common.texts(docs)
    made = classifier(docs, labels, size)
    if made is None:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = made()
        for b in common.steps(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1)))], ["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def marked(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """docs with a column MARK (1: toxic): the rows pass through with their scores, so nothing is shuffled."""
    made = classifier(common.texts(docs), labels, size)
    if made is None:
        return docs.withColumn(MARK, F.lit(0))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = made()
        for texts in batches:
            parts = [scores(b.column(0)) for b in common.steps(iter([pa.RecordBatch.from_arrays([texts], ["text"])]))]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(MARK, (score(F.coalesce("text", F.lit(""))) >= LIMIT).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
