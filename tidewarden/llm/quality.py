"""Quality of documents by co-training.

Method: two logistic classifiers with separate views, the text's content and the page's metadata (language, source, length,
and host, suffix and depth of the url of the page with the document's id). In each round each view labels the
documents without a label that it is confident of, and the other view is fitted again on the labels and on what it was
taught. Each view is then calibrated on labelled rows that took no part in its fit, and the calibrated log-odds are
added for the final score of every document.

Fits are Newton steps whose sums (a matrix of the number of features) are formed over all rows in the cluster, so no
sample is drawn and the driver holds a few thousand numbers, whatever the input.

Edge cases: a null or empty text has the content features of no words; rows without a doc_id have no label and no page;
several labels or pages of one id count as the least quality and the least page; repeated rows are scored alike; without labels
of both classes every score is 0.5; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import common

#: Rounds of exchange, probability at which a view teaches, weight of a taught label, Newton steps, ridge, decision.
ROUNDS, CONFIDENT, TAUGHT, NEWTON, RIDGE, LIMIT = 2, 0.95, 0.3, 6, 1.0, 0.5
#: Numbers of features into which metadata values are hashed.
META = 64
CONTENT = ("words", "mean_length", "long_words", "symbols", "digits", "upper", "exclaim", "pipes", "punctuation", "lines", "line_repeats", "distinct", "top_word", "bigram_repeats", "stop_words", "short_words", "entropy", "line_length")
#: Frequent short words of the corpus' languages.
STOP_WORDS = frozenset("the of and to in is that it for as with de la le et les des en un une que los las el y der die das und ist den von zu mit".split())
_SYMBOL = re.compile(r"[#$%&*^~|<>{}\[\]\\_=+@/]")


def content_features(text: str) -> list[float]:
    """Numbers of about unit size that describe a text's form; each looks at the whole text."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(CONTENT)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))  # noqa: B905
    letters = Counter(text)
    p = np.fromiter(letters.values(), float) / chars
    lowered = [w.lower().strip(".,!?;:%*&$#") for w in words]
    return [
        np.log1p(n) / 5,
        sum(map(len, words)) / n / 8,
        sum(len(w) > 14 for w in words) / n,
        5 * len(_SYMBOL.findall(text)) / chars,
        5 * sum(c.isdigit() for c in text) / chars,
        sum(c.isupper() for c in text) / chars * 2,
        10 * text.count("!") / chars,
        20 * text.count("|") / chars,
        10 * sum(text.count(c) for c in ".,;:?") / chars,
        np.log1p(len(lines)) / 3,
        1 - len(set(lines)) / len(lines),
        len(counts) / n,
        max(counts.values()) / n * 3,
        1 - len(pairs) / max(1, n - 1),
        sum(w in STOP_WORDS for w in lowered) / n,
        sum(len(w) <= 2 for w in words) / n,
        float(-(p @ np.log2(p))) / 5,
        np.log1p(chars / max(1, len(lines))) / 6,
    ]


def views(docs: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, y (1 good, 0 bad, null unknown), fold (0, 1, or 2 for calibration), text_view and meta_view of each row."""
    y = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("y"))
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    page = pages.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias("_id")).agg(F.min("url").alias("url"))
    page = page.select("_id", host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"), F.size(F.split("url", "/")).alias("depth"))
    facts = y.join(page, "_id", "full")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches, limit=2 << 20):
            x = np.array([content_features(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(CONTENT)).cast(pa.list_(pa.float64()))], ["doc_id", "lang", "source", "n", "text_view"])

    # Features replace the text before the join, so no text is shuffled.
    seen = slim.mapInArrow(run, "doc_id long, lang string, source string, n int, text_view array<double>")
    both = seen.join(facts, F.col("doc_id") == F.col("_id"), "left")
    values = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("lang", "source", "host", "suffix", "depth")]
    buckets = [F.pmod(F.xxhash64(v), F.lit(META)) for v in values] + [F.pmod(F.xxhash64(F.concat(F.lit("n="), F.floor(F.log2(F.col("n") + 1)).cast("string"))), F.lit(META))]
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)).cast("int")
    return both.select("doc_id", F.col("y").cast("double").alias("y"), fold.alias("fold"), "text_view", F.array(*[b.cast("int") for b in buckets]).alias("meta_view"))


def _matrix(b: pa.RecordBatch, column: str) -> np.ndarray:
    """The view's features and a constant."""
    lists = b.column(b.schema.get_field_index(column))
    flat = lists.flatten().to_numpy()
    if column == "text_view":
        x = flat.reshape(b.num_rows, len(CONTENT))
    else:
        x = np.zeros((b.num_rows, META))
        np.add.at(x, (np.repeat(np.arange(b.num_rows), len(flat) // max(1, b.num_rows)), flat), 1.0)
    return np.column_stack([x, np.ones(b.num_rows)])


def _p(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def _summed(rows: DataFrame, each, size: int) -> np.ndarray:
    """The sum over all rows of each(batch), an array of `size` numbers; sums of tasks are added in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += each(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["cell", "n"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def fitted(rows: DataFrame, view: str, beta: np.ndarray, teacher: tuple[str, np.ndarray] | None, steps: int = NEWTON) -> np.ndarray:
    """Newton steps on labels of folds 0 and 1 and on what the teacher (view, coefficients) is confident of."""
    d = len(beta)
    penalty = np.diag([RIDGE] * (d - 1) + [1e-3])
    for _ in range(steps):

        def each(b: pa.RecordBatch, beta=beta) -> np.ndarray:
            y = b.column(b.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(float)
            fold = b.column(b.schema.get_field_index("fold")).to_numpy()
            w = np.where(np.isnan(y), 0.0, (fold < 2) * 1.0)
            if teacher is not None:
                q = _p(_matrix(b, teacher[0]), teacher[1])
                taught = np.isnan(y) & ((q >= CONFIDENT) | (q <= 1 - CONFIDENT))
                w = np.where(taught, TAUGHT, w)
                y = np.where(taught, (q >= 0.5) * 1.0, y)
            x, y = _matrix(b, view)[w > 0], y[w > 0]
            w = w[w > 0]
            p = _p(x, beta)
            return np.concatenate([((x * (w * p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (w * (y - p))])

        total = _summed(rows, each, d * d + d)
        step = np.linalg.solve(total[: d * d].reshape(d, d) + penalty, total[d * d :] - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def calibration(rows: DataFrame, betas: dict[str, np.ndarray], steps: int = NEWTON) -> np.ndarray:
    """Coefficients of the two views' log-odds and a constant, on labels of fold 2."""
    c = np.array([0.5, 0.5, 0.0])
    for _ in range(steps):

        def each(b: pa.RecordBatch, c=c) -> np.ndarray:
            y = b.column(b.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(float)
            keep = ~np.isnan(y) & (b.column(b.schema.get_field_index("fold")).to_numpy() == 2)
            x = np.column_stack([*(np.clip(_matrix(b, v) @ beta, -30, 30) for v, beta in betas.items()), np.ones(b.num_rows)])[keep]
            p = _p(x, c)
            return np.concatenate([((x * (p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (y[keep] - p)])

        total = _summed(rows, each, 12)
        c = c + np.linalg.solve(total[:9].reshape(3, 3) + np.eye(3) * 1e-2, total[9:])
    return c


def scored(docs: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, text_score, meta_score, score (probability of good quality) and keep of each row."""
    rows = common.written(views(docs, labels, pages), "views")
    # Views at hand of each class outside calibration, and within it.
    classes = {(r["y"], r["cal"]) for r in rows.where("y IS NOT NULL").groupBy("y", (F.col("fold") == 2).alias("cal")).count().collect()}
    if not {(0.0, False), (1.0, False)} <= classes:
        return rows.select("doc_id", *(F.lit(0.5).alias(c) for c in ("text_score", "meta_score", "score")), F.lit(1).alias("keep"))
    text = fitted(rows, "text_view", np.zeros(len(CONTENT) + 1), None)
    meta = fitted(rows, "meta_view", np.zeros(META + 1), None)
    for _ in range(ROUNDS):
        text, meta = fitted(rows, "text_view", text, ("meta_view", meta), 3), fitted(rows, "meta_view", meta, ("text_view", text), 3)
    betas = {"text_view": text, "meta_view": meta}
    c = calibration(rows, betas) if {(0.0, True), (1.0, True)} <= classes else np.array([1.0, 1.0, 0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odds = [np.clip(_matrix(b, v) @ beta, -30, 30) for v, beta in betas.items()]
            score = _p(np.column_stack([*odds, np.ones(b.num_rows)]), c)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(1 / (1 + np.exp(-o))) for o in odds), pa.array(score), pa.array((score >= LIMIT).astype(np.int32))], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return rows.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep int")


def op6_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(*(common.table(spark, sf_dir, t) for t in ("documents", "labels", "pages")))
