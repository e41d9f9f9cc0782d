"""Mixing sources to target weights, in DataFrame functions only.

Method: hierarchical budgeting. Weights go down a tree of domain, language and source. A node's budget is shared among
its children by weight, none above what its subtree can give (its tokens times the number of epochs): what a child
can't take goes to its siblings by weight, and only what all siblings can't take stays with the parent's own siblings.
Each leaf then takes whole epochs of its documents and a token-prefix of the next epoch's seeded order.

The shares of a group of siblings are min(capacity, level * weight) with one level per group, found exactly from the
siblings ordered by capacity/weight. A leaf's prefix ends at a threshold key: token sums of key buckets find the bucket
where it ends, so only that bucket's rows are ordered, and selection is a comparison with the leaf's threshold.

Edge cases: a null text counts no tokens; null domain, language or source is the leaf part ''; documents without tokens
go along with their place in the order; documents with one doc_id share their key and are taken together or not at
all; an empty table gives no rows; unknown weights take the default. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewarden.llm import common

LEAF = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Weights of nodes among their siblings (others: `other`), the budget as a share of all tokens, epochs and seed."""

    domains: dict[str, float] = field(default_factory=lambda: {"crawl": 0.5, "curated": 0.5})
    langs: dict[str, float] = field(default_factory=lambda: {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1})
    sources: dict[str, float] = field(default_factory=dict)
    other: float = 1.0
    budget: float = 0.6
    epochs: int = 2
    seed: int = 7


#: Sources whose pages come from crawls; the rest are curated collections.
CRAWLS = tuple(f"src{i}" for i in range(10))
BUCKET_DIGITS = 3


def tokens_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def leaf_of() -> dict[str, Column]:
    """The leaf of a document, from its columns source and lang."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return {"domain": F.when(source.isin(*CRAWLS), "crawl").otherwise("curated"), "lang": F.coalesce(F.col("lang"), F.lit("")), "source": source}


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source and n_tokens of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in leaf_of().items()), tokens_of(F.col("text")).alias("n_tokens"))


def weight_of(column: str, weights: dict[str, float], other: float) -> Column:
    out = F.lit(float(other))
    for k, v in weights.items():
        out = F.when(F.col(column) == k, float(v)).otherwise(out)
    return out


def shared(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `name`: each child's part of its parent's `budget`, min(capacity, level * weight).

    children: parent columns, budget, weight, capacity. The number of siblings is that of a tree's children, so the
    windows are short.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy("ratio", *[c for c in LEAF if c in children.columns])
    c = children.withColumn("ratio", F.col("capacity") / F.col("weight"))
    c = c.withColumn("below", F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    c = c.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # The level if exactly the children before this one are full. It is right for the first child that it doesn't fill,
    # and falls from there on, so the largest of those is the group's.
    c = c.withColumn("try", (F.col("budget") - F.coalesce("below", F.lit(0.0))) / F.col("rest"))
    c = c.withColumn("level", F.max(F.when(F.col("try") <= F.col("ratio"), F.col("try"))).over(by))
    share = F.when(F.col("level").isNull(), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.col("level") * F.col("weight")))
    return c.withColumn(name, F.greatest(share, F.lit(0.0))).drop("ratio", "below", "rest", "try", "level")


def budgets(rows: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, available, budget (whole tokens), full (whole epochs) and rest of each leaf."""
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("available"))
    leaves = common.written(leaves.withColumn("capacity", F.col("available").cast("double") * mix.epochs), "leaves")
    total = leaves.agg((F.coalesce(F.sum("available"), F.lit(0)) * F.lit(float(mix.budget))).alias("budget"))
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity")).where("capacity > 0").join(F.broadcast(total))
    domains = shared(domains.withColumn("weight", weight_of("domain", mix.domains, mix.other)), [], "given").select("domain", F.col("given").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).where("capacity > 0").join(domains, "domain")
    langs = shared(langs.withColumn("weight", weight_of("lang", mix.langs, mix.other)), ["domain"], "given").select("domain", "lang", F.col("given").alias("budget"))
    whole = leaves.where("capacity > 0").join(langs, ["domain", "lang"])
    whole = shared(whole.withColumn("weight", weight_of("source", mix.sources, mix.other)), ["domain", "lang"], "given")
    out = whole.select(*LEAF, "available", F.floor(F.col("given") + 1e-6).cast("long").alias("budget"))
    full = F.least(F.floor(F.col("budget") / F.col("available")), F.lit(mix.epochs)).cast("long")
    return out.withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("available"))


def key_of(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def thresholds(rows: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, full and last: documents with a key up to `last` in epoch `full` are in the prefix."""
    leaves = common.written(budgets(rows, mix), "budgets")
    keyed = rows.join(leaves.where("rest > 0"), [*LEAF]).select(*LEAF, "rest", "n_tokens", key_of(mix.seed, F.col("full")).alias("key"))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*LEAF, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    ordered = Window.partitionBy(*LEAF).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("n").over(ordered)).withColumn("before", F.col("upto") - F.col("n"))
    # The first bucket that doesn't fit as a whole is cut; the prefix has all buckets below.
    cut = sums.where("upto > rest").groupBy(*LEAF, "rest").agg(F.min(F.struct("bucket", "before")).alias("c")).select(*LEAF, F.col("c.bucket").alias("bucket"), F.col("c.before").alias("before"))
    rows_in = keyed.join(cut, [*LEAF, "bucket"])
    upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("key"))
    last = rows_in.withColumn("upto", upto).where("upto <= rest").groupBy(*LEAF).agg(F.max("key").alias("last"))
    both = leaves.join(cut.withColumnRenamed("bucket", "cut").drop("before"), [*LEAF], "left").join(last, [*LEAF], "left")
    # Keys below the cut bucket are in even if none of the bucket's own fits; no cut: the whole epoch fits.
    limit = F.when(F.col("rest") <= 0, F.lit("")).when(F.col("cut").isNull(), F.lit("g")).otherwise(F.coalesce("last", "cut"))
    return common.written(both.select(*LEAF, "full", limit.alias("last")), "thresholds")


def selected(rows: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """rows (with leaf columns and doc_id) once for each epoch that selects them, with a column epoch."""
    joined = rows.join(leaves, [*LEAF]).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    taken = (F.col("epoch") < F.col("full")) | ((F.col("epoch") < mix.epochs) & (F.col("last") != "") & (key_of(mix.seed, F.col("epoch")) <= F.col("last")))
    return joined.where(taken).drop("full", "last")


def selected_rows(docs: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """Whole rows of docs, once for each epoch that selects them, in the columns of docs.

    A row compares its key with its leaf's threshold; the table of leaves is as small as the tree, so no text is
    shuffled as long as it is under the broadcast limit, and the planner joins otherwise.
    """
    full = leaves.select(*(F.col(c).alias(f"_tidewarden_{c}") for c in LEAF), F.col("full").alias("_tidewarden_full"), F.col("last").alias("_tidewarden_last"))
    leaf = leaf_of()
    joined = docs.join(full, [leaf[c] == F.col(f"_tidewarden_{c}") for c in LEAF])
    joined = joined.withColumn("_tidewarden_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tidewarden_full"))))
    taken = (F.col("_tidewarden_epoch") < F.col("_tidewarden_full")) | ((F.col("_tidewarden_epoch") < mix.epochs) & (F.col("_tidewarden_last") != "") & (key_of(mix.seed, F.col("_tidewarden_epoch")) <= F.col("_tidewarden_last")))
    return joined.where(taken).select(*docs.columns)


def op8_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix, rows = Mix(), common.written(slim(common.table(spark, sf_dir, "documents")), "slim")
    return selected(rows, thresholds(rows, mix), mix).select("doc_id", *LEAF, "n_tokens", "epoch")


def _weights(column: str, weights: dict[str, float], other: float) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {float(v)}::DOUBLE" for k, v in weights.items()) + f" ELSE {float(other)}::DOUBLE END" if weights else f"{float(other)}::DOUBLE"


def _share(name: str, parent: str, columns: str) -> str:
    by = f"PARTITION BY {parent} " if parent else ""
    order = f"{by}ORDER BY capacity / weight, {columns}"
    return f"""
{name}_try AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM {name}_in),
{name}_level AS (SELECT *, max(CASE WHEN t <= capacity / weight THEN t END) OVER ({by}) AS level FROM {name}_try),
{name} AS (
  SELECT * EXCLUDE (budget), greatest(CASE WHEN level IS NULL THEN capacity ELSE least(capacity, level * weight) END, 0) AS budget FROM {name}_level)"""


def mixing_sql(mix: Mix | None = None) -> str:
    """DuckDB SQL for the selection from the view documents."""
    mix = mix or Mix()
    crawls = ", ".join(f"'{s}'" for s in CRAWLS)
    return f"""
WITH slim AS (
  SELECT doc_id, CASE WHEN coalesce(source, '') IN ({crawls}) THEN 'crawl' ELSE 'curated' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS available, sum(n_tokens)::DOUBLE * {mix.epochs} AS capacity FROM slim GROUP BY ALL),
d_in AS (
  SELECT domain, sum(capacity) AS capacity, {_weights("domain", mix.domains, mix.other)} AS weight, (SELECT sum(available)::DOUBLE * {float(mix.budget)}::DOUBLE FROM leaves) AS budget
  FROM leaves GROUP BY domain HAVING sum(capacity) > 0),
{_share("d", "", "domain")},
l_in AS (
  SELECT l.domain, lang, l.capacity, {_weights("lang", mix.langs, mix.other)} AS weight, d.budget
  FROM (SELECT domain, lang, sum(capacity) AS capacity FROM leaves GROUP BY ALL HAVING sum(capacity) > 0) l JOIN d ON l.domain = d.domain),
{_share("l", "domain", "lang")},
s_in AS (
  SELECT v.domain, v.lang, source, available, v.capacity, {_weights("source", mix.sources, mix.other)} AS weight, l.budget
  FROM leaves v JOIN l ON v.domain = l.domain AND v.lang = l.lang WHERE v.capacity > 0),
{_share("s", "domain, lang", "source")},
given AS (SELECT domain, lang, source, available, floor(budget + 1e-6)::BIGINT AS budget FROM s),
plan AS (SELECT *, least(budget // available, {mix.epochs}) AS n_full, budget - least(budget // available, {mix.epochs}) * available AS rest FROM given),
keyed AS (
  SELECT doc_id, domain, lang, source, n_tokens, epoch, n_full, rest, md5(concat('{mix.seed}:', epoch, ':', coalesce(doc_id::VARCHAR, ''))) AS key
  FROM slim JOIN plan USING (domain, lang, source), range({mix.epochs}) AS e(epoch)),
ranked AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY key) AS upto FROM keyed WHERE epoch <= n_full)
SELECT doc_id, domain, lang, source, n_tokens, epoch FROM ranked WHERE epoch < n_full OR (rest > 0 AND upto <= rest)
"""
