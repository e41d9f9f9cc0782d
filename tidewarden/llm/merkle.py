"""Merkle manifest of a dataset: a digest for each row, source and the whole, and a proof for each row.

Method: a row's leaf is made where the row is read, so no text is shuffled. Leaves are numbered within their source by doc_id,
and every 3**LEVELS consecutive ones are a bucket, which is a whole subtree. An executor gets a bucket as an Arrow table
and runs level queries on it in DuckDB: an ordered string_agg of each run of three nodes, and its sha256. Spark gathers the
buckets' roots as nodes of the next layer (a row for 729 of the layer below), until each source has one, then numbers the
sources and does the same over their subroots. On the way down each node's siblings are joined to those of its bucket,
and in the last pass, bucket by bucket, a leaf's own siblings and those above its bucket are folded.

A source of any size is many buckets; a task holds one bucket's digests. The driver gets one number, the rows of the largest
source, from which the number of layers follows, and the root.

Edge cases: null columns are `-` in a leaf; rows with a null doc_id come first in their source, rows that share a doc_id are
in order of their leaves; a null source is a tree of its own and comes first; repeated rows are leaves of their own; an empty
table gives no rows (and has no root); other columns are ignored.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import common

#: Children of a node; levels of a bucket, which thus has up to FAN**LEVELS nodes.
FAN, LEVELS = 3, 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

CLIMBED = "tree string, pos long, bucket long, root string, lefts array<string>, rights array<string>"
PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _counted(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """The digest of a row; instead: values of columns that take the place of the row's."""
    return F.sha2(F.concat(*[_counted(instead.get(c, F.col(c))) for c in COLUMNS]).cast("binary"), 256)


def tampered() -> Column:
    """The digest of a row whose text has lost its line feeds, where its number is to be tampered with."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, leaf(text=F.replace("text", F.lit("\n"), F.lit("")))).otherwise(leaf())


def height(n: int) -> int:
    """Levels above n nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def bucketed(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (tree, pos, n, digest) with their bucket."""
    return nodes.withColumn("bucket", F.floor(F.col("pos") / FAN**levels).cast("long"))


def _levels(con: duckdb.DuckDBPyConnection, nodes: pa.Table, levels: int) -> None:
    """Level queries of a bucket: the table `root` (digest), and `steps` (pos, lefts, rights): each node's siblings by level."""
    up = min(levels, height(nodes.column("n")[0].as_py()))
    con.register("given", nodes.select(["pos", "digest"]))
    con.execute("CREATE OR REPLACE TEMP TABLE root AS SELECT pos, digest FROM given")
    con.execute("CREATE OR REPLACE TEMP TABLE steps AS SELECT pos, pos AS node, []::VARCHAR[] AS lefts, []::VARCHAR[] AS rights FROM given")
    for _ in range(up):
        con.execute(
            f"""CREATE OR REPLACE TEMP TABLE steps AS
            WITH sides AS (SELECT pos, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                FROM root WINDOW run AS (PARTITION BY pos // {FAN} ORDER BY pos))
            SELECT s.pos, s.node // {FAN} AS node, list_append(lefts, l) AS lefts, list_append(rights, r) AS rights FROM steps s JOIN sides ON sides.pos = s.node"""
        )
        con.execute(f"CREATE OR REPLACE TEMP TABLE root AS SELECT pos // {FAN} AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM root GROUP BY 1")
    con.unregister("given")


_ENGINE: list[duckdb.DuckDBPyConnection] = []


def _engine() -> duckdb.DuckDBPyConnection:
    """One engine of one thread in each Python worker; it keeps nothing but the tables of the bucket at hand."""
    if not _ENGINE:
        _ENGINE.append(duckdb.connect(config={"threads": 1, "memory_limit": "256MB"}))
    return _ENGINE[0]


def _plain(t: pa.Table) -> pa.Table:
    """DuckDB's strings and lists as Spark's schema has them."""
    return t.cast(pa.schema([(f.name, pa.list_(pa.string()) if pa.types.is_list(f.type) or pa.types.is_large_list(f.type) else pa.string() if pa.types.is_large_string(f.type) else f.type) for f in t.schema]))


def _root(nodes: pa.Table, levels: int) -> pa.Table:
    con = _engine()
    up = min(levels, height(nodes.column("n")[0].as_py()))
    con.register("given", nodes.select(["tree", "bucket", "pos", "digest", "n"]))
    level = "SELECT tree, bucket, n, pos, digest FROM given"
    for _ in range(up):
        level = f"SELECT tree, bucket, n, pos // {FAN} AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM ({level}) GROUP BY ALL"
    # The roots are the nodes of the next layer, of which a tree has one for each bucket.
    out = con.execute(f"SELECT tree, bucket AS pos, (n + {FAN**levels - 1}) // {FAN**levels} AS n, digest FROM ({level})").to_arrow_table()
    con.unregister("given")
    return _plain(out)


def roots(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The root of each bucket, as the nodes of the next layer (tree, pos, n, digest)."""
    return bucketed(nodes, levels).groupBy("tree", "bucket").applyInArrow(lambda t: _root(t, levels), "tree string, pos long, n long, digest string")


def _climb(nodes: pa.Table, levels: int) -> pa.Table:
    con = _engine()
    _levels(con, nodes, levels)
    tree, bucket = nodes.column("tree")[0].as_py(), nodes.column("bucket")[0].as_py()
    return _plain(con.execute("SELECT ?::VARCHAR AS tree, steps.pos, ?::BIGINT AS bucket, root.digest AS root, lefts, rights FROM steps, root", [tree, bucket]).to_arrow_table())


def climbed(nodes: DataFrame, most: int, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The root of each tree (tree, digest), and of each node the siblings on its way there (tree, pos, lefts, rights).

    most: nodes of the largest tree. A layer has 1/729 of the rows of the one below.
    """
    layers = []
    while True:
        layers.append(common.written(bucketed(nodes, levels).groupBy("tree", "bucket").applyInArrow(lambda t: _climb(t, levels), CLIMBED), "merkle-layer"))
        tops = layers[-1].groupBy("tree", "bucket").agg(F.first("root").alias("digest"))
        most = -(-most // FAN**levels)
        if most <= 1:
            break
        counts = tops.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
        nodes = common.written(tops.join(counts, "tree").select("tree", F.col("bucket").alias("pos"), "n", "digest"), "merkle-nodes")
    above = None
    for layer in reversed(layers):
        own = layer.select("tree", "pos", "bucket", "lefts", "rights")
        if above is not None:
            higher = above.select("tree", F.col("pos").alias("bucket"), F.col("lefts").alias("l"), F.col("rights").alias("r"))
            own = own.join(higher, ["tree", "bucket"]).withColumns({"lefts": F.concat("lefts", "l"), "rights": F.concat("rights", "r")})
        above = own.select("tree", "pos", "lefts", "rights")
    return tops.select("tree", "digest"), above


def folded(leaf_sql: str, n: int) -> str:
    """SQL of the root that follows from a leaf and n steps."""
    for k in range(1, n + 1):
        leaf_sql = f"sha256(lefts[{k}] || {leaf_sql} || rights[{k}])"
    return leaf_sql


def _prove(leaves: pa.Table, outer: pa.Table, levels: int) -> pa.Table:
    con = _engine()
    _levels(con, leaves, levels)
    con.register("leaves", leaves)
    con.register("higher", outer)
    n = min(levels, height(leaves.column("n")[0].as_py())) + len(outer.column("lefts")[0])
    out = con.execute(
        f"""WITH way AS (SELECT doc_id, digest, changed, subroot, whole, list_concat(s.lefts, h.lefts) AS lefts, list_concat(s.rights, h.rights) AS rights
            FROM leaves JOIN steps s USING (pos), (SELECT lefts, rights, subroot, root AS whole FROM higher) h)
        SELECT doc_id, digest AS leaf, subroot, whole AS root, sha256(array_to_string(list_transform(range(1, {n} + 1), lambda k: lefts[k] || rights[k]), '')) AS proof_sha256,
            {folded("changed", n)} AS folded_root, {folded("changed", n)} = whole AS verified FROM way"""
    ).to_arrow_table()
    con.unregister("leaves")
    con.unregister("higher")
    return _plain(out)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row."""
    tree = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source")))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf().alias("digest"), tampered().alias("changed"))
    leaves = common.written(common.numbered(slim, "tree", "doc_id", "digest"), "leaves")
    most = leaves.agg(F.max("n")).first()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], PROVEN)
    subtrees = common.written(roots(leaves.select("tree", "pos", "n", "digest"), levels), "subtrees")
    subroots, inside = climbed(subtrees, -(-most // FAN**levels), levels)
    subroots = common.written(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "subroots")
    sources = common.written(common.numbered(subroots, "tree", "name"), "sources")
    top, over = climbed(sources.select("tree", "pos", "n", "digest"), sources.count(), levels)
    whole = F.lit(top.first()["digest"]).alias("root")
    over = sources.join(over, ["tree", "pos"]).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), whole, F.col("lefts").alias("l"), F.col("rights").alias("r"))
    outer = inside.join(over, "tree").select("tree", F.col("pos").alias("bucket"), F.concat("lefts", "l").alias("lefts"), F.concat("rights", "r").alias("rights"), "subroot", "root")
    return bucketed(leaves, levels).groupBy("tree", "bucket").cogroup(common.written(outer, "outer-proofs").groupBy("tree", "bucket")).applyInArrow(lambda a, b: _prove(a, b, levels), PROVEN)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(common.table(spark, sf_dir, "documents"))


def merkle_sql(levels: int = 12, outer: int = 5) -> str:
    """The same for DuckDB, for sources of up to 3**levels rows and up to 3**outer sources, level by level over whole tables."""
    crc = "list_reduce(range(0, 8 * length(d)), lambda a, k: xor(xor(a, CASE WHEN k % 8 = 0 THEN ascii(d[(k // 8 + 1)::INT]) ELSE 0 END)::BIGINT >> 1, 3988292384 * (xor(a, CASE WHEN k % 8 = 0 THEN ascii(d[(k // 8 + 1)::INT]) ELSE 0 END)::BIGINT & 1)), 4294967295::BIGINT)"

    def counted(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def hashed(text: str) -> str:
        return f"sha256({' || '.join(counted(c) for c in (*COLUMNS[:-1], text))})"

    # crc32 ends with the complement, which turns an even remainder into an odd one.
    out = [
        f"given AS (SELECT *, doc_id::VARCHAR AS d, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, {hashed('text')} AS leaf FROM documents)",
        f"mixed AS (SELECT doc_id, tree, leaf, CASE WHEN {crc} % 2 = 1 THEN {hashed('replace(text, chr(10), chr(0))').replace('chr(0)', repr(''))} ELSE leaf END AS cur FROM given)",
        "a0 AS MATERIALIZED (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest, doc_id, leaf, cur FROM mixed)",
        "aw0 AS (SELECT doc_id, leaf, tree, pos, cur, '' AS proof FROM a0)",
    ]

    def climb(p: str, count: int) -> None:
        for k in range(count):
            run = "PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN"
            out.append(f"{p}s{k} AS MATERIALIZED (SELECT tree, pos, n, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {p}{k})")
            out.append(f"{p}{k + 1} AS MATERIALIZED (SELECT tree, pos // 3 AS pos, (any_value(n) + 2) // 3 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest FROM {p}{k} GROUP BY tree, pos // 3)")
            out.append(f"{p}w{k + 1} AS MATERIALIZED (SELECT w.* EXCLUDE (pos, cur, proof), w.pos // 3 AS pos, CASE WHEN s.n > 1 THEN sha256(l || cur || r) ELSE cur END AS cur, proof || l || r AS proof FROM {p}w{k} w JOIN {p}s{k} s USING (tree, pos))")

    climb("a", levels)
    out.append(f"b0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest, tree AS name FROM a{levels})")
    out.append(f"bw0 AS (SELECT w.doc_id, w.leaf, b.digest AS subroot, '' AS tree, b.pos, w.cur, w.proof FROM aw{levels} w JOIN b0 b ON b.name = w.tree)")
    climb("b", outer)
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = digest AS verified FROM bw{outer}, b{outer}"
