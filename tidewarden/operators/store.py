"""The store as tables: versions, deletions, scoped scans, the two indexes, reads and reviews."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.functions import detect, identity
from tidewarden.operators import asof, long_reads


def entries(writes: DataFrame) -> DataFrame:
    """Stored entries of validated writes: seq, id, content (if the writes have a text), bound_identity, source_class, flags, quarantined."""
    content = [F.col("redacted").alias("content")] if "redacted" in writes.columns else []
    return writes.where("allow").select("seq", F.col("stored_id").alias("id"), *content, F.col("bound_key").alias("bound_identity"), "source_class", "flags", (F.col("state") == "quarantine").alias("quarantined"))


def latest(puts: DataFrame) -> DataFrame:
    """The last put of each id."""
    last = Window.partitionBy("id").orderBy(F.desc("seq"))
    return puts.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def get(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id) with the entry, if there is one, and found."""
    return wanted.join(store.withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id"), "id", "left_anti")


def scan(store: DataFrame, query: str | Column) -> DataFrame:
    """Entries whose content has the query as a substring; the empty query matches all."""
    return store.where(F.contains("content", F.lit(query) if isinstance(query, str) else query))


def scan_scoped(store: DataFrame, query: str, keys: list[str]) -> DataFrame:
    return scan(store, query).where(F.col("bound_identity").isin(*keys)) if keys else store.where("false")


def content_index(store: DataFrame) -> DataFrame:
    """Ids of each content."""
    return store.groupBy("content").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def by_index(store: DataFrame, indexes: dict[str, DataFrame] | None = None) -> DataFrame:
    """All copies of entries with the name of the index that holds them."""
    out = store.withColumn("index_name", F.lit("primary"))
    for name, copy in (indexes or {}).items():
        out = out.unionByName(copy.withColumn("index_name", F.lit(name)))
    return out


def lives(puts: DataFrame, deletes: DataFrame) -> DataFrame:
    """puts with put_seq and del_seq, that of the first delete of their id after them (null: none)."""
    puts = puts.withColumnRenamed("seq", "put_seq")
    ended = puts.select("id", "put_seq").join(deletes.select("id", F.col("seq").alias("del_seq")), "id").where("del_seq > put_seq")
    return puts.join(ended.groupBy("id", "put_seq").agg(F.min("del_seq").alias("del_seq")), ["id", "put_seq"], "left")


def alive(puts: DataFrame, deletes: DataFrame, ops: DataFrame) -> DataFrame:
    """Entries as of each op: put before it, deleted (if at all) not before it. All have seq; deletes have id."""
    return asof.joined(lives(puts, deletes), ops.withColumnRenamed("seq", "op_seq"), "put_seq", "del_seq", "op_seq")


def alive_totals(puts: DataFrame, deletes: DataFrame, ops: DataFrame, **sums: Column) -> DataFrame:
    """op_seq of each op, n entries that are alive as of it, and sums over them; no pair of op and entry is made."""
    return asof.totals(lives(puts, deletes), ops.withColumnRenamed("seq", "op_seq"), "put_seq", "del_seq", "op_seq", **sums)


def alive_totals_by(puts: DataFrame, deletes: DataFrame, ops: DataFrame, group: str, **greatest: Column) -> DataFrame:
    """op_seq and group with n entries that are alive as of the op, and the greatest of columns of them; no pair is made."""
    return asof.totals_by(lives(puts, deletes), ops.withColumnRenamed("seq", "op_seq"), "put_seq", "del_seq", "op_seq", group, **greatest)


def read(store: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads (read_id, query, spiffe_id, trust_tier): the visible hits in order of seq, joined by line feeds, then redacted.

    Redaction is spread over chunks (see long_reads, which also gives reads that don't fit one string).

    Keys are an equi-join, so Spark broadcasts the reads where they are few and shuffles by key otherwise.
    """
    return answered(reads, long_reads.texts(hits(store, reads)))


def hits(store: DataFrame, reads: DataFrame) -> DataFrame:
    """read_id, seq and content of what each read sees."""
    asked = reads.select("read_id", "query", F.explode(identity.visible_keys(F.col("spiffe_id"), F.col("trust_tier"))).alias("bound_identity"))
    live = store.where("NOT quarantined").select("seq", "content", "bound_identity")
    return live.join(asked, "bound_identity").where(F.contains("content", "query")).select("read_id", "seq", "content")


def read_digests(store: DataFrame, reads: DataFrame) -> DataFrame:
    """read_id, allow, text_md5, n (characters) and flags of what read() gives, for reads that fit no string."""
    out = reads.select("read_id", F.col("read_id").cast("long").alias("_read")).join(long_reads.digests(hits(store, reads)).withColumnRenamed("read_id", "_read"), "_read", "left")
    return out.select("read_id", F.lit(True).alias("allow"), F.coalesce("text_md5", F.md5(F.lit("").cast("binary"))).alias("text_md5"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))


def answered(reads: DataFrame, texts: DataFrame) -> DataFrame:
    """Each read with its text and flags, empty where nothing was found."""
    out = reads.select(F.col("read_id").cast("long").alias("read_id")).join(texts, "read_id", "left")
    return out.select(F.col("read_id").cast(reads.schema["read_id"].dataType).alias("read_id"), F.lit(True).alias("allow"), F.coalesce("content_redacted", F.lit("")).alias("content_redacted"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))


def review(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Quarantined entries by id; an unknown id and one that isn't quarantined look the same."""
    held = store.where("quarantined").select("id", "content", F.col("flags").alias("_flags"), F.lit(True).alias("found"))
    out = detect.with_redaction(wanted.select("id").join(held, "id", "left"), "content", "content_redacted", "_pii")
    return out.select("id", F.coalesce("found", F.lit(False)).alias("found"), "content_redacted", F.coalesce("_flags", F.array().cast("array<string>")).alias("flags"))


@dataclass(frozen=True)
class Store:
    """A store with the seven verbs; a put or delete gives another store. puts: entries with seq and id, the last of an id counts.

    copies: entries by the name of the index that holds them, of which a delete takes its ids too.
    """

    puts: DataFrame
    copies: dict[str, DataFrame] = field(default_factory=dict)

    def all(self) -> DataFrame:
        return latest(self.puts)

    def put(self, rows: DataFrame) -> Store:
        return Store(self.puts.unionByName(rows), self.copies)

    def get(self, wanted: DataFrame) -> DataFrame:
        return get(self.all(), wanted)

    def delete(self, ids: DataFrame) -> Store:
        return Store(delete(self.all(), ids), {name: delete(copy, ids) for name, copy in self.copies.items()})

    def scan(self, query: str | Column) -> DataFrame:
        return scan(self.all(), query)

    def scan_scoped(self, query: str, keys: list[str]) -> DataFrame:
        return scan_scoped(self.all(), query, keys)

    def by_index(self) -> DataFrame:
        return by_index(self.all(), self.copies)
