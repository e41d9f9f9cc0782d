"""The store as stream state against the store as tables, over overwrites, deletes and a restart."""

import random

from pyspark.sql import functions as F

from tidewarden.operators import store
from tidewarden.streaming import store_state


def test_no_stale_link_after_overwrites(spark, tmp_path):
    rng = random.Random(5)
    ops = [(s, "delete" if rng.random() < 0.25 else "put", f"m{rng.randint(0, 25)}", f"text {rng.randint(0, 8)}") for s in range(240)]
    ops += [(300, "put", "null", None), (301, "fly", "m1", "x"), (302, "put", None, "x"), (303, "delete", "never", None), (304, "put", "again", "same"), (305, "put", "again", "same")]
    df = spark.createDataFrame(ops, "seq long, op string, id string, content string")
    for k, lot in enumerate((df.where("seq < 90"), df.where("seq BETWEEN 90 AND 180"), df.where("seq > 180"))):
        lot.coalesce(2).write.parquet(f"{tmp_path}/in/lot={k}")
        stream = spark.readStream.schema(lot.schema).parquet(f"{tmp_path}/in/lot=*")
        store_state.kept(stream, f"{tmp_path}/links", f"{tmp_path}/state", availableNow=True).awaitTermination()
    known = df.where("op IN ('put', 'delete') AND id IS NOT NULL").withColumn("content", F.coalesce("content", F.lit("")))
    last = store.latest(known).where("op = 'put'")
    want = {r["content"]: r["ids"] for r in store.content_index(last).collect()}
    state = f"{tmp_path}/state"
    assert {r["content"]: r["ids"] for r in store_state.content_index(spark, state).collect()} == want
    assert {(r["id"], r["seq"], r["content"]) for r in store_state.entries(spark, state).collect()} == {(r["id"], r["seq"], r["content"]) for r in last.collect()}
    # The changes that were emitted add up to the same links.
    w = spark.read.parquet(f"{tmp_path}/links").groupBy("content", "id").agg(F.max_by("linked", "seq").alias("linked")).where("linked")
    assert {(r["content"], r["id"]) for r in w.collect()} == {(c, i) for c, ids in want.items() for i in ids}


def test_what_a_batch_links_and_drops_again_is_no_change(spark, tmp_path):
    df = spark.createDataFrame([(s, "put", f"m{s % 3}", f"text {s}") for s in range(60)], "seq long, op string, id string, content string")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    store_state.kept(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/links", f"{tmp_path}/state", availableNow=True).awaitTermination()
    assert {(r["content"], r["id"], r["linked"]) for r in spark.read.parquet(f"{tmp_path}/links").collect()} == {(f"text {s}", f"m{s % 3}", True) for s in (57, 58, 59)}
