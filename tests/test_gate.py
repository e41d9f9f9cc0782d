"""Gate, key policy, rolling checks (batch and stream), store, reads and audit."""

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import audit, evaluate, gate, store
from tidewarden.sources import jsonl

LOG = "seq long, secs long, content string, spiffe_id string, trust_tier string, scope string, source string, key string"


def log(spark, rows):
    base = {"secs": 0, "content": "x", "spiffe_id": "spiffe://a", "trust_tier": "attested", "scope": "", "source": "user_input", "key": ""}
    names = [f.split()[0] for f in LOG.split(", ")]
    return spark.createDataFrame([tuple({**base, "seq": i, **r}[n] for n in names) for i, r in enumerate(rows)], LOG)


def verdicts(spark, rows, policy=None):
    got = gate.validate_writes(log(spark, rows), policy or gate.Policy()).orderBy("seq").collect()
    return [(r["state"], r["flags"]) for r in got]


def test_routing_and_flag_order(spark):
    got = verdicts(spark, [{"content": "fine"}, {"content": "system prompt"}, {"content": "pretend this never happened"}, {"content": "pretend this never happened a@b.co"}, {"content": "system prompt, pretend this never happened a@b.co"}])
    assert got == [
        ("allow", []),
        ("block", ["injection_suspected"]),
        ("quarantine", ["borderline_suspected"]),
        ("quarantine", ["pii:EMAIL", "borderline_suspected"]),
        ("block", ["injection_suspected", "pii:EMAIL", "borderline_suspected"]),
    ]


def test_key_policy(spark):
    policy = gate.Policy(("config:*",), ("base:*",), "guard:", None, None)
    rows = [
        {"key": "config:a", "trust_tier": "self"},
        {"key": "config:a"},
        {"key": "guard:x", "trust_tier": "self", "content": "A"},
        {"key": "guard:x", "content": "B"},
        {"key": "guard:x", "content": "C"},
        {"key": "guard:x", "content": "B"},
        {"key": "base:k", "content": "A", "trust_tier": "self"},
        {"key": "base:k", "content": "A2"},
        {"key": "base:k", "content": "A"},
        {"key": "base:z", "content": "system prompt"},
        {"key": "base:z", "content": "first"},
        {"key": "my guard:x", "content": "Z"},
        {"key": None, "content": "Z"},
    ]
    v, m = "protected_key_violation", "immutable_mismatch"
    assert verdicts(spark, rows, policy) == [("allow", [v]), ("allow", []), ("block", [v]), ("allow", []), ("block", [m]), ("allow", []), ("allow", []), ("allow", [m]), ("allow", []), ("block", ["injection_suspected"]), ("allow", []), ("allow", []), ("allow", [])]


SIZES = [100, 102, 98, 101, 99, 500, 500]


def test_size_anomaly(spark):
    policy = gate.Policy(repeats=None, size=gate.SizeAnomaly(window=5))
    got = verdicts(spark, [{"content": "y" * n} for n in SIZES], policy)
    assert [bool(f) for _, f in got] == [False] * 5 + [True, False]
    # A rejected write leaves no trace in the state, and bytes count.
    rows = [{"content": "é" * 100} for _ in range(5)] + [{"content": "system prompt " + "y" * 4000}, {"content": "y" * 200}, {"content": "y" * 201}]
    assert [bool(f) for _, f in verdicts(spark, rows, policy)] == [False] * 5 + [True, False, True]


def test_exact_sigma_boundary(spark):
    policy = gate.Policy(repeats=None, size=gate.SizeAnomaly(least=4))
    rows = [{"content": "y" * n} for n in (98, 102, 98, 102)]
    assert not verdicts(spark, [*rows, {"content": "y" * 106}], policy)[-1][1]
    assert verdicts(spark, [*rows, {"content": "y" * 107}], policy)[-1][1] == [gate.SIZE_FLAG]


REPEATS = [{"secs": 10 * i, "content": f"the nightly job finished well number {i % 2}"} for i in range(6)]


def test_self_reinforcement(spark):
    policy = gate.Policy(size=None)
    got = [f for _, f in verdicts(spark, REPEATS, policy)]
    assert [bool(f) for f in got] == [False, False, False, True, True, True]
    assert not any(f for _, f in verdicts(spark, [{**r, "source": " human_authored "} for r in REPEATS], policy))
    assert not any(f for _, f in verdicts(spark, [{**r, "secs": 300 * i} for i, r in enumerate(REPEATS)], policy))
    assert not any(f for _, f in verdicts(spark, [{**r, "content": "!!!"} for r in REPEATS], policy))


def test_stream_equals_batch(spark, tmp_path):
    from tidewarden.streaming import inspect

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = REPEATS + [{"secs": 100 + i, "content": "z" * n, "spiffe_id": f"spiffe://{i % 2}"} for i, n in enumerate(SIZES * 4)]
    policy = gate.Policy()
    ready = gate.keyed(gate.detected(log(spark, rows), policy), policy)
    want = {(r["seq"], r["size_flag"], r["repeat_flag"]) for r in gate.inspected(ready, policy).collect() if r["size_flag"] or r["repeat_flag"]}
    passed = ready.where("NOT injection AND NOT key_rejected").select("seq", "secs", "bound_key", "content", "source")
    for k in range(2):  # two micro-batches, so state is read back
        passed.where(F.col("seq") >= 17 if k else F.col("seq") < 17).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={k}")
    got = set()
    stream = spark.readStream.schema(passed.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    query = inspect.inspections(stream).writeStream.foreachBatch(lambda df, _: got.update(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    query.stop()
    assert want and got == want


def test_first_value_stream(spark, tmp_path):
    from tidewarden.streaming import inspect

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([("a", 2, "h2"), ("a", 1, "h1"), ("b", 3, "h1"), ("a", 4, "h1")], "slot string, seq long, h string").coalesce(1).write.parquet(f"{tmp_path}/in")
    got = set()
    stream = spark.readStream.schema("slot string, seq long, h string").parquet(f"{tmp_path}/in")
    query = inspect.first_values(stream).writeStream.foreachBatch(lambda df, _: got.update(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert got == {("a", 1, False), ("a", 2, True), ("b", 3, False), ("a", 4, False)}


ENTRIES = [(1, "m1", "alpha note", "spiffe://a", "user_input", [], False), (2, "m2", "beta note 555-867", "spiffe://b", "system", ["pii:X"], False), (3, "m3", "shared note", "shared://", "unknown", [], False), (4, "m4", "unbound note", "", "unknown", [], False), (5, "m5", "held note", "spiffe://a", "unknown", ["borderline_suspected"], True), (6, "m6", "5309 more", "spiffe://b", "unknown", [], False)]


def entries(spark):
    return spark.createDataFrame(ENTRIES, "seq long, id string, content string, bound_identity string, source_class string, flags array<string>, quarantined boolean")


def test_reads(spark):
    rows = [(1, "note", "spiffe://a", "attested"), (2, "", " spiffe://b ", "attested"), (3, "note", "spiffe://a", "self"), (4, "note", "shared://", "attested"), (5, "none", "spiffe://a", "attested"), (6, "note", "spiffe://", "attested")]
    reads = spark.createDataFrame(rows, "read_id int, query string, spiffe_id string, trust_tier string")
    got = {r["read_id"]: (r["content_redacted"], r["flags"]) for r in store.read(entries(spark), reads).collect()}
    assert got == {
        1: ("alpha note\nshared note", []),
        2: ("beta note 555-867\nshared note\n5309 more", []),
        3: ("shared note\nunbound note", []),
        4: ("shared note", []),
        5: ("", []),
        6: ("shared note", []),
    }


def test_joined_hits_are_redacted_once(spark):
    e = spark.createDataFrame([(1, "a", "call 555-867", "", "", [], False), (2, "b", "5309 now", "", "", [], False)], entries(spark).schema)
    reads = spark.createDataFrame([(1, "", None, None)], "read_id int, query string, spiffe_id string, trust_tier string")
    (r,) = store.read(e, reads).collect()
    assert (r["content_redacted"], r["flags"]) == ("call <PHONE> now", ["pii:PHONE"])


def test_review_looks_alike_for_unknown_and_open(spark):
    wanted = spark.createDataFrame([("m5",), ("m1",), ("nope",)], "id string")
    got = {r["id"]: tuple(r)[1:] for r in store.review(entries(spark), wanted).collect()}
    assert got == {"m5": (True, "held note", ["borderline_suspected"]), "m1": (False, "", []), "nope": (False, "", [])}


def test_store_verbs(spark):
    e = entries(spark)
    puts = e.unionByName(e.where("id = 'm1'").withColumn("seq", F.lit(9).cast("long")).withColumn("content", F.lit("newer")))
    assert {r["id"]: r["content"] for r in store.latest(puts).collect()}["m1"] == "newer"
    got = {r["id"]: r["found"] for r in store.get(e, spark.createDataFrame([("m1",), ("x",)], "id string")).collect()}
    assert got == {"m1": True, "x": False}
    assert store.delete(store.delete(e, e.where("id = 'm1'")), e.where("id = 'm1'")).count() == 5
    assert store.scan(e, "").count() == 6 and store.scan_scoped(e, "", []).count() == 0
    assert store.by_index(e, {"copy": e.limit(1)}).groupBy("index_name").count().count() == 2
    assert store.content_index(e).count() == 6


def test_jsonl(spark, tmp_path):
    assert jsonl.store(spark).count() == 0 and jsonl.store(spark, "file", f"{tmp_path}/none").count() == 0
    jsonl.write_entries(entries(spark), f"{tmp_path}/s")
    back = {r["id"]: r for r in jsonl.store(spark, "file", f"{tmp_path}/s").collect()}
    assert len(back) == 6 and back["m5"]["quarantined"] and back["m2"]["flags"] == ["pii:X"]
    (tmp_path / "t.jsonl").write_text('\n{"id":"a","content":"c"}\n\n')
    (r,) = jsonl.read_entries(spark, f"{tmp_path}/t.jsonl").collect()
    assert (r["id"], r["flags"], r["quarantined"]) == ("a", [], False)
    for bad in ('{"content":"c"}', "{broken"):
        (tmp_path / "bad.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception):
            jsonl.read_entries(spark, f"{tmp_path}/bad.jsonl").collect()
    for kind, path in (("file", None), ("other", None)):
        with pytest.raises(ValueError):
            jsonl.store(spark, kind, path)


def test_requests(spark):
    lines = ['{"op":"validate_write","entry":"x","identity":{"spiffe_id":"s","trust_tier":7}}', "nope", '{"op":"fly"}', '{"op":"ping","key":3}', "[1]"]
    good, bad = jsonl.requests(spark.createDataFrame([(s,) for s in lines], "value string"))
    got = {r["op"]: (r["entry"], r["key"], r["identity"]["spiffe_id"], r["identity"]["trust_tier"]) for r in good.collect()}
    assert got == {"validate_write": ("x", "", "s", ""), "ping": ("", "", "", "")}
    assert sorted(r["code"] for r in bad.collect()) == ["bad_request", "bad_request", "unknown_op"]


def test_audit(spark):
    rows = [{"content": "fine"}, {"content": "a@b.co"}, {"content": "system prompt"}, {"content": "x", "key": "guard:k", "trust_tier": "self"}]
    events = audit.write_events(gate.validate_writes(log(spark, rows), gate.Policy()))
    wired = {r["seq"]: r for r in audit.wire(events, "me").collect()}
    assert set(wired) == {1, 2}
    assert (wired[1]["decision"], wired[2]["decision"], wired[2]["target"], wired[1]["context"]["flags"]) == ("allow", "deny", "memory-store", "pii:EMAIL")
    deletes = spark.createDataFrame([(7, 5, "h", True), (8, 6, "g", False)], "del_seq long, secs long, deletion_hash string, residue_detected boolean")
    got = {r["seq"]: r for r in audit.wire(audit.delete_events(deletes)).collect()}
    assert got[7]["context"]["residue_detected"] == 1 and got[8]["context"]["residue_detected"] == 0 and got[7]["decision"] is None
    assert (got[7]["context"]["finding_type"], got[7]["refs"][0]["id"]) == ("residue_found", "h")


def test_failing_sinks_are_isolated(spark):
    def broken(_):
        raise RuntimeError

    assert not audit.emit(None, None) and not audit.emit(None, broken) and audit.emit(None, lambda _: None)


def test_recall_precision(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "poison boolean, rejected boolean")
    (r,) = evaluate.recall_precision(df).collect()
    assert (r["recall"], r["precision"]) == (0.5, 0.5)
    (r,) = evaluate.recall_precision(df.where("NOT rejected")).collect()
    assert (r["recall"], r["precision"]) == (0.0, 1.0)


def test_whole_stream_equals_batch_over_a_restart(spark, tmp_path):
    from tidewarden.streaming import guard

    policy = gate.Policy(("config:*",), ("base:*",), "guard:")
    keys = [{"key": "guard:x", "content": "B"}, {"key": "guard:x", "content": "C"}, {"key": "guard:x", "content": "D", "trust_tier": "self"}, {"key": "base:m", "content": "system prompt"}, {"key": "base:m", "content": "one"}, {"key": "base:m", "content": "two a@b.co"}, {"key": "config:a", "trust_tier": "self"}]
    # Rejected writes leave no sizes behind; nulls are empty.
    sizes = [{"content": "z" * n} for n in SIZES] + [{"content": "system prompt " + "y" * 5000}, {"content": "w" * 900}, {"content": None, "key": None}]
    rows = REPEATS + keys + sizes + keys + sizes
    writes = log(spark, [{**r, "secs": i} for i, r in enumerate(rows)])
    columns = ("seq", "state", "flags", "stored_id", "redacted")
    want = sorted(gate.validate_writes(writes, policy).select(*columns).collect())
    out = guard.replayed(spark, [writes.where("seq < 20"), writes.where("seq >= 20"), writes.where("false")], policy, f"file://{tmp_path}")
    assert sorted(spark.read.parquet(f"{out}/verdicts").select(*columns).collect()) == want
    assert {f for r in want for f in r["flags"]} >= {"protected_key_violation", "immutable_mismatch", "size_anomaly_suspected", "self_reinforcement_suspected", "injection_suspected"}
    events = guard.audit_events(spark, out).select("seq").collect()
    assert sorted(r["seq"] for r in events) == sorted(r["seq"] for r in want if "injection_suspected" in r["flags"] or (r["state"] != "block" and any(f.startswith("pii:") for f in r["flags"])))
