"""The store as an object, and the commands."""

import json

from pyspark.sql import functions as F

from tidewarden import __main__ as command
from tidewarden.operators import store

ROW = "seq long, id string, content string, bound_identity string"


def test_seven_verbs(spark):
    first = spark.createDataFrame([(1, "a", "old note", "x"), (2, "b", "note", "x"), (3, "c", "other", "y")], ROW)
    copy = spark.createDataFrame([(1, "a", "old note", "x"), (3, "c", "other", "y")], ROW)
    s = store.Store(first, {"archive": copy}).put(spark.createDataFrame([(9, "a", "new note", "y")], ROW))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert {r["id"]: r["content"] for r in s.all().collect()} == {"a": "new note", "b": "note", "c": "other"}
    assert ids(s.scan("note")) == ["a", "b"] and ids(s.scan("old")) == [] and ids(s.scan("")) == ["a", "b", "c"]
    assert ids(s.scan_scoped("note", ["y"])) == ["a"] and ids(s.scan_scoped("note", [])) == []
    gone = s.delete(spark.createDataFrame([("a",), ("never",)], "id string"))
    assert {r["id"]: r["found"] for r in gone.get(spark.createDataFrame([("a",), ("b",)], "id string")).collect()} == {"a": False, "b": True}
    assert sorted((r["index_name"], r["id"]) for r in gone.by_index().collect()) == [("archive", "c"), ("primary", "b"), ("primary", "c")]
    again = gone.put(spark.createDataFrame([(12, "a", "back", "x")], ROW))
    assert ids(again.scan("back")) == ["a"] and again.all().count() == 3
    assert gone.delete(spark.createDataFrame([("a",)], "id string")).all().count() == 2


def test_commands(spark, tmp_path, capsys, monkeypatch):
    command.main(["write", "mail a@b.co now"])
    assert {k: v for k, v in json.loads(capsys.readouterr().out).items() if k != "stored_id"} == {"allow": True, "state": "allow", "flags": ["pii:EMAIL"]}
    command.main(["read", "call 555-867-5309 soon"])
    assert json.loads(capsys.readouterr().out) == {"allow": True, "content_redacted": "", "flags": []}  # what was stored is redacted
    command.main(["read", "plain words"])
    assert json.loads(capsys.readouterr().out)["content_redacted"] == "plain words"
    # A request's own time: four alike within the cooldown, and four that are not.
    for name, step in (("near", 10), ("far", 400)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"op": "validate_write", "entry": "the same report again", "at": step * i}) for i in range(4)) + "\n\n")
        command.main([str(tmp_path / f"{name}.jsonl"), str(tmp_path / name)])
        flags = [json.loads(r["value"])["flags"] for r in spark.read.text(str(tmp_path / name)).collect()]
        assert len(flags) == 4 and (flags[3] == ["self_reinforcement_suspected"]) == (name == "near")
