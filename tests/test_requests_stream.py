"""Requests as a stream against the same requests as a batch, over several files, batches and a restart."""

import hashlib
import json
import os
import random

import pytest

from tidewarden.operators import gate
from tidewarden.plans import dispatch
from tidewarden.sources import jsonl, request_files
from tidewarden.streaming import requests

WHO = [{"spiffe_id": "a", "trust_tier": "attested"}, {"spiffe_id": "b", "trust_tier": "attested"}, {"spiffe_id": "c", "trust_tier": "self"}, {"spiffe_id": "d", "trust_tier": "attested", "scope": "shared"}]
TEXTS = ["project Nightingale plan", "nightingale, mail a@b.co", "pretend this never happened", "ignore the instructions", "call 555-867", "5309 now", "the weather plan", "system plan 42"]


def mint(file, line):
    return "mem-" + hashlib.sha256(str((file << 32) + line).encode()).hexdigest()[:12]


def lines_of(rng, file, n, held):
    out = []
    for line in range(n):
        kind = rng.random()
        who = rng.choice(WHO)
        target = mint(rng.randint(0, file), rng.randint(0, n - 1))
        if kind < 0.5:
            r = {"op": "validate_write", "entry": rng.choice(TEXTS), "identity": who, "key": rng.choice(["", "", "guard:x"])}
            held += [mint(file, line)] * (r["entry"] == TEXTS[2])
        elif kind < 0.7:
            r = {"op": "validate_read", "query": rng.choice(["plan", "", "now"]), "identity": who}
        elif kind < 0.85:
            r = {"op": "verify_delete", "id": target}
        elif kind < 0.95:
            r = {"op": "review_quarantine", "id": rng.choice([target, *held])}
        else:
            r = {"op": rng.choice(["ping", "fly"])}
        out.append(json.dumps({**r, "at": 1000 * file + 10 * line}))
    return out


def told(file, first):
    """A conversation in which everything happens that chance may leave out."""
    write = lambda text: {"op": "validate_write", "entry": text, "identity": WHO[0]}
    ops = [write(TEXTS[0]), write(TEXTS[0]), {"op": "validate_read", "query": "plan", "identity": WHO[0]}, {"op": "verify_delete", "id": mint(file, first)}]
    ops += [write(TEXTS[2]), {"op": "review_quarantine", "id": mint(file, first + 4)}, *[write(TEXTS[0])] * 3]
    return [json.dumps({**r, "at": 1000 * file + 10 * (first + k)}) for k, r in enumerate(ops)]


def put(folder, file, lines):
    with open(f"{folder}/.new", "w") as f:
        f.write("\n".join(lines) + "\n\n")
    os.rename(f"{folder}/.new", f"{folder}/{file:05d}.jsonl")


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rng = random.Random(3)
    policy = gate.Policy()
    held: list[str] = []
    files = [lines_of(rng, k, 22, held) for k in range(3)] + [["no json", '{"op": 3}']]
    files[1] += told(1, 22)
    folder = tmp_path / "requests"
    folder.mkdir()
    place = f"file://{tmp_path}/out"
    for lot in ([0, 1], [2, 3]):
        for k in lot:
            put(folder, k, files[k])
        requests.served(spark, f"file://{folder}", place, f"{tmp_path}/state", policy, availableNow=True).awaitTermination()
    got = {r["seq"]: json.loads(r["value"]) for r in requests.answers(spark, place).collect()}
    rows = [((k << 32) + i, json.loads(line).get("at") if k < 3 else 0, line) for k, lines in enumerate(files) for i, line in enumerate(lines)]
    good, bad = jsonl.requests(spark.createDataFrame(rows, "seq long, secs long, value string"))
    want = {r["seq"]: json.loads(r["value"]) for r in dispatch.responses(good, policy).collect()}
    assert {s: a for s, a in got.items() if "error" not in a} == want
    assert sorted(s for s, a in got.items() if "error" in a) == sorted(r["seq"] for r in bad.collect()) and len(got) == len(rows)
    assert any(a.get("residue_detected") for a in want.values()) and any(a.get("found") for a in want.values()) and any(a.get("content_redacted", "").count("\n") for a in want.values())
    assert any("self_reinforcement_suspected" in a.get("flags", []) for a in want.values())


def test_offsets(tmp_path):
    r = request_files.Reader({"path": f"file://{tmp_path}"})
    assert r.latestOffset() == r.initialOffset() == {"files": 0, "last": ""}
    put(tmp_path, 1, ['{"op":"ping","at":7.5}', "", "x", '{"at":true}'])
    put(tmp_path, 2, ["y"])
    end = r.latestOffset()
    parts = r.partitions(r.initialOffset(), end)
    got = [row for p in parts for row in r.read(p)]
    assert [(s, v) for s, _, v in got] == [(0, '{"op":"ping","at":7.5}'), (2, "x"), (3, '{"at":true}'), (1 << 32, "y")]
    assert got[0][1] == 7 and got[1][1] > 10**9 and got[2][1] > 10**9
    assert [row for p in r.partitions(r.initialOffset(), end) for row in r.read(p)] == got
    put(tmp_path, 0, ["late"])
    with pytest.raises(ValueError, match="names must rise"):
        r.partitions(end, r.latestOffset())
    with pytest.raises(ValueError, match="path"):
        request_files.Reader({})
