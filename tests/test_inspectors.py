"""A third inspector, plugged in: the batch form, the stream form and a plain loop agree."""

from collections import deque

from tests.plugged import Burst, Never
from tidewarden.operators import gate, inspectors
from tidewarden.sources.shared import written
from tidewarden.streaming import guard


ROWS = [(i, i * (1 + i % 4), " ".join(["w"] * (1 + i // 7 % 3)) if i % 11 else "system prompt now", f"spiffe://{i % 10 == 0}", ["system", "user_input", "system", "agent_authored"][i % 4]) for i in range(90)]


def log(spark):
    rows = [(s, t // 2, c, k, o) for s, t, c, k, o in sorted(ROWS)]
    rows = [(s, max(x[1] for x in rows[: s + 1]), c, k, o) for s, _, c, k, o in rows]  # time does not fall
    return rows, spark.createDataFrame(rows, "seq long, secs long, content string, spiffe_id string, source string").selectExpr("*", "'attested' AS trust_tier", "'own' AS scope", "'' AS key")


def test_three_forms_agree(spark, tmp_path):
    rows, writes = log(spark)
    policy = gate.Policy(more=(Never(), Burst()))
    past, want = {}, set()
    for seq, secs, content, who, source in rows:
        if source == "user_input" or content.startswith("system"):
            continue
        memory = past.setdefault(who, deque(maxlen=3))
        n = len(content.split(" "))
        if sum(secs - t <= 5 and m == n for t, m in memory) >= 2:
            want.add(seq)
        memory.append((secs, n))
    flagged = lambda df: {r["seq"] for r in df.collect() if "burst_suspected" in r["flags"]}
    batch = gate.validate_writes(writes, policy)
    assert flagged(batch) == want and 5 < len(want) < 60
    out = guard.replayed(spark, [writes.where("seq < 31"), writes.where("seq >= 31")], policy, f"file://{tmp_path}")
    verdicts = spark.read.parquet(f"{out}/verdicts")
    assert flagged(verdicts) == want
    assert sorted(verdicts.select("seq", "flags").collect()) == sorted(batch.select("seq", "flags").collect())
    # Parts of one key with a halo of three rows.
    passed = gate.measured(gate.detected(writes, policy), policy).where("NOT injection")
    assert {r["seq"] for r in inspectors.flagged(written(passed.select("seq", "bound_key", "more"), "t"), policy.more[1], 1, 4).collect()} == want
