"""Rolling checks by parts against plain loops, on a table where one key has most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewarden.operators import gate, rolling
from tidewarden.streaming.inspect import Inspector

WORDS = [f"w{i}" for i in range(40)]


def rows_of(rng, n):
    base = [rng.sample(WORDS, 12) for _ in range(3)]
    out, at = [], 0
    for seq in range(n):
        at += rng.choice([0, 1, 4, 90])
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            words[rng.randrange(12)] = rng.choice(WORDS)
        key = "hot" if rng.random() < 0.9 else f"k{rng.randint(0, 4)}"
        words = words[: rng.choice([0, 2, 12, 12])]
        out.append((seq * 3, at, key, rng.choice([100, 101, 99, 900]), rng.random() < 0.8, sorted(set(words))))
    return out


def plain(rows, policy):
    sizes, writes, out = {}, {}, {}
    for seq, at, key, n, agent, words in rows:
        last = sizes.setdefault(key, [])
        x = last[-policy.size.window :]
        m, s, q = len(x), sum(x), sum(v * v for v in x)
        odd = m >= policy.size.least and (m * n - s) ** 2 > policy.size.sigma**2 * (m * q - s * s)
        last.append(n)
        again = False
        if agent:
            mine = writes.setdefault(key, [])
            near = [p for t, p in mine[-policy.repeats.history :] if at - t < policy.repeats.cooldown and words and p and len(set(words) & set(p)) / min(len(words), len(p)) >= policy.repeats.similarity]
            again = len(near) >= policy.repeats.most
            mine.append((at, words))
        if odd or again:
            out[seq] = (gate.SIZE_FLAG if odd else None, gate.REPEAT_FLAG if again else None)
    return out


SCHEMA_NAMES = ["seq", "secs", "bound_key", "bytes", "agent", "words"]
SCHEMA = "seq long, secs long, bound_key string, bytes long, agent boolean, words array<string>"  # and more, where inspectors are plugged in


@pytest.mark.parametrize("part", [1, 50, 4096])
def test_parts_equal_the_serial_order(spark, part):
    policy = gate.Policy(size=gate.SizeAnomaly(window=7, sigma=1.5), repeats=gate.SelfReinforcement(history=30))
    rows = rows_of(random.Random(3), 900)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA).withColumn("part", F.lit("clash")).repartition(4)
    got = {r["seq"]: (r["size_flag"], r["repeat_flag"]) for r in gate.inspections(df.select(*SCHEMA_NAMES), policy, part).collect()}
    want = plain(rows, policy)
    assert got == want
    assert sum(a is not None for a, _ in want.values()) > 20 and sum(b is not None for _, b in want.values()) > 20


def test_sizes_equal_the_window_form(spark):
    policy = gate.Policy()
    df = spark.createDataFrame(rows_of(random.Random(5), 700), SCHEMA)
    serial = {r["seq"] for r in df.withColumn("f", policy.size.flag("bound_key", "seq", "bytes")).where("f IS NOT NULL").collect()}
    split = {r["seq"] for r in gate.inspections(df, policy, 64).where("size_flag IS NOT NULL").collect()}
    assert split == serial


def test_a_hot_key_is_cut_into_even_parts(spark):
    df = spark.createDataFrame([(i, "hot" if i % 10 else "cold") for i in range(5000)], "seq long, key string").repartition(8)
    numbered = rolling.numbered(df, "key", "seq")
    w = Window.partitionBy("key").orderBy("seq")
    assert {(r["seq"], r["pos"]) for r in numbered.collect()} == {(r["seq"], r["n"] - 1) for r in df.withColumn("n", F.row_number().over(w)).collect()}
    sizes = sorted(r["n"] for r in rolling.parts(numbered, 20, 100).groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).collect())
    assert sizes[-1] <= 120 and sizes[-1] < 2 * sizes[len(sizes) // 2] and len(sizes) >= 50
    assert rolling.parts(numbered, 20, 100).where("own").count() == 5000


def test_few_pairs_are_compared():
    rng = random.Random(4)
    words = [f"{rng.choice('abcdefg')}{i}" for i in range(3000)]
    recent, all_pairs = rolling.RecentWords(0.85, 10**9, 256), 0
    for at in range(600):
        mine = frozenset(words[int(rng.paretovariate(0.6)) % 3000] for _ in range(60))
        recent.near(at, mine, 10**6)
        all_pairs += len(recent.rows)
        recent.add(at, mine)
    assert recent.compared < 0.35 * all_pairs
    assert len(recent.rows) == 256 and sum(map(len, recent.having.values())) == sum(len(w) for _, _, w, _ in recent.rows)


def test_falling_time_is_an_error_in_both_forms(spark):
    policy = gate.Policy(size=None)
    rows = [(i, t, "k", 1, True, ["a"]) for i, t in enumerate([0, 1, 2, 1000, 3])]
    with pytest.raises(Exception, match="time falls from 1000 to 3"):
        gate.inspections(spark.createDataFrame(rows, SCHEMA), policy).collect()

    class State:
        def __init__(self):
            self.rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

    import pandas as pd

    stream = Inspector(None, policy.repeats)
    stream.sizes, stream.writes = State(), State()
    frame = pd.DataFrame([(s, t, 1, True, ["a"]) for s, t, *_ in rows], columns=["seq", "secs", "bytes", "agent", "tokens"])
    assert stream.judged(frame[:4]) == []
    with pytest.raises(ValueError, match="time falls from 1000 to 3"):
        stream.judged(frame[4:])


def test_empty_tables(spark):
    assert gate.inspections(spark.createDataFrame([], SCHEMA), gate.Policy()).collect() == []
    assert gate.inspections(spark.createDataFrame(rows_of(random.Random(1), 5), SCHEMA), gate.Policy(size=None, repeats=None)).collect() == []
