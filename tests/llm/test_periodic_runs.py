"""Runs against a search by the definition, and the whole query against the same."""

import hashlib
import random
import zlib

import numpy as np

from tidewarden.llm import periodic_runs as P


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng, n, kinds, most=12):
    w = [rng.randint(0, kinds) for _ in range(n)]
    if n and rng.random() < 0.7:
        a, p = rng.randrange(n), rng.randint(1, most)
        w = [w[i] if i < a else w[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(n)]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(n)] = rng.randint(0, 4)
    return w


def test_runs_equal_the_definition():
    rng, found = random.Random(1), 0
    for _ in range(600):
        docs = sorted((periodic(rng, rng.randint(0, 60), rng.choice([1, 2, 4, 9])) for _ in range(rng.randint(1, 4))), key=lambda d: -len(d))
        words = [x for r, d in enumerate(docs) for x in [*d, 1000 + r]]
        got = list(zip(*(x.tolist() for x in P.runs(np.array(words), np.array([len(d) + 1 for d in docs]))), strict=True))
        want, at = [], 0
        for d in docs:
            want += [(s + at, m, q) for s, m, q in plain_runs(d)]
            at += len(d) + 1
        assert got == sorted(want, key=lambda r: (r[0], r[2]))
        found += len(got)
    assert found > 200


def test_long_periods():
    rng = random.Random(2)
    base = [rng.randint(0, 10**6) for _ in range(700)]
    w = [*range(2_000_000, 2_000_100), *(base * 5)[:3100], *range(3_000_000, 3_000_050), *([7] * 5000)]
    got = list(zip(*(x.tolist() for x in P.runs(np.array([*w, -5]), np.array([len(w) + 1]))), strict=True))
    assert got == [(100, 3100, 700), (3250, 5000, 1)]


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    head = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_the_definition(spark, write_docs):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{x}é" for x in periodic(rng, rng.randint(1, 80), 5))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (None, "a " * 9), (503, "b c\x0bd\x1cd " * 7), (503, "b c\x0bd\x1cd " * 7), (504, "x " * 4000)]
    key = lambda r: [(x is None, x if x is not None else 0) for x in r]
    sf = write_docs(rows)
    out = P.op12_periodic_runs(spark, sf)
    got = sorted((tuple(r) for r in out.collect()), key=key)
    assert got == sorted((plain_row(d, t) for d, t in rows), key=key)
    assert sum(r[1] for r in got) > 30 and out.columns == P.SCHEMA.names


def test_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b", 9, "x")], "doc_id long, text string, start long, runs_sha256 string")
    (r,) = P.described(docs).collect()
    assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (1, 0, 6, 1, 6000)
    assert P.described(docs.limit(0)).collect() == []
