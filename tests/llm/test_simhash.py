"""SimHash near-dedup against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tidewarden.llm import simhash


def plain(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s.encode(), 42) >> bit & 1 for s in shingles) > len(shingles):
            out |= 1 << bit
    return out


def components(rows, prints, distance):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return [least[find(i)] for i in range(len(rows))]


def test_query_equals_brute_force(spark, write_docs):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ÀB", "x y"]
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "one two THREE"), (906, "a b c d"), (907, "a b c d")]
    for g in range(12):
        base = rng.choice(vocabulary, int(rng.integers(60, 400))).tolist()
        for k in range(8):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
            rows.append((g * 50 + 7 * k, " ".join(words) if k % 2 else "\n".join(words).upper()))
    prints = [plain(t) for _, t in rows]
    want = {(d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, components(rows, prints, 4), strict=True)}
    got = {tuple(r) for r in simhash.op3_simhash_near_dedup(spark, write_docs(rows)).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [20_000, 8])
def test_links_of_planted_fingerprints(spark, monkeypatch, hot):
    """Groups around centres, some sharing most bits, connect exactly as all pairs would; also with tiny blocks."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(5)
    prints = set(rng.integers(-(2**63), 2**63 - 1, 40).tolist()) | {0, -1}
    for c in list(prints)[:12]:
        x = c
        for _ in range(10):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= int(np.int64(np.uint64(1 << int(b)).view(np.int64)))
            prints.add(x)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long")
    found = {r["node"]: r["root"] for r in simhash.connected(simhash.links(nodes)).collect()}
    got = [found.get(p, p) for p in prints]
    rows = [(p, "") for p in prints]
    assert got == components(rows, [p & (2**64 - 1) for p in prints], 4)


def test_thresholds_add_up():
    total, ts = simhash.allocate([[0, 5, 50, 500], [0, 1, 2, 3], [0, 9, 90, 900]], 2)
    assert sum(t + 1 for t in ts) == 3 and total == min(5 + 1 + 9, 2 + 5, 3, 50 + 1, 2 + 9)


def test_empty_table(spark, write_docs):
    assert simhash.op3_simhash_near_dedup(spark, write_docs([])).collect() == []


def test_alike_groups_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
    texts = ["", None, " \n", "one two", "One  two", "three"]
    for _ in range(25):
        base = words(rng.randint(60, 300))
        texts += [" ".join(base)] * 2
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(1, 2)):
                copy[rng.randrange(len(copy))] = words(1)[0]
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, _tidewarden_key string")
    got = {r["node"]: r["root"] for r in simhash.alike(docs).collect()}
    key = {t: r["k"] for t, r in zip(texts, docs.select(simhash.text_key().alias("k"), "doc_id").orderBy("doc_id").collect(), strict=True)}
    sets = {t: set(np.concatenate([np.zeros(0, "<u8"), *simhash.shingles((t or "").encode(), 5)]).tolist()) for t in texts}
    close = total = 0
    for a in sets:
        for b in sets:
            both = sets[a] | sets[b]
            if key[a] < key[b] and (not both or len(sets[a] & sets[b]) >= 0.8 * len(both)):
                total += 1
                close += got.get(key[a], key[a]) == got.get(key[b], key[b])
    assert close >= 0.9 * total > 50
    groups = {}
    for t in sets:
        groups.setdefault(got.get(key[t], key[t]), []).append(t)
    for mine in groups.values():  # each has a partner in its group that is truly alike
        for a in mine:
            assert len(mine) == 1 or any(key[a] != key[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in mine)
    assert simhash.alike(docs.limit(0)).collect() == []
