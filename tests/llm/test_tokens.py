"""Token file and packing against the tokenizer itself."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewarden.llm import packing, token_file, tokens

TEXTS = ["", None, "  a  b\x0bc d  ", "don't it's X'll <|endoftext|>, a<|endoftext|>. 12,3. a…, ß ſ ΣΑΣ \x1c x\x85y 'tis 's,", "İstanbul é é ﬁ Ǆ", "日本語、テスト。 x.", "a_b. c-d- (e) [f]; ́, x́,", "word " * 5000, "same", "same"]


def ids_of(text, end):
    return [*tokens.encoder(tokens.vocabulary_path()).tok.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def unlike(texts):
    """Texts whose ids are others than the library's."""
    enc = tokens.encoder(tokens.vocabulary_path())
    assert enc.fast
    ids, bounds = enc.encode(pa.array(texts, pa.string()))
    want = enc.tok.encode_batch_fast(texts, add_special_tokens=False)
    return [t for k, t in enumerate(texts) if ids[bounds[k] : bounds[k + 1]].tolist() != want[k].ids]


def test_ids_are_those_of_the_library():
    assert unlike([t or "" for t in TEXTS]) == []
    assert unlike([]) == []
    assert tokens.encoder(tokens.vocabulary_path()).encode(pa.array(['"-İ_#"']))[0].tolist() == tokens.library(tokens.vocabulary_path()).encode('"-İ_#"').ids
    sliced = pa.array(["q", "ab cd", "", "ef <|endoftext|>"]).slice(1)
    ids, bounds = tokens.encoder(tokens.vocabulary_path()).encode(sliced)
    assert [[*ids[a:z].tolist(), 9] for a, z in zip(bounds, bounds[1:])] == [ids_of(t, 9) for t in sliced.to_pylist()]


def test_every_character_is_encoded_as_by_the_library():
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x20000))]
    assert unlike([x for c in points for x in (f"a{c}.", f"{c}x'{c}s")]) == []


@pytest.mark.parametrize("pool", ["abcdefgzIİ_#'-.,<|>1290 \t\n\x0b\x1c\x85éÉßſŒœªµºÀÿĀņňŉŊ½²×÷«»\u0301\u093c\u0958ə", "ab", "abcdefghijklmnopqrstuvwxyz", "lmtd's re'v "])
def test_random_texts_are_encoded_as_by_the_library(pool):
    rng = random.Random(pool)
    assert unlike(["".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(20_000)] + ["".join(rng.choices(pool, k=2000)) for _ in range(50)]) == []


def test_every_token_is_what_its_own_text_merges_to():
    """Then merging by the rank of the merged bytes is merging by the library's list of pairs."""
    with open(tokens.vocabulary_path(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    special = {t for t in model["vocab"] if t.startswith("<|")}
    rank = tokens.ranks(model["vocab"], "</w>", special)
    raw = dict(zip((t for t in model["vocab"] if t not in special), rank, strict=True))
    for a, b in model["merges"]:
        want = [raw[a], raw[b]]
        parts = [bytes([x]) for x in b"".join(want)]
        while len(parts) > 2:
            k = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 1 << 30))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert parts == want


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    enc = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a  b", "", " x\ny"]
    ids, bounds = enc.encode(pa.array(texts))
    assert enc.fast is None and [ids[a:z].tolist() for a, z in zip(bounds, bounds[1:])] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_huffman_round_trip(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(2, 5000))
    ids = np.minimum(rng.zipf(1.3, int(rng.integers(1, 4000))) - 1, size - 1)
    counts = np.bincount(ids, minlength=size)
    longest = max(int(np.ceil(np.log2(max(2, (counts > 0).sum())))), int(rng.integers(12, 21)))
    lengths = token_file.code_lengths(counts, longest)
    assert lengths.max() <= longest and (lengths > 0).sum() == (counts > 0).sum()
    assert (0.5 ** lengths[lengths > 0]).sum() <= 1
    bits, marks = token_file.pack(ids, token_file.canonical(lengths), lengths)
    assert (token_file.Decoder(lengths).decode(bits, marks, len(ids)) == ids).all()


def test_code_lengths_are_optimal_without_a_tight_limit():
    import heapq

    counts = np.array([5, 1, 0, 9, 12, 40, 3, 3, 77])
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert (token_file.code_lengths(counts, 20) * counts).sum() == cost


def test_token_file_query(spark, write_docs):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    got = {r["doc_id"]: r for r in token_file.op1_token_file(spark, write_docs(rows)).collect()}
    at = 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = ids_of(t, 2)
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_token_file_of_no_documents(spark, write_docs):
    assert token_file.op1_token_file(spark, write_docs([])).collect() == []


def best_fit(lengths, capacity):
    """Sequential best-fit decreasing."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_whole_and_as_good_as_best_fit(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [17, 65, 40, 10][seed], 500).tolist()
    df = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    by = {}
    for r in packing.packed(df, 64).collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(map(len, by.values())) == len(lengths)
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) == best_fit(lengths, 64)


def filled(lengths, capacity):
    """Sequences that the rounds give, after checks that each is gapless and no place is taken twice."""
    by = {}
    for n, runs in packing.rounds({n: lengths.count(n) for n in set(lengths)}, capacity).items():
        ends = [r[0] for r in runs[1:]] + [lengths.count(n)]
        for (rank, first, per, offset), end in zip(runs, ends, strict=True):
            for k in range(end - rank):
                by.setdefault(first + k // per, []).append((offset + k % per * n, n))
    assert sum(map(len, by.values())) == len(lengths)
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_rounds_make_as_many_sequences_as_best_fit_decreasing():
    assert filled([475] * 6 + [401] * 4 + [292] * 5, 2048) == 3
    rng = random.Random(5)
    for _ in range(4000):
        capacity = rng.choice([10, 64, 2048])
        top = rng.randint(1, capacity)
        lengths = [n for n in (rng.randint(1, top) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 7))]
        assert filled(lengths, capacity) == best_fit(lengths, capacity)


def test_packing_of_repeated_rows_and_rows_without_an_id(spark, write_docs):
    rows = [(None, "a b"), (7, "c"), (7, "c"), (7, "d e f")]
    got = packing.op4_best_fit_packing(spark, write_docs(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 3), (7, 2), (7, 2), (7, 4)]
    assert {r["sequence_id"] for r in got} == {0} and sorted(r["offset"] for r in got)[0] == 0 and sum(r["length"] for r in got) == 11


def test_packing_query(spark, write_docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {(r["doc_id"], r["piece"]): r for r in packing.op4_best_fit_packing(spark, write_docs(rows)).collect()}
    n = 0
    for k, t in rows:
        ids = ids_of(t, 0)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            r, part = got[k, piece], ids[at : at + 2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(part), crc(part))
            n += 1
    assert n == len(got)


def test_packing_nothing(spark, write_docs):
    assert packing.op4_best_fit_packing(spark, write_docs([])).collect() == []
