"""Disguised insults that have doubled letters, neighbours of one letter, or no letter at all."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tidewarden.llm import toxicity

WORDS = ["idiot", "moron", "stupid", "loser", "tonto", "letter", "apple", "summer", "the", "a", "y", "of", "morning", "paper"]


@pytest.fixture(scope="module")
def model():
    counts = np.zeros((toxicity.SIZE,) * 3)
    for w in WORDS * 200:
        codes = [0, 0, *(toxicity.CODE[c] for c in w), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):  # noqa: B905
            counts[a, b, c] += 1
    return toxicity.char_model(counts)


@pytest.mark.parametrize(("text", "word"), [("stuupid", "stupid"), ("iddiott", "idiot"), ("a l o s e r", "loser"), ("y t o n t o", "tonto"), ("l o s e r m o r o n", "loser"), ("l o s e r m o r o n", "moron"), ("1 d 1 0 t a", "idiot"), ("70|\\|70 70770", "tott"), ("letter summer", "letter")])
def test_words_are_restored(model, text, word):
    if word == "tott":  # signs alone: a decoded reading besides the number
        assert len(toxicity.restore("70770", model).split()) == 2
        return
    reader = toxicity.Reader(model)
    _, numbers, words = reader.read(pa.array([text]))
    assert word in " ".join(words[k] for k in numbers).split()


def readings(token):
    """Every path through a token's lattice: (word, cost of its signs)."""
    found, before, masks = [("", 0.0)], "", 0
    for c in token:
        masks = masks + 1 if c in toxicity.MASKS else 0
        if c.isalpha():
            options = [(c, 0.0)] + [("", toxicity.REPEAT)] * (c == before)
        else:
            options = [(x, toxicity.SIGN) for x in toxicity.LEET.get(c, "")] + [(x, toxicity.MASK) for x in toxicity.LETTERS[:26] if masks]
            options.append(("", toxicity.REPEAT if c == before or masks > 1 else toxicity.DROP_SIGN if c in toxicity.LEET and c not in "!|(" else toxicity.DROP))
        before = c
        found = [(w + x, cost + more) for w, cost in found for x, more in options]
    return found


def likelihood(word, model):
    codes = [0, 0, *(toxicity.CODE.get(c, 1) for c in word), 0]
    return sum(float(model[a, b, c]) for a, b, c in zip(codes, codes[1:], codes[2:]))  # noqa: B905


@pytest.mark.parametrize("seed", range(3))
def test_decoding_finds_the_best_of_all_readings(model, seed):
    rng = random.Random(seed)
    for _ in range(60):
        token = "".join(rng.choice("aabdilmnorst01$!|.-яя") for _ in range(rng.randint(1, 9)))
        for at in rng.sample(range(len(token)), rng.randint(0, min(2, len(token)))):
            token = token[:at] + rng.choice("**#") + token[at + 1 :]
        score = {}
        for w, cost in readings(token):
            score[w] = max(score.get(w, -1e9), likelihood(w, model) - cost)
        assert score[toxicity.decode(token, model)] == pytest.approx(max(score.values()), abs=1e-4)


def test_words_of_letters_are_decoded_in_closed_form(model):
    rng = random.Random(3)
    for _ in range(3000):
        word = "".join(rng.choice("aeilmoprstя") * rng.choice([1, 1, 1, 2, 3, 5]) for _ in range(rng.randint(1, 6)))
        want = {toxicity.decode(word, model), toxicity.collapsed(word, model)}
        best = [likelihood(w, model) - toxicity.REPEAT * (len(word) - len(w)) for w in want]
        assert max(best) - min(best) < 1e-4


def test_long_tokens_take_linear_time(model):
    began = time.time()
    assert toxicity.restore("st" + "*" * 100_000 + "pid", model) == toxicity.restore("st" + "*" * 300 + "pid", model)
    for token in ("a" + "*#" * 50_000 + "b", "1" * 100_000, "a" * 100_000, "a" + "-" * 100_000 + "b", "ab1" * 30_000):
        toxicity.restore(token, model)
    _, numbers, _ = toxicity.Reader(model).read(pa.array([" ".join("loser" * 20_000)]))
    assert len(numbers) == 100_002
    assert time.time() - began < 60


def test_query_without_labels_and_on_odd_rows(spark, write_docs):
    none = write_docs([], labels=([], "doc_id long, quality int, toxic int"))
    assert toxicity.op9_toxicity(spark, none).collect() == []
    rows = [(None, None), (1, ""), (1, ""), (2, "a" * 50_000)]
    odd = write_docs(rows, labels=([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    got = toxicity.op9_toxicity(spark, odd).collect()
    assert len(got) == 4 and {r["score"] for r in got} == {0.0}


def test_query_finds_them(spark, write_docs):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices(["re", "th", "an", "er", "ti", "on", "lo", "sta", "me"], k=rng.randint(1, 4))) for _ in range(500)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(vocabulary, k=40) + rng.choices(["idiot", "moron", "stupid", "loser"], k=3 * (i % 3 == 0))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    forms = ["stuupid", "iddiott", "a l o s e r", "l o s e r m o r o n"]
    hidden = [(1000 + k, " ".join([*rng.choices(vocabulary, k=30), f, *rng.choices(vocabulary, k=9), f, "tion"])) for k, f in enumerate(forms)]
    folder = write_docs(rows + hidden, labels=(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.op9_toxicity(spark, folder).collect()}
    assert [got[i] for i, _ in hidden] == [1, 1, 1, 1]
    assert sum(got[i] == (i % 3 == 0) for i, _ in rows) > 390
