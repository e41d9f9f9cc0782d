"""Order MinHash and media columns against direct computation."""

import hashlib
import tarfile
import zlib
from pathlib import Path

import numpy as np

from tidewarden.llm import common, media, order_minhash

TEXTS = [None, "", "a", "abcd", "abcabcabcabc", "é😀" * 40, "x" * 70_000, "the quick brown fox jumps over the lazy dog " * 20, "same", "same", "\0", "tail\0\0"]


def test_edits_and_order(spark, write_docs):
    rows = [(10 * i - 3, t) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in order_minhash.op5_order_minhash(spark, write_docs(rows)).collect()}
    ordered = sorted(((d, t or "") for d, t in rows), reverse=True)
    assert len(got) == len(rows)
    for k, (doc, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        sig = [order_minhash.signature(order_minhash.codes_of(t)) for t in (text, edited, after)]
        r = got[doc]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (sig[0].tobytes().hex(), sig[1].tobytes().hex())
        assert r["near_edited"] == (sig[0] == sig[1]).mean() and r["near_next"] == (sig[0] == sig[2]).mean()
        if text == edited:
            assert r["near_edited"] == 1


def test_one_and_no_documents(spark, write_docs):
    (r,) = order_minhash.op5_order_minhash(spark, write_docs([(5, "abcdefgh")])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdabcd").hexdigest() and r["near_next"] == 1
    assert order_minhash.op5_order_minhash(spark, write_docs([])).collect() == []


def test_signature_in_pieces_and_plain(monkeypatch):
    rng = np.random.default_rng(0)
    codes = rng.integers(97, 105, 3000).astype(np.uint32)
    whole = order_minhash.signature(codes)
    monkeypatch.setattr(order_minhash, "PIECE", 100)
    assert (order_minhash.signature(codes) == whole).all()
    # A swap of two halves keeps most k-mers but not their order.
    swapped = np.concatenate([codes[1500:], codes[:1500]])
    moved = order_minhash.likeness(whole, order_minhash.signature(swapped))
    changed = codes.copy()
    changed[::600] = 120
    assert order_minhash.likeness(whole, order_minhash.signature(changed)) > moved + 0.15


def test_media_round_trip(spark, write_docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in media.op7_media_columns(spark, write_docs(rows)).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        png, r = media.to_png(payload), got[doc]
        assert media.from_png(png) == payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest())
        assert (r["width"], r["height"], r["feature"]) == (64, len(payload) // 64, media.feature_of(payload))


def test_shards_are_tar_files_with_one_member_a_digest(spark, write_docs, tmp_path):
    folder = f"file://{tmp_path}/media"
    docs = common.table(spark, write_docs([(i, "same text") for i in range(9)] + [(99, "other")]), "documents").coalesce(1)
    manifest = media.store(docs, folder)
    names = []
    for shard in Path(f"{tmp_path}/media").glob("*.tar"):
        with tarfile.open(shard) as t:
            for m in t.getmembers():
                names.append(m.name)
                assert hashlib.sha256(media.from_png(t.extractfile(m).read())).hexdigest() + ".png" == m.name
    assert len(names) == len(set(names)) == manifest.select("digest").distinct().count() == 2


def test_no_media(spark, write_docs):
    assert media.op7_media_columns(spark, write_docs([])).collect() == []
