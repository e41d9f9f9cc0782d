"""Whole texts to token ids of the tokenizers library, without a cache.

The vocabulary drops white space before it splits a text, so the ids of a text are those of its ASCII-space-separated
chunks, one after the other, and a step encodes each distinct chunk once. Chunks of Latin letters and ASCII signs are
lower-cased, cut into pre-tokens and merged by rank in tiktoken, with the end of a word as a byte of its own; all
others (other scripts, combining marks, special tokens) go to the library itself. A tokenizer of any other form
encodes whole texts by the library. Nothing is kept from one step to the next, so memory is bounded by a step.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The form of the tokenizer that chunks and ranks are exact for.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Chunks with other characters, or with what may be a special token, are left to the library. In the ranges left, no
#: character composes or decomposes, each lowers to one character, and none but ASCII is white space.
OTHER = r"[^\x21-\x7e\x{a1}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{148}\x{14a}-\x{17f}]|<\|"
#: Ends a pre-token; it can't occur in one. NUL as a pre-token ends a chunk.
END = b" "


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_of() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks(vocabulary: dict[str, int], suffix: str, special: set[str]) -> dict[bytes, int]:
    """Token bytes, with END at a word's end, and their ids, which are also the order of merges."""
    of = byte_of()
    return {bytes(of[c] for c in s.removesuffix(suffix)) + (END if s.endswith(suffix) else b""): i for s, i in vocabulary.items() if s not in special}


class WordEncoder:
    """Encodes arrays of texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, vocabulary = path, spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        self.size = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.fast = None
        if (
            (spec.get("normalizer") or {}).get("normalizers") == NORMAL
            and len(steps) == 2
            and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": WORDS}, "Removed", True)
            and (steps[1]["type"], steps[1]["add_prefix_space"], steps[1]["use_regex"]) == ("ByteLevel", False, False)
            and spec["model"].get("end_of_word_suffix") == "</w>"
            and not any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and all(t.startswith("<|") for t in special)
        ):
            import tiktoken

            by_rank = ranks(vocabulary, "</w>", special)
            self.mark = by_rank[b"\0" + END]
            # The library needs the name of one special token; nothing is ever read as it.
            self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=by_rank, special_tokens={"<|none|>": self.size})

    @property
    def tok(self):
        return library(self.path)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the bounds of each text in them."""
        if self.fast is None:
            ids, lengths = self._by_library(texts)
            return ids, np.concatenate([[0], np.cumsum(lengths)])
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        lists = self._chunks(coded.dictionary).take(coded.indices)
        first = words.offsets.to_numpy().astype(np.int64)
        return lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)[first - first[0]]

    def _chunks(self, chunks: pa.Array) -> pa.ListArray:
        """The ids of each of some distinct chunks."""
        other = pc.match_substring_regex(chunks, OTHER).to_numpy(zero_copy_only=False)
        plain = chunks.filter(pa.array(~other)) if other.any() else chunks
        cut = pc.replace_substring_regex(pc.utf8_lower(plain), pattern=WORDS, replacement=r"\0 ")
        if len(cut):
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(cut)], cut), "\0 ")[0].as_py()
            ids = self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        else:
            ids = np.zeros(0, np.int32)
        ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
        sizes = np.diff(ends, prepend=-1) - 1 if len(cut) else np.zeros(0, np.int64)
        ids = ids[ids != self.mark]
        if other.any():
            more, lengths = self._by_library(chunks.filter(pa.array(other)))
            order = np.argsort(np.concatenate([np.flatnonzero(~other), np.flatnonzero(other)]), kind="stable")
            bounds = np.cumsum(np.concatenate([[0], sizes, lengths]))
            values = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([ids, more])))
            return values.take(pa.array(order))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids))

    def _by_library(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [np.zeros(0, np.int32)], []
        for at in range(0, len(texts), 1000):
            got = self.tok.encode_batch_fast(texts[at : at + 1000].to_pylist(), add_special_tokens=False)
            ids += [np.array(e.ids, np.int32) for e in got]
            lengths += [len(e.ids) for e in got]
        return np.concatenate(ids), np.array(lengths, np.int64)


@lru_cache(maxsize=1)
def library(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One for each worker process; it holds the vocabulary and nothing of the texts."""
    return WordEncoder(path)
