"""The byte-level BPE vocabulary of a tokenizers JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    token_bytes: list[bytes]  # by id; special tokens as their own text
    byte_ids: np.ndarray  # id of each single byte
    left: np.ndarray  # of each merge, by rank
    right: np.ndarray
    merged: np.ndarray
    special: dict[str, int]
    plain: bool

    def ranks_are_ids(self) -> bool:
        """Whether ids grow with ranks, as tiktoken wants it."""
        return bool((np.diff(self.merged) > 0).all() and (self.byte_ids.max() < self.merged.min() if len(self.merged) else True))


def is_plain(spec: dict) -> bool:
    """Whether the file asks for just what this package does itself: byte-level words by the fixed pattern, merges, special tokens as they stand."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and (spec.get("decoder") or {}).get("type") == "ByteLevel"
        and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
        and set(byte_letters()) <= set(model["vocab"])
    )


def library(path: str):
    """The tokenizers library's own encoder, without truncation and padding."""
    import tokenizers

    slow = tokenizers.Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    return slow


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Of a file that isn't plain only that is told; such files are left to the library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not is_plain(spec):
        none = np.zeros(0, np.int64)
        return Vocabulary([], none, none, none, none, {}, False)
    value = {letter: b for b, letter in enumerate(byte_letters())}
    ids = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    token_bytes = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in ids.items():
        token_bytes[i] = token.encode() if token in special else bytes(value[c] for c in token)
    for token, i in special.items():
        token_bytes[i] = token.encode()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    left, right, merged = (np.fromiter(x, np.int64, len(merges)) for x in ((ids[a] for a, _ in merges), (ids[b] for _, b in merges), (ids[a + b] for a, b in merges)))
    byte_ids = np.array([ids[letter] for letter in byte_letters()], np.int64)
    return Vocabulary(token_bytes, byte_ids, left, right, merged, special, True)


#: Fixed value: how texts are cut into words before merges, with white space as Unicode has it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def fast_encoder(path: str):
    """text -> ids as a numpy array of unsigned 32-bit integers, by the same vocabulary in a faster library where its rules allow, else by tokenizers."""
    import tiktoken

    vocabulary, slow = load(path), library(path)
    slowly = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    if not vocabulary.plain or not vocabulary.ranks_are_ids():
        return slowly
    ranks = {vocabulary.token_bytes[i]: int(i) for i in [*vocabulary.byte_ids, *vocabulary.merged]}
    fast = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=vocabulary.special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # its expression engine gives up on very long runs of white space
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return slowly(text)

    return encode
