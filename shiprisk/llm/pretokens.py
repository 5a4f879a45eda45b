"""Byte-level tokenizer files and memoised encoding of text chunks.

A text is cut around special tokens and by the tokenizer's own pre-tokenisation
pattern, but for cuts between letters and digits.  The chunks (mostly a word
with the space before it) repeat, so each worker keeps a bounded memo from chunk
to ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

# Fixed value: White_Space, as the tokenizer's pattern takes it.
_WS = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the public byte-level pre-tokenisation pattern, with White_Space written out.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+"
                     rf"|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
# The same cuts but for those between letters and digits, for the faster standard module.
CHUNK = re.compile(rf" ?[^\W_]+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\w{_WS}]+|_+)+"
                   rf"|[{_WS}]+(?![^{_WS}])|[{_WS}]+")

#: Every Python worker of an executor holds a memo, also while it waits for later stages.
MEMO_CHUNKS = 150_000
MEMO_CHARS = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, next_free = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], next_free = chr(next_free), next_free + 1
    return out


class Vocabulary:
    """Merges, ids and bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        ids = held["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.array([ids[c] for c in byte_letters()], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]]
        self.size = size
        keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.letter_of = dict(enumerate(byte_letters()))
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs))))
        self.merged_list = self.merged.tolist()
        self.special_pattern = re.compile("|".join(
            map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class ChunkEncoder:
    """Whole texts to arrays of ids, through a memo of chunks.

    ``encode_many`` maps a list of chunks to their ids as little-endian unsigned
    32-bit bytes.  Long chunks (MEMO_CHARS or more) aren't kept, and the memo is
    emptied when it is full, so memory stays bounded.
    """

    def __init__(self, vocab: Vocabulary, encode_many: Callable[[list[str]], list[bytes]], bound: int | None = None):
        self.vocab, self.encode_many, self.bound = vocab, encode_many, bound
        self.memo: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        special = self.vocab.special_pattern
        if special is None or not special.search(text):
            return CHUNK.findall(text)
        out, at = [], 0
        for m in special.finditer(text):
            out += [*CHUNK.findall(text[at:m.start()]), m[0]]
            at = m.end()
        return out + CHUNK.findall(text[at:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memo) > (self.bound or MEMO_CHUNKS):
            self.memo.clear()
        memo = self.memo
        if not memo:
            memo |= {t: np.array([i], "<u4").tobytes() for t, i in self.vocab.special.items()}
        cut = [self.chunks(t) for t in texts]
        new = list(set().union(*cut).difference(memo)) if cut else []
        memo.update(zip(new, self.encode_many(new)))
        out = [np.frombuffer(b"".join(map(memo.__getitem__, c)), "<u4") for c in cut]
        for chunk in new:
            if len(chunk) >= MEMO_CHARS:
                del memo[chunk]
        return out
