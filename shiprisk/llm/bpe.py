"""Operator 2: BPE encoding and decoding with a segment tree over pair ranks.

The leaves of a word's tree hold (rank, place) of each adjacent pair, inner
nodes the minimum of their children, so the root is the leftmost pair of the
lowest rank.  A merge changes three leaves (the merged pair, the pair before
and the one that vanishes); each change is carried up in logarithmic time,
until the root says that no pair can be merged.  Short words of like length are
worked on at once, a tree being a row of a numpy array; a long word has a tree
of its own.

Each text is a Pandas-UDF row: no shuffle, and a lost executor costs only its
own batches.  Words are memoised per worker within a bound.

Defined results: a null text encodes as the empty text (0 tokens, the digest of
the empty string); special tokens written out in a text become their ids, as in
the library; a null doc_id is passed on; repeated rows give repeated rows; an
empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shiprisk.llm.common import prepare, table
from shiprisk.llm.pretokens import WORD, ChunkEncoder, Vocabulary, vocabulary

TOKENIZER = "byte_bpe_50k.json"
PLACE_BITS = 28
NONE = np.int64(2**62)
TREE_CELLS = 1 << 19
LONG_WORD = 66


class Merger:
    """BPE of words given as bytes."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab

    def _keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaf values of pairs: rank and place, NONE if the pair can't be merged."""
        v = self.vocab
        pair = left * v.size + right
        at = np.minimum(np.searchsorted(v.pair_keys, pair), len(v.pair_keys) - 1)
        known = (v.pair_keys[at] == pair) & (left >= 0) & (right >= 0)
        return np.where(known, (v.pair_ranks[at] << PLACE_BITS) | place, NONE)

    def merge_all(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._merge_long(w)
                continue
            by_size.setdefault(max(1, (len(w) - 2).bit_length() if len(w) > 1 else 0), []).append(i)
        for bits, members in by_size.items():
            step = max(1, TREE_CELLS >> bits)
            for at in range(0, len(members), step):
                some = members[at:at + step]
                for i, ids in zip(some, self._merge([words[i] for i in some], 1 << bits)):
                    out[i] = ids
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One word, with a tree of its own in plain lists."""
        v, n = self.vocab, len(word)
        symbol = v.byte_ids[np.frombuffer(word, np.uint8)]
        leaves = 1 << (n - 2).bit_length()
        keys = np.full(2 * leaves, NONE, np.int64)
        keys[leaves:leaves + n - 1] = self._keys(symbol[:-1], symbol[1:], np.arange(n - 1))
        for level in range(leaves.bit_length() - 2, -1, -1):
            a, b = 1 << level, 2 << level
            keys[a:b] = np.minimum(keys[b:2 * b:2], keys[b + 1:2 * b:2])
        tree, symbol, none = keys.tolist(), [*symbol.tolist(), -1], int(NONE)
        after, before, mask = list(range(1, n + 2)), list(range(-1, n)), (1 << PLACE_BITS) - 1

        def put(place: int, value: int) -> None:
            node = place + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        def key(a: int, b: int, place: int) -> int:
            rank = v.rank_of.get(a * v.size + b) if a >= 0 and b >= 0 else None
            return none if rank is None else rank << PLACE_BITS | place

        while tree[1] < none:
            left = tree[1] & mask
            gone = after[left]
            symbol[left], symbol[gone] = v.merged_list[tree[1] >> PLACE_BITS], -1
            right = after[gone]
            after[left], before[right] = right, left
            put(gone, none) if gone < n - 1 else None
            put(left, key(symbol[left], symbol[right], left)) if left < n - 1 else None
            prior = before[left]
            if prior >= 0:
                put(prior, key(symbol[prior], symbol[left], prior))
        return np.array([s for s in symbol if s >= 0], np.int64)

    def _merge(self, words: list[bytes], leaves: int) -> list[np.ndarray]:
        """Words of at most ``leaves`` + 1 bytes, all at once."""
        n, width = len(words), leaves + 2  # a dead column at the end stands for "no neighbour"
        end = width - 1
        lengths = np.array([len(w) for w in words])
        filled = np.arange(width)[None, :] < lengths[:, None]
        symbol = np.full((n, width), -1, np.int64)
        symbol[filled] = self.vocab.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.where(np.arange(1, width + 1)[None, :] < lengths[:, None], np.arange(1, width + 1), end)
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        before[:, 0] = end
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        place = np.arange(leaves)
        tree[:, leaves:] = self._keys(symbol[:, :leaves], symbol[:, 1:leaves + 1], place[None, :])
        for level in range(leaves.bit_length() - 2, -1, -1):
            a, b = 1 << level, 2 << level
            tree[:, a:b] = np.minimum(tree[:, b:2 * b:2], tree[:, b + 1:2 * b:2])
        rows = np.nonzero(tree[:, 1] < NONE)[0]
        while len(rows):
            root = tree[rows, 1]
            left = root & ((1 << PLACE_BITS) - 1)
            gone = after[rows, left]
            symbol[rows, left] = self.vocab.merged[root >> PLACE_BITS]
            symbol[rows, gone] = -1
            right, prior = after[rows, gone], before[rows, left]
            after[rows, left], before[rows, right] = right, left
            ours = symbol[rows, left]
            self._set(tree, rows, gone, np.full(len(rows), NONE), leaves)
            self._set(tree, rows, left, self._keys(ours, symbol[rows, right], left), leaves)
            self._set(tree, rows, prior, self._keys(symbol[rows, prior], ours, prior), leaves)
            rows = rows[tree[rows, 1] < NONE]
        return [s[s >= 0] for s in symbol]

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, place: np.ndarray, value: np.ndarray, leaves: int) -> None:
        """Point update of one leaf in each of the rows; places without a leaf are left out."""
        inside = place < leaves
        rows, node = rows[inside], place[inside] + leaves
        tree[rows, node] = value[inside]
        for _ in range(leaves.bit_length() - 1):
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])


class SegmentTreeEncoder(ChunkEncoder):
    """Whole texts to ids and back, the merges made by segment trees."""

    def __init__(self, vocab: Vocabulary):
        super().__init__(vocab, self._encode_chunks)
        self.merger = Merger(vocab)

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        cut = [[w.encode("utf-8", "replace") for w in WORD.findall(c)] for c in chunks]
        words = list({w for c in cut for w in c})
        ids = {w: i.astype("<u4").tobytes() for w, i in zip(words, self.merger.merge_all(words))}
        return [b"".join(map(ids.__getitem__, c)) for c in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> SegmentTreeEncoder:
    """One a worker, so that its memo outlives a batch."""
    return SegmentTreeEncoder(vocabulary(path))


def encode_udf(path: str):
    """Token ids of whole texts."""

    @pandas_udf("array<int>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([a.astype(np.int32) for a in encoder(path).encode([t or "" for t in texts])])

    return of


def decode_udf(path: str):
    """Texts of token ids."""

    @pandas_udf("string")
    def of(ids: pd.Series) -> pd.Series:
        return ids.map(lambda a: encoder(path).decode(a.tolist()))

    return of


def digests_udf(path: str):
    """n_tokens, ids_sha256 and decoded_sha256 of an encoding and its decoding."""

    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(texts: pd.Series) -> pd.DataFrame:
        e, rows = encoder(path), []
        digits = decimal_ids(path)
        for ids in e.encode([t or "" for t in texts]):
            held = ids.tolist()
            listed = ",".join(map(digits.__getitem__, held))
            rows.append((len(held), hashlib.sha256(listed.encode()).hexdigest(),
                         hashlib.sha256(e.decode(held).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return of


@lru_cache(maxsize=2)
def decimal_ids(path: str) -> list[str]:
    return list(map(str, range(vocabulary(path).size)))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    return docs.select("doc_id", digests_udf(path)("text").alias("d")).select("doc_id", "d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the digests of every document's tokens."""
    prepare(spark)
    return round_trip(docs, public_tokenizers.path(TOKENIZER))
