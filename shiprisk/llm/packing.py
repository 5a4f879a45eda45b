"""Operator 13: packing by lexical retrieval.

Documents become fixed windows of tokens.  What fills whole windows of a long
document is a sequence by itself; its tail, like every shorter document, is
packed with its lexical neighbours: in each shard a BM25 inverted index over
token ids returns the unused neighbours of a seed document, best first, and they
fill the seed's window greedily.  The neighbour that no longer fits is cut; its
rest is the next seed.  So only the last window of a shard is not full, and it
is cut into sequences of powers of two, which need no padding.

Document frequencies, the number of documents and their mean length are counted
over all documents; the frequencies are a row a vocabulary entry, so their size
is bounded.  Shards are runs of at most ``SHARD_DOCS`` documents (or
``SHARD_POSTINGS`` postings) of a global range sort by two weighted min-hashes of a
document's tokens (rarer ids, by their place in the vocabulary, weigh more) and a
row number: neighbours tend to share a shard, and copies, however many, are dealt
over as many shards as they need.  Shards are what a task holds in memory, and
each document is in one.

Defined results: a null or empty text has only the end id and is packed as any
other; repeated rows, and a null doc_id, are packed one by one; ties of the score
go by the sort order; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiprisk.llm.common import materialise, prepare, table, text_or_empty
from shiprisk.llm.pretokens import byte_letters

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
WINDOW = 2048
K1, B = 1.2, 0.75
SHARD_DOCS = 1_024
SHARD_POSTINGS = 4_000_000
DENSE = 8
SEED = 1313

MEMO_WORDS = 1_000_000
MEMO_BYTES = 64
PIECE = 1_000_000
SPACE = " \t\n\x0b\x0c\r"
# Cuts of a word where the tokenizer's pattern cuts as well: its contractions, letters and digits, the rest.
RUN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W_]+|(?:[^\w\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|_)+")

DOCS = ("id string, row_no long, n long, crcs array<long>, tail binary, key1 int, key2 int, terms binary, tfs binary, "
        "held binary")
PIECES = ("id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def text_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that end before white space."""
    at = 0
    while len(text) - at > size:
        end = min((i for i in (text.find(c, at + size) for c in SPACE) if i >= 0), default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


class Memo(dict):
    """A bounded memo of ``make``; long keys aren't kept, and a full memo starts anew at ``trim``."""

    def __init__(self, make: Callable, bound: int, longest: int):
        super().__init__()
        self.make, self.bound, self.longest = make, bound, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) < self.longest:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.bound:
            self.clear()


class WordEncoder:
    """Whole texts to ids, through bounded memos.

    The tokenizer drops white space and never looks across it, so the ids of the
    words between ASCII white space, one after the other, are the text's.  A new
    word is cut into runs of letters and digits, contractions and the rest, where
    the tokenizer cuts too; a run of letters needs only the tokenizer's merges.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.letters = dict(enumerate(byte_letters()))
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.special = tuple(t.content for t in special)
        self.words = Memo(self._word, MEMO_WORDS, MEMO_BYTES)
        self.runs = Memo(self._run, MEMO_WORDS, MEMO_BYTES)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of one run, as little-endian unsigned 32-bit bytes."""
        if run.isascii():
            if not run.isalpha():
                return self._library(run)
        else:
            # Lower-cased letter by letter: a sigma's form doesn't depend on its place.
            run = "".join(map(str.lower, run)) if "\u03a3" in run else run.lower()
            if not run.isalpha():
                return self._library(run)
            run = run.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(run)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.lower().decode()  # ASCII capitals only
        if text.isascii():
            if text.isalpha():
                return self.runs[text]
            if text[-1] in ".,;:!?" and text[:-1].isalpha():
                return self.runs[text[:-1]] + self.runs[text[-1]]
        else:
            # A dotted capital I becomes two characters, and composition may reach over a cut.
            if "\u0130" in text or not unicodedata.is_normalized("NFC", text):
                return self._library(word.decode())
        if "<|" in text and any(s in word.decode() for s in self.special):
            return self._library(word.decode())
        return b"".join(map(self.runs.__getitem__, RUN.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        out = []
        for piece in text_pieces(text):
            self.words.trim()
            self.runs.trim()
            out.append(b"".join(map(self.words.__getitem__, piece.encode("utf-8", "replace").split())))
        return np.frombuffer(b"".join(out), "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=2)
def races(size: int) -> np.ndarray:
    """Two independent exponential races over the vocabulary; the rate grows with the id."""
    return np.random.default_rng(SEED).exponential(size=(2, size)) / (1.0 + np.arange(size))


def narrow(size: int) -> np.dtype:
    """The integer type that holds every id of a vocabulary."""
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, rising, and how often each occurs (16-bit ids are radix-sorted)."""
    ids = np.sort(ids, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[starts].astype(np.int64), np.diff(starts, append=len(ids))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, doc_id: str, text: str, path: str, end_id: int, window: int) -> DataFrame:
    """DOCS: ``terms`` and ``tfs`` of documents longer than a window (those of others are in their tail).

    The last row of a task also has ``held``, how many of the task's documents hold each id.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        kind, race, end = narrow(max(encode.size, end_id + 1)), races(encode.size), np.array([end_id], "<u4")
        seen, out = np.zeros(encode.size, np.int64), None
        for batch in filter(len, batches):
            if out is not None:
                yield out
            rows = []
            for text in batch["text"]:
                ids = encode.encode(text)
                terms, tfs = distinct(ids.astype(kind))
                seen[terms] += 1
                keys = terms[race[:, terms].argmin(axis=1)].tolist() if len(terms) else [0, 0]
                ids = np.concatenate([ids, end])
                whole = len(ids) // window * window
                crcs = [crc(ids[a:a + window]) for a in range(0, whole, window)]
                long = (terms.astype(kind).tobytes(), tfs.astype("<u4").tobytes()) if whole else (b"", b"")
                rows.append((len(ids), crcs, ids[whole:].astype(kind).tobytes(), *keys, *long, None))
            out = pd.DataFrame(rows, columns=["n", "crcs", "tail", "key1", "key2", "terms", "tfs", "held"])
            out = pd.concat([batch[["id", "row_no"]], out], axis=1)
        if out is not None:
            out.at[out.index[-1], "held"] = seen.astype("<i8").tobytes()
            yield out

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.monotonically_increasing_id().alias("row_no"),
                       text_or_empty(text).alias("text"))
    return rows.mapInPandas(each, DOCS)


def terms_of(tail: bytes, terms: bytes, tfs: bytes, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of a document, without its end id, and how often each occurs."""
    if terms:
        return np.frombuffer(terms, kind).astype(np.int64), np.frombuffer(tfs, "<u4").astype(np.int64)
    return distinct(np.frombuffer(tail, kind)[:-1])


def document_frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each id: a count a task and id, then one a vocabulary entry."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            for counts in batch["held"]:
                seen += np.frombuffer(counts, "<i8")
        at = np.nonzero(seen)[0]
        yield pd.DataFrame({"term": at, "df": seen[at]})

    out = np.zeros(size, np.int64)
    per = docs.filter("held is not null").select("held").mapInPandas(count, "term long, df long").groupBy("term").agg(
        F.sum("df").alias("df"))
    for r in per.collect():  # at most a row a vocabulary entry
        out[r.term] = r.df
    return out


class Index:
    """BM25 inverted index of a shard: postings by term, with their weights.

    Terms in over a ``DENSE``-th of the documents have a weight for every document
    instead, which adds up faster.
    """

    def __init__(self, terms: list[np.ndarray], tfs: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray,
                 mean: float):
        self.docs = len(terms)
        doc = np.repeat(np.arange(self.docs), [len(t) for t in terms])
        term, tf = np.concatenate(terms), np.concatenate(tfs).astype(np.float64)
        order = np.argsort(term, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(idf)))])
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(mean, 1e-9)))
        self.doc, self.weight = doc[order], weight[order]
        frequent = np.nonzero(np.diff(self.starts) * DENSE > self.docs)[0]
        self.row = np.full(len(idf), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.docs), np.float32)
        inside = self.row[term] >= 0
        self.dense[self.row[term[inside]], doc[inside]] = weight[inside]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every document of the shard for a query of distinct terms."""
        row = self.row[terms]
        common, rare = row >= 0, terms[row < 0]
        return np.add.reduce(self.dense[row[common]], axis=0) + self._postings(rare)

    def _postings(self, terms: np.ndarray) -> np.ndarray:
        spans = list(map(slice, self.starts[terms].tolist(), self.starts[terms + 1].tolist()))
        if not spans:
            return np.zeros(self.docs)
        return np.bincount(np.concatenate(list(map(self.doc.__getitem__, spans))),
                           np.concatenate(list(map(self.weight.__getitem__, spans))), minlength=self.docs)


def fill(lengths: np.ndarray, index: Index, terms: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start in its tail, length); all but the last are full."""
    left, at = lengths.copy(), np.zeros(len(lengths), np.int64)
    out, cut, first = [], -1, 0
    while True:
        while cut < 0 and first < len(left) and not left[first]:
            first += 1
        seed = cut if cut >= 0 else first
        if seed == len(left):
            return out
        room, cut, pieces, queue = window, -1, [], iter([seed])
        while room:
            d = next(queue, None)
            if d is None:
                free = np.nonzero(left)[0]
                if not len(free):
                    break
                scores = index.scores(terms[seed])[free]
                queue = iter(free[np.argsort(-scores, kind="stable")].tolist())
                continue
            k = int(min(left[d], room))
            pieces.append((d, int(at[d]), k))
            at[d] += k
            left[d] -= k
            room -= k
            if left[d]:
                cut = d
        out.append(pieces)


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut into sequences whose lengths are powers of two, the longest first."""
    rest, out = list(reversed(pieces)), []
    total = sum(k for _, _, k in pieces)
    for bit in reversed(range(total.bit_length())):
        room = 1 << bit
        if not total & room:
            continue
        part = []
        while room:
            d, at, k = rest.pop()
            part.append((d, at, min(k, room)))
            if k > room:
                rest.append((d, at + room, k - room))
            room -= part[-1][2]
        out.append(part)
    return out


def pack_shard(docs: list[tuple], idf: np.ndarray, mean: float, window: int, kind: np.dtype, number: int
               ) -> pd.DataFrame:
    """Pieces of a shard's (id, n, crcs, tail, terms, tfs); sequences are numbered from ``number``."""
    out = []
    for id_, n, crcs, *_ in docs:
        for i, value in enumerate(crcs):
            out.append((id_, i * window, window, value, n, number, 0))
            number += 1
    tails = [np.frombuffer(tail, kind) for _, _, _, tail, _, _ in docs]
    terms, tfs = zip(*((t, f) for _, _, _, *held, t, f in docs))
    index = Index(list(terms), list(tfs), np.array([n for _, n, *_ in docs], np.float64), idf, mean)
    sequences = fill(np.array([len(t) for t in tails], np.int64), index, list(terms), window)
    if sequences and sum(k for _, _, k in sequences[-1]) < window:
        sequences += powers_of_two(sequences.pop())
    for pieces in sequences:
        offset = 0
        for d, at, k in pieces:
            id_, n, crcs, *_ = docs[d]
            out.append((id_, len(crcs) * window + at, k, crc(tails[d][at:at + k]), n, number, offset))
            offset += k
        number += 1
    return pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
         window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    prepare(docs.sparkSession)
    size = encoder(tokenizer_path).size
    kind = narrow(max(size, end_id + 1))
    held = materialise(tokenised(docs, doc_id, text, tokenizer_path, end_id, window), "pack-tokens")
    rows, total = held.agg(F.count("*"), F.sum("n")).first()
    df = document_frequencies(held, size)
    idf = np.log1p((rows - df + 0.5) / (df + 0.5))
    mean = (total or 0) / max(rows, 1)

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, postings, number = [], 0, None
        for batch in batches:
            for part, id_, n, crcs, tail, *rest in batch.itertuples(index=False, name=None):
                number = part << 40 if number is None else number
                found, tfs = terms_of(tail, *rest, kind)
                shard.append((id_, n, crcs, tail, found, tfs))
                postings += len(found)
                if len(shard) >= shard_docs or postings >= SHARD_POSTINGS:
                    out = pack_shard(shard, idf, mean, window, kind, number)
                    yield out
                    shard, postings, number = [], 0, int(out["sequence_id"].iat[-1]) + 1
        if shard:
            yield pack_shard(shard, idf, mean, window, kind, number)

    order = ["key1", "key2", "row_no"]
    dealt = held.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.spark_partition_id().cast("long").alias("part"), "id", "n", "crcs", "tail", "terms", "tfs")
    out = dealt.mapInPandas(shards, PIECES)
    return out.select(F.col("id").cast(docs.schema[doc_id].dataType).alias("doc_id"), *out.columns[1:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
