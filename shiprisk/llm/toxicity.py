"""Operator 1: toxicity with a convolutional text classifier trained in numpy.

A word's vector has four parts: two rows for the word and two sums of rows for
its 5-byte pieces (its ends marked), so that new forms of a stem are known.  Of
each kind the two rows come from different hashes: words or pieces look alike
only if both collide.  Filters of widths 1, 2 and 3 run over the words, each is
max-pooled over the whole text, and a logistic layer weighs the pooled values.
Embeddings start from the class log odds of their buckets and are trained with
the filters by Adagrad.

Thresholds are calibrated by language on a part of the learning rows that was
not trained on.  The language is that of the most frequent function words of
the text itself (never the lang column); a language with too few calibration
rows uses the threshold of all.  score = sigmoid(logit - threshold), so 0.5 is
the calibrated threshold everywhere.

The classifier learns from every labelled row, in Spark tasks.  The texts of the
learning rows are packed (zlib), dealt by doc_id, joined with their labels and
written once.  The class odds come from counts over all of them.  An epoch goes
over the tasks at once: each starts from the same model, trains on its rows batch
by batch and returns what it changed; the new model is the mean of the changes,
of each embedding row over the tasks that changed it.  Thresholds come from counts
of all calibration rows by logit, on a grid of 1/``GRID``.  The driver gets one
model, one table of counts by bucket and one grid, whatever the number of rows.
Scoring is a Pandas UDF over every whole text, in pieces of bounded size that
overlap by the filter width.

Defined results: a null or empty text is scored with all pooled values 0; labels
that are null teach nothing; without labels of both classes every score is 0;
several labels of one document all count; repeated rows score alike; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shiprisk.llm.common import fold, materialise, table

FOLDS = 5
BUCKETS = 1 << 18
DIM = 4
PARTS = 4
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 4
BATCH = 32
RATE = 0.05
DECAY = 1e-4
CALIBRATION_FOLDS = 4
LEAST_ROWS = 15
#: Labels a partition of the learning rows is planned for.
SHARD_ROWS = 8_192
#: Logits are counted on steps of 1/GRID between -LIMIT and LIMIT.
GRID, LIMIT = 1_024, 64
PIECE_WORDS = 8_192

# Frequent function words by language, to choose a threshold.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was with this are be by on as at from not",
    "de": "der die und das ist nicht ein eine mit von den zu auf für im dem sich auch",
    "fr": "le la les des et un une est que pour dans qui sur pas par au du de ce",
    "es": "el la los las que y en un una es por con para del se no su lo de",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]

#: ASCII punctuation separates words, but for the apostrophe.
SEPARATE = bytes(32 if chr(b) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def word_list(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(SEPARATE).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words))


def _buckets(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ((hashes & np.uint64(BUCKETS - 1)).astype(np.int64),
            ((hashes >> np.uint64(32)) & np.uint64(BUCKETS - 1)).astype(np.int64))


class Words:
    """The distinct words of some texts: their hashes and the hashes of their 5-byte pieces."""

    def __init__(self, texts: list[list[bytes]]):
        distinct = list(dict.fromkeys(w for t in texts for w in t))
        number = dict(zip(distinct, range(len(distinct))))
        self.docs = [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]
        self.hashes = word_hashes(distinct)
        self.word_buckets = _buckets(self.hashes)
        lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
        self.counts = np.maximum(lengths - 2, 1)
        self.starts = _starts(self.counts)
        # Each word is written with one space before it and four after it; its pieces start at that space.
        data = np.frombuffer(b" " + b"     ".join(distinct) + b"    ", np.uint8).astype(np.uint64)
        piece = np.zeros(max(0, len(data) - 4), np.uint64)
        for i in range(5):
            piece = (piece << np.uint64(8)) | data[i:i + len(piece)]
        inside = np.arange(int(self.counts.sum())) - np.repeat(self.starts, self.counts)
        chosen = piece[np.repeat(_starts(lengths + 5), self.counts) + inside] if len(distinct) else piece[:0]
        mixed = chosen * np.uint64(0x9E3779B97F4A7C15)
        self.piece_buckets = _buckets(mixed ^ (mixed >> np.uint64(31)))

    def __len__(self) -> int:
        return len(self.hashes)

    def pieces_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the pieces of some words, and which of the words each belongs to."""
        counts = self.counts[ids]
        owner = np.repeat(np.arange(len(ids)), counts)
        return np.repeat(self.starts[ids] - _starts(counts), counts) + np.arange(len(owner)), owner


def _function_table() -> np.ndarray:
    """Bit k of an entry: a function word of language k falls in that bucket of the first hash."""
    out = np.zeros(BUCKETS, np.uint8)
    for k, words in enumerate(FUNCTION_WORDS.values()):
        out[_buckets(word_hashes(words.encode().split()))[0]] |= 1 << k
    return out


def _starts(lengths: np.ndarray) -> np.ndarray:
    return (np.cumsum(lengths) - lengths).astype(np.int64)


@dataclass
class Classifier:
    tables: list[np.ndarray]
    kernels: dict[int, np.ndarray]  # width -> (width, 2 DIM, FILTERS)
    offsets: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES), np.float32))

    @classmethod
    def start(cls, odds: list[np.ndarray], rng: np.random.Generator) -> Classifier:
        tables = []
        for known in odds:
            t = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
            t[:, 0] += known
            tables.append(t)
        kernels = {}
        for w in WIDTHS:
            kern = rng.normal(0, 0.1, (w, PARTS * DIM, FILTERS)).astype(np.float32)
            kern[0, 0:2 * DIM:DIM, :FILTERS // 2] += 1.0
            kern[0, 2 * DIM::DIM, FILTERS // 4:3 * FILTERS // 4] += 1.0
            kernels[w] = kern
        offsets = {w: np.full(FILTERS, -0.2, np.float32) for w in WIDTHS}
        return cls(tables, kernels, offsets, np.full(len(WIDTHS) * FILTERS, 0.3, np.float32), -2.0)

    def vectors(self, words: Words, ids: np.ndarray | None = None) -> np.ndarray:
        """Of the chosen distinct words, or of all."""
        ids = np.arange(len(words)) if ids is None else ids
        out = np.zeros((len(ids), PARTS * DIM), np.float32)
        if len(ids):
            pieces, _ = words.pieces_of(ids)
            first = _starts(words.counts[ids])
            for k in range(2):
                out[:, k * DIM:(k + 1) * DIM] = np.take(self.tables[k], words.word_buckets[k][ids], axis=0)
                held = np.take(self.tables[2 + k], words.piece_buckets[k][pieces], axis=0)
                out[:, (2 + k) * DIM:(3 + k) * DIM] = np.add.reduceat(held, first)
        return out

    def responses(self, x: np.ndarray, w: int, at: np.ndarray) -> np.ndarray:
        """Filter values of the windows that start at rows ``at`` (words); minus infinity elsewhere."""
        n, kern = len(x), self.kernels[w]
        if w > 1:
            x = np.concatenate([x, np.zeros((w - 1, x.shape[1]), np.float32)])
        out = x[:n] @ kern[0]
        for o in range(1, w):
            out += x[o:o + n] @ kern[o]
        out += self.offsets[w]
        gap = np.ones(n, bool)
        gap[at] = False
        out[gap] = -np.inf
        return out

    @staticmethod
    def joined(vectors: np.ndarray, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of the pieces' words, each piece followed by zero rows; where pieces start; rows of the words."""
        lengths = np.array([len(p) + max(WIDTHS) - 1 for p in pieces])
        starts = _starts(lengths)
        at = np.concatenate([np.arange(s, s + len(p)) for s, p in zip(starts, pieces)])
        x = np.zeros((int(lengths.sum()), PARTS * DIM), np.float32)
        x[at] = np.take(vectors, np.concatenate(pieces), axis=0)
        return x, starts, at

    def pooled(self, vectors: np.ndarray, pieces: list[np.ndarray]) -> np.ndarray:
        """Rectified maxima, one row a (non-empty) piece; windows at its end are filled up with zero vectors."""
        x, starts, at = self.joined(vectors, pieces)
        tops = [np.maximum.reduceat(self.responses(x, w, at), starts) for w in WIDTHS]
        return np.maximum(np.concatenate(tops, axis=1), 0)

    def logits(self, words: Words) -> np.ndarray:
        """Of whole texts."""
        vectors, docs = self.vectors(words), words.docs
        out = np.zeros((len(docs), len(WIDTHS) * FILTERS), np.float32)
        held, owner, size = [], [], 0
        step = PIECE_WORDS - max(WIDTHS) + 1
        for i, d in enumerate(docs):
            for at in range(0, len(d), step):
                held.append(d[at:at + PIECE_WORDS])
                owner.append(i)
                size += len(held[-1])
                if size >= PIECE_WORDS:
                    np.maximum.at(out, owner, self.pooled(vectors, held))
                    held, owner, size = [], [], 0
        if held:
            np.maximum.at(out, owner, self.pooled(vectors, held))
        return out @ self.weights + self.bias

    def scores(self, words: Words, functions: np.ndarray) -> np.ndarray:
        z = self.logits(words) - self.thresholds[languages(words, functions)]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


def languages(words: Words, functions: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES: whose function words are the most frequent (none: other)."""
    out = np.full(len(words.docs), len(LANGUAGES) - 1)
    marks = functions[words.word_buckets[0]]
    for i, d in enumerate(words.docs):
        here = marks[d]
        here = here[here > 0]
        if len(here):
            out[i] = int(np.argmax([np.count_nonzero(here & (1 << k)) for k in range(len(FUNCTION_WORDS))]))
    return out


def _presence(words: Words, chosen: np.ndarray, y: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """Texts of each class that have a bucket: kinds of parts x classes x buckets; added to ``seen``, if given."""
    seen = np.zeros((PARTS, 2, BUCKETS), np.int64) if seen is None else seen
    for i in chosen:
        ids = np.unique(words.docs[i])
        pieces = words.pieces_of(ids)[0]
        for k in range(2):
            seen[k, y[i], np.unique(words.word_buckets[k][ids])] += 1
            seen[2 + k, y[i], np.unique(words.piece_buckets[k][pieces])] += 1
    return seen


def _class_odds(seen: np.ndarray, n0: int, n1: int) -> list[np.ndarray]:
    """Log odds of each bucket's presence, clipped, and small where the shares of the classes hardly differ."""
    p0, p1 = (seen[:, 0] + 0.5) / (max(1, n0) + 1), (seen[:, 1] + 0.5) / (max(1, n1) + 1)
    return list((np.clip(np.log(p1 / p0), -3, 3) / 3 * np.minimum(1, np.abs(p1 - p0) * 10)).astype(np.float32))


class Trainer:
    """Adagrad on the logistic loss; only the words that won a pooling get a gradient."""

    def __init__(self, seen: np.ndarray, n0: int, n1: int, seed: int = 11):
        self.model = m = Classifier.start(_class_odds(seen, n0, n1), np.random.default_rng(seed))
        self.squares = {f"t{k}": np.full(BUCKETS, 1e-2, np.float32) for k in range(PARTS)}
        self.squares |= {"weights": np.full_like(m.weights, 1e-2), "bias": np.float32(1e-2)}
        for w in WIDTHS:
            self.squares[f"k{w}"] = np.full_like(m.kernels[w], 1e-2)
            self.squares[f"o{w}"] = np.full_like(m.offsets[w], 1e-2)
        self.toxic_weight = float(np.clip(n0 / max(1, n1), 0.2, 5.0))

    def epoch(self, words: Words, y: np.ndarray, chosen: np.ndarray, rng: np.random.Generator) -> None:
        order = rng.permutation([i for i in chosen if len(words.docs[i])])
        for at in range(0, len(order), BATCH):
            self.step(words, y, order[at:at + BATCH])

    def dense(self) -> np.ndarray:
        """Values and squares (a column each) of all parameters but the embeddings."""
        m, q = self.model, self.squares
        held = [(m.weights, q["weights"]), (np.array([m.bias]), np.array([q["bias"]]))]
        held += [(m.kernels[w], q[f"k{w}"]) for w in WIDTHS] + [(m.offsets[w], q[f"o{w}"]) for w in WIDTHS]
        return np.concatenate([np.stack([v.ravel(), x.ravel()], axis=1) for v, x in held]).astype(np.float64)

    def set_dense(self, held: np.ndarray) -> None:
        m, q, at = self.model, self.squares, 0

        def take(like: np.ndarray, column: int) -> np.ndarray:
            return held[at:at + like.size, column].reshape(like.shape).astype(np.float32)

        m.weights, q["weights"], at = take(m.weights, 0), take(m.weights, 1), at + m.weights.size
        m.bias, q["bias"], at = float(held[at, 0]), np.float32(held[at, 1]), at + 1
        for values, letter in ((m.kernels, "k"), (m.offsets, "o")):
            for w in WIDTHS:
                like = values[w]
                values[w], q[f"{letter}{w}"] = take(like, 0), take(like, 1)
                at += like.size

    def changes(self, start: Trainer, rows: int) -> Iterator[pd.DataFrame]:
        """What differs from ``start``, a row a bucket (parts 0 to 3) or dense parameter (part 4), as ``CHANGES``."""
        for k in range(PARTS):
            at = np.nonzero(self.squares[f"t{k}"] != start.squares[f"t{k}"])[0]
            moved = np.concatenate([self.model.tables[k][at] - start.model.tables[k][at],
                                    (self.squares[f"t{k}"][at] - start.squares[f"t{k}"][at])[:, None]], axis=1)
            yield _change_rows(k, at, moved, rows)
        moved = self.dense() - start.dense()
        yield _change_rows(PARTS, np.arange(len(moved)), np.pad(moved, ((0, 0), (0, DIM - 1))), rows)

    def moved(self, part: np.ndarray, at: np.ndarray, by: np.ndarray) -> None:
        """Add mean changes."""
        for k in range(PARTS):
            own = part == k
            self.model.tables[k][at[own]] += by[own, :DIM].astype(np.float32)
            self.squares[f"t{k}"][at[own]] += by[own, DIM].astype(np.float32)
        own, held = part == PARTS, self.dense()
        held[at[own]] += by[own, :2]
        self.set_dense(held)

    def step(self, words: Words, y: np.ndarray, batch: np.ndarray) -> None:
        m = self.model
        pieces = [words.docs[i] for i in batch]
        ids, local = np.unique(np.concatenate(pieces), return_inverse=True)
        local = np.split(local, np.cumsum([len(p) for p in pieces])[:-1])
        x, starts, real_rows = m.joined(m.vectors(words, ids), local)
        word_at = np.full(len(x), -1)
        word_at[real_rows] = ids[np.concatenate(local)]
        rows = np.arange(len(x))
        lengths = np.diff(np.concatenate([starts, [len(x)]]))
        best, at = [], []
        for w in WIDTHS:
            r = m.responses(x, w, real_rows)
            top = np.maximum.reduceat(r, starts)
            first = np.where(r == np.repeat(top, lengths, axis=0), rows[:, None], len(x))
            best.append(top)
            at.append(np.minimum.reduceat(first, starts))
        pooled = np.maximum(np.concatenate(best, axis=1), 0)
        z = pooled @ m.weights + m.bias
        toxic = y[batch].astype(np.float32)
        weight = np.where(toxic == 1, np.float32(self.toxic_weight), np.float32(1))
        error = (1 / (1 + np.exp(-z)) - toxic) * weight / len(batch)
        to_pool = error[:, None] * m.weights[None, :] * (pooled > 0)
        self._move("weights", m.weights, pooled.T @ error + DECAY * m.weights)
        m.bias -= RATE * float(error.sum()) / np.sqrt(self._square("bias", float(error.sum())))
        where, gradient = [], []
        for k, w in enumerate(WIDTHS):
            g = to_pool[:, k * FILTERS:(k + 1) * FILTERS]
            kern, moved = m.kernels[w], np.zeros_like(m.kernels[w])
            for o in range(w):
                spot = np.minimum(at[k] + o, len(x) - 1)
                inside = (at[k] + o < len(x)) & (word_at[spot] >= 0)
                moved[o] = np.einsum("bf,bfd->df", g * inside, x[spot])
                b, f = np.nonzero(inside & (g != 0))
                where.append(word_at[spot[b, f]])
                gradient.append(g[b, f][:, None] * kern[o].T[f])
            self._move(f"k{w}", kern, moved + DECAY * kern)
            self._move(f"o{w}", m.offsets[w], g.sum(axis=0))
        won = np.concatenate(where)
        if len(won):
            per_word = np.concatenate(gradient)
            pieces, owner = words.pieces_of(won)
            for k in range(2):
                self._move_rows(k, words.word_buckets[k][won], per_word[:, k * DIM:(k + 1) * DIM])
                self._move_rows(2 + k, words.piece_buckets[k][pieces],
                                per_word[owner, (2 + k) * DIM:(3 + k) * DIM])

    def _move_rows(self, k: int, buckets: np.ndarray, gradient: np.ndarray) -> None:
        ids, back = np.unique(buckets, return_inverse=True)
        total = np.zeros((len(ids), DIM), np.float32)
        np.add.at(total, back, gradient)
        total += DECAY * self.model.tables[k][ids]
        self.squares[f"t{k}"][ids] += (total**2).mean(axis=1)
        self.model.tables[k][ids] -= RATE * total / np.sqrt(self.squares[f"t{k}"][ids])[:, None]

    def _square(self, name: str, gradient):
        self.squares[name] = self.squares[name] + gradient * gradient
        return self.squares[name]

    def _move(self, name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        value -= (RATE * gradient / np.sqrt(self._square(name, gradient))).astype(np.float32)


def _change_rows(part: int, at: np.ndarray, moved: np.ndarray, rows: int) -> pd.DataFrame:
    out = pd.DataFrame(moved.astype(np.float64), columns=VALUES)
    return out.assign(part=np.int32(part), at=at.astype(np.int32), rows=np.int64(rows))[["part", "at", *VALUES, "rows"]]


VALUES = [f"v{i}" for i in range(DIM + 1)]
CHANGES = "part int, at int, " + ", ".join(f"{v} double" for v in VALUES) + ", rows long"


def threshold(z: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> float:
    """The cut with the best balanced accuracy, in the middle of the widest best gap; each value counts ``times``."""
    times = np.ones(len(z), np.int64) if times is None else times
    order = np.argsort(z, kind="stable")
    z, y, times = z[order], y[order], times[order]
    ones, zeros = y * times, (1 - y) * times
    n1, n0 = max(1, ones.sum()), max(1, zeros.sum())
    below1 = np.concatenate([[0], np.cumsum(ones)])
    below0 = np.concatenate([[0], np.cumsum(zeros)])
    quality = below0 / n0 + (n1 - below1) / n1
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    gap = edges[1:] - edges[:-1]
    # Between equal logits there is no cut.
    quality[1:-1][gap[1:-1] == 0] = -1
    best = np.nonzero(quality >= quality.max() - 1e-12)[0]
    k = best[np.argmax(gap[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def calibrate(model: Classifier, z: np.ndarray, lang: np.ndarray, y: np.ndarray, times: np.ndarray) -> None:
    """Thresholds from logits, languages and classes, each row standing for ``times`` texts."""
    n1, n0 = (y * times).sum(), ((1 - y) * times).sum()
    if not (n1 and n0):
        return
    model.thresholds[:] = threshold(z, y, times)
    for k in range(len(LANGUAGES)):
        own = lang == k
        if min((y * times)[own].sum(), ((1 - y) * times)[own].sum()) >= LEAST_ROWS:
            model.thresholds[k] = threshold(z[own], y[own], times[own])


def fit(texts: list[str | None], y: np.ndarray, late: np.ndarray) -> Classifier:
    """Train on the texts that aren't ``late``, calibrate on those that are; what ``train`` does, in one task."""
    words = Words([word_list(t) for t in texts])
    if not 0 < y[~late].sum() < (~late).sum():
        late = np.zeros(len(y), bool)
    chosen = np.nonzero(~late)[0]
    n1 = int(y[chosen].sum())
    trainer = Trainer(_presence(words, chosen, y), len(chosen) - n1, n1)
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        trainer.epoch(words, y, chosen, rng)
    z = trainer.model.logits(words)
    calibrate(trainer.model, z[late], languages(words, _function_table())[late], y[late], np.ones(late.sum(), np.int64))
    return trainer.model


def packed_udf():
    """Texts as zlib binaries, a third of their size."""

    @pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else zlib.compress(t.encode("utf-8", "replace"), 1) for t in texts])

    return of


def _words(batch: pd.DataFrame) -> tuple[Words, np.ndarray]:
    texts = ["" if b is None else zlib.decompress(b).decode("utf-8", "replace") for b in batch["packed"]]
    return Words([word_list(t) for t in texts]), batch["toxic"].to_numpy(np.int64)


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(packed, toxic, late) of every labelled document, written once.  Both sides are dealt by doc_id and not shuffled again."""
    labels = labels.filter("toxic in (0, 1) and doc_id is not null")
    shards = max(1, -(-labels.count() // SHARD_ROWS))
    texts = docs.filter("doc_id is not null").select("doc_id", packed_udf()("text").alias("packed")).repartition(shards, "doc_id")
    late = fold(F.concat_ws(":", F.lit("calibrate"), F.col("doc_id").cast("string")), CALIBRATION_FOLDS) == 0
    joined = texts.join(labels.repartition(shards, "doc_id"), "doc_id")
    return materialise(joined.select("packed", F.col("toxic").cast("int").alias("toxic"), late.alias("late")), "toxicity-rows")


def _counted(rows: DataFrame) -> np.ndarray:
    """``_presence`` over all rows."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((PARTS, 2, BUCKETS), np.int64)
        for batch in batches:
            words, y = _words(batch)
            _presence(words, np.arange(len(y)), y, seen)
        for k in range(PARTS):
            at = np.nonzero(seen[k].any(axis=0))[0]
            yield pd.DataFrame({"part": np.full(len(at), k, np.int32), "at": at.astype(np.int32),
                                "n0": seen[k, 0, at], "n1": seen[k, 1, at]})

    found = rows.mapInPandas(of, "part int, at int, n0 long, n1 long").groupBy("part", "at").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most PARTS x BUCKETS rows
    part, at, n0, n1 = (found[c].to_numpy() for c in ("part", "at", "n0", "n1"))
    seen = np.zeros((PARTS, 2, BUCKETS), np.int64)
    seen[part, 0, at], seen[part, 1, at] = n0, n1
    return seen


def _epoch(rows: DataFrame, trainer: Trainer, number: int) -> None:
    """One pass over all rows: tasks train on their own from the same start, and their changes are averaged."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, n = deepcopy(trainer), 0
        rng = np.random.default_rng([11, number])
        for batch in batches:
            words, y = _words(batch)
            own.epoch(words, y, np.arange(len(y)), rng)
            n += len(y)
        if n:
            yield from own.changes(trainer, n)

    moved = rows.mapInPandas(learn, CHANGES).groupBy("part", "at").agg(
        *[(F.sum(F.col(v) * F.col("rows")) / F.sum("rows")).alias(v) for v in VALUES]).toArrow()  # one model
    trainer.moved(moved["part"].to_numpy(), moved["at"].to_numpy(), np.stack([moved[v].to_numpy() for v in VALUES], axis=1))


def _calibrated(rows: DataFrame, model: Classifier) -> None:
    """Thresholds from the logits of all rows, counted on a grid."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        functions = _function_table()
        for batch in batches:
            words, y = _words(batch)
            z = np.clip(model.logits(words).astype(np.float64), -LIMIT, LIMIT)
            yield pd.DataFrame({"lang": languages(words, functions).astype(np.int32), "toxic": y.astype(np.int32),
                                "step": np.round(z * GRID).astype(np.int32)})

    found = rows.mapInPandas(of, "lang int, toxic int, step int").groupBy("lang", "toxic", "step").agg(
        F.count(F.lit(1)).alias("n")).toArrow()  # bounded by the grid
    if found.num_rows:
        lang, y, step, n = (found[c].to_numpy() for c in ("lang", "toxic", "step", "n"))
        calibrate(model, step / GRID, lang, y.astype(np.int64), n)


def train(rows: DataFrame) -> Classifier | None:
    """(packed, toxic, late) rows -> classifier, None without rows of both classes."""
    per = {(r["toxic"], r["late"]): r["n"] for r in rows.groupBy("toxic", "late").agg(F.count("*").alias("n")).collect()}
    if len({toxic for toxic, _ in per}) < 2:
        return None
    n0, n1 = per.get((0, False), 0), per.get((1, False), 0)
    apart = bool(n0 and n1)
    if not apart:
        n0, n1 = (sum(n for (toxic, _), n in per.items() if toxic == c) for c in (0, 1))
    early = rows.filter(~F.col("late")) if apart else rows
    trainer = Trainer(_counted(early), n0, n1)
    for number in range(EPOCHS):
        _epoch(early, trainer, number)
    if apart:
        _calibrated(rows.filter("late"), trainer.model)
    return trainer.model


def score(text: Column, model: Classifier | None) -> Column:
    """Toxicity of a text, 0 to 1."""
    if model is None:
        return F.lit(0.0)

    @pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        functions = _function_table()
        for texts in batches:
            yield pd.Series(model.scores(Words([word_list(t) for t in texts]), functions))

    return of(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", fold(F.col("doc_id"), FOLDS) == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(learning_rows(docs.filter(~F.col("held_out")), labels))
    scored = docs.select("doc_id", "held_out", score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
