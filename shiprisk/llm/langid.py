"""Operator 3: language identification with bit-sliced n-gram Bloom filters.

Every learned language has a Bloom filter of its typical character n-grams.
The filters are bit-sliced: position p of all filters is one word of language
bits, so a look-up is the AND of a few words and yields all languages that
contain the n-gram, however many languages there are.  A text's n-grams are
counted per language by popcounts over that bit plane; a language's count is
corrected for the false positives its filter's fill predicts
((hits - n * f) / (n - n * f), f = fill**hashes), and the largest corrected
share wins.

An n-gram is typical of a language if its share there is at least ``TYPICAL``
of its largest share in any language and it was seen ``LEAST_SEEN`` times; that
keeps stray foreign words and wrong labels out of a filter.  The n-grams are
counted by Spark over a sample of about ``SAMPLE`` learning texts a language
(a documented bound on what the classifier is fitted on; whole texts are
counted), and the filters are sized by the n-grams kept.

Defined results: a null text, or one without a letter, gives ``und`` and score
0; a text with letters whose n-grams no filter holds gets the language with the
most learning rows (ties: the first by code point), score 0; without a single
learned language there is none to name, and every text gives ``und``, score 0;
ties go to the first language by code point; a null lang is not learned;
repeated rows are judged alike; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shiprisk.llm.common import fold, materialise, sample_place, table

SIZES = (2, 3, 4)
SAMPLE = 1_500
TYPICAL = 0.5
LEAST_SEEN = 3
HASHES = 2
BITS_PER_GRAM = 24
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

PIECE = 200_000


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def codes_of(text: str | None) -> np.ndarray:
    """Code points of the lower-cased words between single spaces, a space at either end (no letter: empty)."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64)
    codes = np.concatenate([[32], np.where(letter, codes, 32), [32]])
    gap = codes == 32
    return codes[~gap | np.concatenate([[True], ~gap[:-1]])].astype(np.uint64)


def grams(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the ``size``-grams of an array of code points (equal grams, equal hashes)."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h *= np.uint64(0x100000001B3)
        h ^= codes[i:n + i]
        h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def positions(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The filter positions of n-gram hashes, ``bits`` a power of two."""
    for i in range(HASHES):
        mixed = hashes * np.uint64(2 * i + 0x9E3779B97F4A7C15)
        yield (mixed >> np.uint64(40 - 17 * i)) & np.uint64(bits - 1)


@dataclass
class Filters:
    """Bit-sliced filters: plane k holds languages 64k to 64k + 63."""

    languages: list[str]
    planes: list[np.ndarray]
    false_positive: np.ndarray
    usual: str = UNKNOWN  # for letters that no filter knows

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray], usual: str = UNKNOWN) -> Filters:
        """members: n-gram hashes of each language."""
        most = max([1, *map(len, members)])
        bits = 1 << max(10, int(np.ceil(np.log2(most * BITS_PER_GRAM))))
        planes = [np.zeros(bits, np.uint64) for _ in range(0, max(1, len(languages)), 64)]
        fill = np.zeros(len(languages))
        for k, hashes in enumerate(members):
            mark = np.uint64(1) << np.uint64(k % 64)
            for at in positions(hashes, bits):
                planes[k // 64][at] |= mark
            fill[k] = np.count_nonzero(planes[k // 64] & mark) / bits
        return cls(languages, planes, fill ** HASHES, usual)

    def shares(self, codes: np.ndarray) -> np.ndarray:
        """Corrected share of a text's n-grams that each language contains."""
        hits, n = np.zeros(len(self.languages)), 0
        for start in range(0, len(codes), PIECE):  # bounded memory for very long texts
            for size in SIZES:
                part = grams(codes[start:start + PIECE + size - 1], size)
                n += len(part)
                at = list(positions(part, len(self.planes[0])))
                for k, plane in enumerate(self.planes):
                    held = plane[at[0]]
                    for p in at[1:]:
                        held &= plane[p]
                    for bit in range(min(64, len(self.languages) - 64 * k)):
                        hits[64 * k + bit] += np.count_nonzero(held & (np.uint64(1) << np.uint64(bit)))
        if not n:
            return hits
        return np.clip((hits / n - self.false_positive) / (1 - self.false_positive), 0.0, 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = codes_of(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        share = self.shares(codes)
        best = int(share.argmax())
        return (self.languages[best], float(share[best])) if share[best] > 0 else (self.usual, 0.0)


def learn(rows: DataFrame, *, sample: int = SAMPLE) -> Filters:
    """Filters from (key, text, lang) rows; null langs are left out."""
    rows = rows.filter("lang is not null")
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return Filters([], [], np.zeros(0))
    languages = sorted(per)
    # One row a language: small against any text.
    shares = rows.sparkSession.createDataFrame([(k, min(1.0, sample / n)) for k, n in per.items()], "lang string, take double")
    chosen = rows.withColumn("at", sample_place(F.col("key"))).join(F.broadcast(shares), "lang").filter(
        F.col("at") < F.col("take"))
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                each = [codes_of(t) for t in part["text"]]
                gram = np.concatenate([grams(codes, size) for codes in each for size in SIZES])
                gram, n = np.unique(gram, return_counts=True)
                yield pd.DataFrame({"gram": gram.view(np.int64), "lang": np.int32(number[lang]), "n": n})

    counted = chosen.select("lang", "text").mapInPandas(count, "gram long, lang int, n long")
    counted = materialise(counted.groupBy("gram", "lang").agg(F.sum("n").alias("n")), "lang-grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counted.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    kept = shares.join(most, "gram").filter(F.col("share") >= F.col("most") * TYPICAL).filter(
        F.col("n") >= LEAST_SEEN).select("gram", "lang").toPandas()
    members = [np.sort(kept.loc[kept["lang"] == i, "gram"].to_numpy(np.int64)).view(np.uint64)
               for i in range(len(languages))]
    return Filters.build(languages, members, min(languages, key=lambda lang: (-per[lang], lang)))


def predicted(text: Column, filters: Filters) -> Column:
    """Struct of lang_pred and score."""
    @pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([filters.predict(t) for t in texts], columns=["lang_pred", "score"])

    return of(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)
    filters = learn(docs.filter(~F.col("held_out")).select(F.col("doc_id").alias("key"), "text", "lang"))
    return docs.select("doc_id", "held_out", predicted(F.col("text"), filters).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")
