"""Operator 7: token files of directly addressable codes.

Ids are split into 8-bit chunks, the lowest first.  Level k of a segment holds
the k-th chunks of all ids that have one, a bitmap that says which of them go on
at the next level, and a rank directory (ones before every 512th bit).  Token i
is read by following at most four levels: chunk i, and if its bit is set, chunk
rank(i) of the next level.  Nothing else is decoded.

File format: Parquet in the shared folder, a row a segment of about
``SEGMENT_TOKENS`` ids at document borders: part and within, the ids before it in its
part (their order is the global order), n_tokens, doc_ids, ends (each document's end within the
segment) and the levels as binary columns.  Spark's committer writes them, so a
lost executor leaves no half file.  Documents are range-sorted by doc_id (null
first; repeated doc_ids by text, then by row, so that they needn't share a task), and a document's global start is its segment's
base plus its place; the bases of parts are running sums over their sizes, one
row a write task.

Defined results: a null or empty text has only the end id; repeated rows are
written one by one; an empty table gives an empty result; other columns are
ignored, whatever their names.  doc_ids cross the Arrow steps as text, as pandas
would round large ones beside a null.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiprisk.llm.common import table, text_or_empty
from shiprisk.llm.pretokens import ChunkEncoder, vocabulary
from shiprisk.session import work_dir

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SEGMENT_TOKENS = 1 << 18
LEVELS = 4
RANK_BITS = 512
#: Chunks a worker remembers (some 150 MB).
MEMO = 1_200_000

SCHEMA = ("part int, within long, n_tokens long, doc_ids array<long>, ends array<long>, "
          + ", ".join(f"chunks{k} binary, bits{k} binary, ranks{k} binary" for k in range(LEVELS)))


class Codes:
    """Directly addressable codes of an array of ids below 2**32."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], ids.astype(np.uint32)
        for _ in range(LEVELS):
            more = rest > 255
            bits = np.packbits(more, bitorder="little")
            blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, int)
            ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")
            levels.append(((rest & 255).astype(np.uint8), bits, ranks))
            rest = rest[more] >> 8
        return cls(levels)

    def columns(self) -> dict[str, bytes]:
        out = {}
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out |= {f"chunks{k}": chunks.tobytes(), f"bits{k}": bits.tobytes(), f"ranks{k}": ranks.tobytes()}
        return out

    @classmethod
    def from_columns(cls, row) -> Codes:
        return cls([(np.frombuffer(row[f"chunks{k}"], np.uint8), np.frombuffer(row[f"bits{k}"], np.uint8),
                     np.frombuffer(row[f"ranks{k}"], "<u4")) for k in range(LEVELS)])

    def rank(self, level: int, i: int) -> int:
        """Ones before bit i of a level's bitmap."""
        _, bits, ranks = self.levels[level]
        block = i // RANK_BITS
        ones = int(ranks[block]) + int(np.bitwise_count(bits[block * RANK_BITS // 8:i // 8]).sum())
        return ones + (int(bits[i // 8] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def token(self, i: int) -> int:
        value = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not (bits[i // 8] >> (i % 8)) & 1:
                break
            i = self.rank(k, i)
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop; only they are decoded."""
        out, place = np.zeros(stop - start, np.uint32), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            if start >= stop:
                break
            here = chunks[start:stop].astype(np.uint32) << np.uint32(8 * k)
            place = np.arange(stop - start) if place is None else place
            out[place] |= here
            first = start // 8
            flags = np.unpackbits(bits[first:(stop + 7) // 8], bitorder="little")[start - first * 8:stop - first * 8]
            place = place[flags.astype(bool)]
            start, stop = self.rank(k, start), self.rank(k, stop)
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str) -> ChunkEncoder:
    """Encodes chunks with the tokenizers library; one a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    model, letters = tokenizer.model, vocabulary(path).letter_of

    def many(chunks: list[str]) -> list[bytes]:
        out = {}
        for c in chunks:  # one word of letters is one pre-token: only the model is needed
            if c.lstrip(" ").isalpha():
                found = model.tokenize(c.encode().decode("latin-1").translate(letters))
                out[c] = array("I", [t.id for t in found]).tobytes()
        rest = [c for c in chunks if c not in out]
        for c, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[c] = array("I", e.ids).tobytes()
        return [out[c] for c in chunks]

    return ChunkEncoder(vocabulary(path), many, MEMO)


def write(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = END_ID,
          segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Write the token files of doc_id, text rows to ``folder``."""

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = library_encoder(tokenizer_path)
        held, ids, size, within, part = [], [], 0, 0, 0

        def flush() -> pd.DataFrame:
            ends = np.cumsum([len(a) for a in ids])
            row = {"part": part, "within": within, "n_tokens": int(ends[-1]), "doc_ids": held, "ends": ends.tolist()}
            row |= Codes.build(np.concatenate(ids)).columns()
            return pd.DataFrame({k: pd.Series([v]) for k, v in row.items()})

        end = np.array([end_id], np.uint32)
        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            for doc_id, a in zip(batch["doc_id"], encode.encode(batch["text"].tolist())):
                held.append(None if doc_id is None else int(doc_id))
                ids.append(np.concatenate([a, end]))
                size += len(ids[-1])
                if size >= segment_tokens:
                    yield flush()
                    held, ids, size, within = [], [], 0, within + size
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = ["doc_id", "tie", "row_no"]
    rows = rows.select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row_no"),
                       "text").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    rows.mapInPandas(segments, SCHEMA).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with ``base``, the ids in all segments before."""
    files = spark.read.schema(SCHEMA).parquet(folder)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    # One small row a write task, so the segments needn't move.
    return files.join(F.broadcast(parts), "part").withColumn("base", F.col("ahead") + F.col("within")).drop("ahead")


def documents(segments: DataFrame) -> DataFrame:
    """One row a document of read(): doc_id, start, n_tokens and the checksum of its ids."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                codes = Codes.from_columns(row)
                ends = np.asarray(row["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                held = memoryview(codes.tokens(0, int(ends[-1])).astype("<u4").tobytes())  # all documents follow each other
                sums = [zlib.crc32(held[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                ids = pd.array([None if i is None else int(i) for i in row["doc_ids"]], dtype="Int64")
                yield pd.DataFrame({"doc_id": ids, "start": row["base"] + starts, "n_tokens": ends - starts,
                                    "ids_crc32": np.array(sums, np.int64)})

    segments = segments.withColumn("doc_ids", F.transform("doc_ids", lambda x: x.cast("string")))
    return segments.mapInPandas(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "token-files")
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return documents(read(spark, folder))
