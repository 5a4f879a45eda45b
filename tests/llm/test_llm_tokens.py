"""Operators 2 and 7: tokens against the tokenizers library, files against the codes' definition."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

pytest.importorskip("shiprisk.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

import llm_data as data  # noqa: E402

from shiprisk.llm import bpe, pretokens, tokenfiles  # noqa: E402
from shiprisk.llm.common import prepare  # noqa: E402

PATH = public_tokenizers.path(bpe.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


PIECES = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "​",
          "a", "B", "é", "ß", "日本", "1", "٣", "²", "½", "'s", "'ll", "'", "!", ".", "_",
          "<|endoftext|>", "<|", "|>", "\U0001f600", "é", "the", "token", "\x00", "�"]


def test_segment_tree_and_library_memo_agree_with_the_library(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [text or "" for _, text, *_ in data.rows() + data.awkward()]
    tree = bpe.SegmentTreeEncoder(pretokens.vocabulary(PATH))
    memo = tokenfiles.library_encoder(PATH)
    for text, a, b in zip(texts, tree.encode(texts), memo.encode(texts)):
        ids = library_ids(library, text)
        assert a.tolist() == ids and b.tolist() == ids, repr(text[:80])
        assert tree.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_large_ids_beside_a_null_come_back_exact(spark, tmp_root):
    prepare(spark)
    ids = [None, 2**53 + 1, 2**53 + 3, -(2**60) - 1, 5, 5, 5]
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    for parts in (1, 4):
        folder = f"{tmp_root}/{parts}"
        tokenfiles.write(df.repartition(parts), folder, PATH, segment_tokens=6)
        got = [r.doc_id for r in tokenfiles.documents(tokenfiles.read(spark, folder)).orderBy("start").collect()]
        assert got == sorted(ids, key=lambda i: (i is not None, i))


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 4000, "日" * 900, " " * 500, "!" * 900, "x" * 66, "x" * 67])
def test_words_of_any_length(library, text):
    tree = bpe.SegmentTreeEncoder(pretokens.vocabulary(PATH))
    assert tree.encode([text])[0].tolist() == library_ids(library, text)


def test_memo_stays_bounded(library, monkeypatch):
    monkeypatch.setattr(pretokens, "MEMO_CHUNKS", 50)
    tree = bpe.SegmentTreeEncoder(pretokens.vocabulary(PATH))
    for _, text, *_ in data.rows(20):
        assert tree.encode([text])[0].tolist() == library_ids(library, text)
    assert len(tree.memo) < 50 + 400


def test_a_full_memo_is_small_beside_an_executor():
    """Every worker of an executor holds one, and keeps it while later stages run."""
    tree = pretokens.ChunkEncoder(pretokens.vocabulary(PATH), lambda chunks: [b"abcd"] * len(chunks))
    most = 0
    for at in range(0, 300_000, 2_000):
        tree.encode([" ".join(f"w{i}" for i in range(at, at + 2_000))])
        most = max(most, len(tree.memo))
    assert most <= 160_000


def test_round_trip_query(spark, tmp_root, library):
    held = data.rows() + data.awkward()
    folder = data.save(spark, tmp_root, documents=data.documents(spark, held))
    got = sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                  for r in bpe.query(spark, folder).collect()), key=str)
    want = []
    for doc_id, text, *_ in held:
        ids = library_ids(library, text)
        want.append((doc_id is None, doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_ids_and_texts_as_columns(spark, library):
    prepare(spark)
    df = spark.createDataFrame(data.rows(10), data.SCHEMA)
    out = df.select("text", bpe.encode_udf(PATH)("text").alias("ids")).withColumn("back", bpe.decode_udf(PATH)("ids"))
    for r in out.collect():
        assert r.ids == library_ids(library, r.text) and r.back == r.text


def test_codes_give_random_access():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 60_000, 3000), rng.integers(0, 2**32, 400), [0, 255, 256, 2**32 - 1]])
    codes = tokenfiles.Codes.build(ids)
    again = tokenfiles.Codes.from_columns(codes.columns())
    assert [again.token(i) for i in range(len(ids))] == ids.tolist()
    for a, b in [(0, len(ids)), (5, 5), (511, 513), (17, 1900), (len(ids) - 1, len(ids))]:
        assert (again.tokens(a, b) == ids[a:b]).all()


def expected_files(library, held):
    """Brute force over distinct doc_ids: start, length and checksum."""
    out, start = {}, 0
    for doc_id, text in sorted(held):
        ids = np.array([*library_ids(library, text), 0], "<u4")
        out[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_token_files_query(spark, tmp_root, library):
    held = data.rows(80, seed=9)
    folder = data.save(spark, tmp_root, documents=data.documents(spark, held))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.query(spark, folder).collect()}
    assert got == expected_files(library, [(r[0], r[1]) for r in held])


def test_token_files_with_awkward_rows_and_small_segments(spark, tmp_root, library):
    prepare(spark)
    held = data.rows(30) + data.awkward()
    tokenfiles.write(data.documents(spark, held), f"{tmp_root}/files", PATH, segment_tokens=500)
    segments = tokenfiles.read(spark, f"{tmp_root}/files")
    assert segments.count() > 5
    got = sorted(((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in tokenfiles.documents(segments).collect()))
    upto = 0
    for start, n, _, _ in got:  # no gaps, no overlaps
        assert start == upto
        upto += n
    order = [g[3] for g in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))  # null first, then ascending
    want = sorted(zlib.crc32(np.array([*library_ids(library, t), 0], "<u4").tobytes()) for _, t, *_ in held)
    assert sorted(g[2] for g in got) == want


def test_empty_tables(spark, tmp_root):
    folder = data.save(spark, tmp_root, documents=spark.createDataFrame([], data.SCHEMA))
    assert bpe.query(spark, folder).count() == 0
    assert tokenfiles.query(spark, folder).count() == 0
