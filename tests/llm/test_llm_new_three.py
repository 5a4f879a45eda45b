"""Operators 11 to 13: tries, whitening and packing against brute force."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

pytest.importorskip("shiprisk.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

import llm_data as data  # noqa: E402

from shiprisk.llm import packing, prefixtrie, whitening  # noqa: E402
from shiprisk.llm.common import prepare  # noqa: E402

PATH = public_tokenizers.path(packing.TOKENIZER)


# ---- operator 11

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """{(depth, path): row} of the contract, by following every prefix of every conversation."""
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            held[c].append(((turn is not None, turn or 0, digest), (role, text)))
    order = {c: [t for _, t in sorted(v)] for c, v in held.items()}
    built = {}
    for c, own in order.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(np.fix(c / 100)) * 100
        built[c] = order.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    own = {p: (len(m) - 1) * (len(p[-1][1]) if p else 0) for p, m in members.items()}
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += own[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(4)
    out = []
    for c in [*range(-3, 420), 10**12 + 7, 10**12]:
        turns = [(rng.choice(["user", "assistant"]), rng.choice(["hi", "ja", "é 日本", "ok then"]))
                 for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.4:
            turns = [("user", "same"), ("assistant", "answer"), ("user", "same")]  # a group of copies
        out += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    out += [(7, None, None, "first"), (7, None, "user", None), (8, 0, "user", "tie"), (8, 0, "user", "tie"),
            (None, 1, "user", "no conversation"), (500, 3, None, None), (600, 1, "u", "x" * 5000)]
    out += [(700, k, "user", f"long {k % 3}") for k in range(800)] + [(701, k, "user", f"long {k % 3}") for k in range(790)]
    return out


@pytest.mark.parametrize("shard_turns", [10**6, 300, 40])
def test_trie_equals_every_prefix_of_every_conversation(spark, shard_turns):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(5).selectExpr(
        "*", "1 AS part", "'n' AS node", "0 AS depth", "array(1) AS codes", "2 AS code", "'x' AS name")
    got = prefixtrie.trie(df, shard_turns=shard_turns)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_trie_of_one_group_of_copies_over_many_shards_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK", 3)
    rows = [(c, k, "user", "abc") for c in range(1, 90) for k in range(c % 7 + 1)]
    df = spark.createDataFrame(rows, TURNS)
    assert sorted(map(tuple, prefixtrie.trie(df, shard_turns=9).collect()), key=repr) == plain_trie(rows)
    empty = prefixtrie.trie(spark.createDataFrame([], TURNS))
    assert empty.collect() == [] and empty.columns[:2] == ["conv_id", "depth"]
    assert prefixtrie.trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).collect() == []


def test_tree_is_balanced_by_median_insertion():
    tree = prefixtrie.Tree()
    for k in prefixtrie.medians(1023):
        tree.insert([k], [1])
    depth = {tree.down[0]: 1}
    for at in range(1, len(tree.code)):
        for side in (tree.lower, tree.higher):
            if side[at] >= 0:
                depth[side[at]] = depth[at] + 1
    assert max(depth.values()) == 10


# ---- operator 12

VECTORS = "vec_id long, embedding array<float>, label int"


def numpy_whitened(rows, k=8):
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    cov = np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], x.shape[1])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vectors / np.sqrt(values), values / np.trace(cov)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 12)) * np.linspace(2, 0.2, 12)
    rows = [(i, base[i].tolist(), 1) for i in range(300)] + [(7, base[7].tolist(), 1), (None, base[8].tolist(), None)]
    bad = [(900, None, 1), (901, [], 1), (902, [None] * 12, 1), (903, [float("nan")] * 12, 1),
           (904, [float("inf")] + [0.0] * 11, 1), (905, [1.0, 2.0], 1), (2**60, None, 0)]
    df = spark.createDataFrame(rows + bad, VECTORS).repartition(4).selectExpr("*", "0 AS c", "1 AS n", "2 AS w", "'i' AS id")
    got = whitening.whiten(df).collect()
    deviation, want, explained = numpy_whitened(rows)
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {len(rows)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-12
    for k in range(8):
        mine = {r.vec_id: r for r in got if r.component == k + 1}
        sign = np.sign(mine[0].whitened * want[0, k])
        for (i, *_), d, w in zip(rows, deviation, want):
            assert mine[i].deviation == d
            assert mine[i].whitened == pytest.approx(sign * w[k], abs=1e-9)
        assert mine[0].explained == pytest.approx(explained[k], rel=1e-12)


def test_whitening_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.standard_normal(9).tolist(), 0) for i in range(200)], VECTORS)
    first, second = (whitening.whiten(df.repartition(p)).orderBy("vec_id", "component").collect() for p in (1, 7))
    for a, b in zip(first, second, strict=True):
        assert (a.vec_id, a.component, a.deviation, a.explained) == (b.vec_id, b.component, b.deviation, b.explained)
        assert a.whitened == pytest.approx(b.whitened, rel=1e-12, abs=1e-13)  # products of a batch may differ in the last bit


def test_whitening_of_nothing_constants_and_large_ids(spark):
    empty = whitening.whiten(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and empty.columns[:2] == ["vec_id", "component"]
    alike = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], VECTORS)
    assert whitening.whiten(alike).collect() == []
    rows = [(2**53 + 1, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (2**53 + 3, [3.0, 0.5], 0)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.vec_id for r in got} == {2**53 + 1, None, 2**53 + 3} and {r.component for r in got} == {1, 2}


@pytest.mark.parametrize("kind", ["random", "equal", "clusters", "diagonal", "low rank"])
def test_eigenpairs(kind):
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 10, 60):
        a = rng.standard_normal((n, n))
        v = {"random": a @ a.T, "equal": 3 * np.eye(n), "diagonal": np.diag(np.round(3 * rng.random(n)) + 1),
             "clusters": (q := np.linalg.qr(a)[0]) @ np.diag(5 + 1e-9 * np.arange(n)) @ q.T,
             "low rank": a[:, :2] @ a[:, :2].T}[kind]
        values, c = whitening.leading_eigenpairs(v, 8)
        want = np.linalg.eigvalsh(v)[::-1][:8]
        assert np.abs(values - want).max() <= 1e-13 * want[0] * n
        assert np.abs(v @ c - c * values).max() <= 1e-13 * want[0] * n
        assert np.abs(c.T @ c - np.eye(len(values))).max() <= 1e-13 * n
        d, e, mirrors = whitening.householder(v)
        t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
        q = whitening.reflect(np.eye(n), mirrors)
        assert np.abs(q @ t @ q.T - v).max() <= 1e-12 * max(1, want[0])


def test_products_are_exact_beyond_floats():
    y = np.array([[2**40, -(2**39) - 1, 3], [2**40 + 1, 5, -7]], np.int64)
    want = y.astype(object).T @ y.astype(object)
    assert (whitening.exact_products(y).astype(object) == want).all()
    small = np.arange(12).reshape(4, 3)
    assert (whitening.exact_products(small) == small.T @ small).all()


# ---- operator 13


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def library_ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check_packing(got, held, library, window=2048):
    ids = Counter()
    for doc_id, text, *_ in held:
        ids[(doc_id, library_ids(library, text).tobytes())] += 1
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    want = defaultdict(Counter)
    for (doc_id, tokens), n in ids.items():
        tokens = np.frombuffer(tokens, "<u4")
        want[doc_id][tokens.tobytes()] += n
    assert set(by_doc) == set(want)
    for doc_id, texts in want.items():
        pieces = by_doc[doc_id]
        assert sum(r.length for r in pieces) == sum(len(t) // 4 * n for t, n in texts.items())
        if sum(texts.values()) == 1:
            tokens = np.frombuffer(next(iter(texts)), "<u4")
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(tokens)
                assert r.ids_crc32 == zlib.crc32(tokens[at:at + r.length].tobytes())
                at += r.length
            assert at == len(tokens)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    short = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or (at < window and at & (at - 1) == 0)
        short += at < window
    return short, len(sequences)


def test_packing_covers_every_id_once(spark, tmp_root, library):
    held = data.rows(150) + data.awkward()
    folder = data.save(spark, tmp_root, documents=data.documents(spark, held))
    short, n = check_packing(packing.query(spark, folder).collect(), held, library)
    assert n > 20
    small = packing.pack(spark.read.parquet(folder + "/documents.parquet"), PATH, window=256, shard_docs=7)
    check_packing(small.collect(), held, library, window=256)


def test_packing_of_large_ids_beside_null_and_of_nothing(spark, library):
    prepare(spark)
    held = [(2**53 + 1, "a b c"), (None, "d e"), (2**53 + 3, None)]
    got = packing.pack(spark.createDataFrame(held, "doc_id long, text string"), PATH).collect()
    check_packing(got, held, library)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_word_encoder_equals_the_library(library, monkeypatch):
    pieces = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "a", "B", "É", "é",
              "é", "́", "ẞ", "日本", "1", "٣", "²", "Ⅷ", "'s", "'S", "'LL", "'", "!", ".", "_", "<|endoftext|>",
              "<|startoftext|>", "<|", "|>", "\U0001f600", "the", "Token", "\x00", "�", "İ", "Σ", "ΟΔΟΣ", "ſ", "K",
              "Å", "ﬁ", "i̇", "ᄀ", "ᅡ", "end."]
    rng = random.Random(1)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    texts += [t or "" for _, t, *_ in data.rows() + data.awkward()] + ["x" * 3000, "ab " * 2000, "é" * 700]
    encode = packing.WordEncoder(PATH)
    for t in texts:
        assert encode.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:60])
    monkeypatch.setattr(packing, "PIECE", 50)
    assert [len(x) <= 120 for x in packing.text_pieces(texts[-4][:900], 50)]
    assert "".join(packing.text_pieces(texts[-4], 50)) == texts[-4]
    small = packing.WordEncoder(PATH)
    small.words.bound = small.runs.bound = 20
    for t in texts[:300]:
        assert small.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_scores_are_bm25_and_windows_hold_neighbours():
    rng = np.random.default_rng(2)
    docs = [np.unique(rng.integers(0, 40, 15)) for _ in range(12)]
    tfs = [rng.integers(1, 5, len(d)) for d in docs]
    lengths, df = np.array([f.sum() for f in tfs], float), np.bincount(np.concatenate(docs), minlength=40)
    idf, mean = np.log1p((12 - df + 0.5) / (df + 0.5)), lengths.mean()
    index = packing.Index(docs, tfs, lengths, idf, mean)
    for q in docs:
        want = [sum(idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) for t, tf in zip(d, f) if t in q)
                for d, f, n in zip(docs, tfs, lengths)]
        assert np.allclose(index.scores(q), want)
    # Two topics, shuffled: a window's documents are of one topic while there are unused ones of it.
    topics = [np.array([1, 2, 3, 4]) + 10 * (i % 2) for i in range(16)]
    index = packing.Index(topics, [np.ones(4, int)] * 16, np.full(16, 4.0), np.ones(40), 4.0)
    sequences = packing.fill(np.full(16, 4), index, topics, 16)
    assert [{d % 2 for d, _, _ in s} for s in sequences] == [{0}, {1}, {0}, {1}]


def test_frequencies_count_every_document_once(spark):
    prepare(spark)
    texts = ["a b", "b c c", "", None, "a a a", "c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    encode = packing.encoder(PATH)
    want = np.zeros(encode.size, int)
    for t in texts:
        want[np.unique(encode.encode(t or ""))] += 1
    for parts in (1, 3, 9):
        held = packing.tokenised(df.repartition(parts), "doc_id", "text", PATH, 1, 2048)
        assert (packing.document_frequencies(held, encode.size) == want).all()
