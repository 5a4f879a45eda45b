"""Operators 5 and 9 against all pairs."""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

pytest.importorskip("shiprisk.llm")
xxhash = pytest.importorskip("xxhash")

import llm_data as data  # noqa: E402

from shiprisk.llm import components, simhash, spherical  # noqa: E402
from shiprisk.llm.common import prepare  # noqa: E402


def roots(ids, linked):
    """Least id reachable, by plain union."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots({x for ab in links for x in ab}, links)
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_fingerprint_by_definition():
    for text in ["", None, " \n", "One", "one two", "ONE two THREE", "ÉA b\x0bc\x1cd e", *[r[1] for r in data.rows(15)]]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("n, leaf_shard", [(1500, 100), (900, 10_000)])
def test_vantage_point_shards_find_every_link(spark, monkeypatch, n, leaf_shard):
    prepare(spark)
    monkeypatch.setattr(simhash, "SHARD", leaf_shard)
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = random.Random(n)
    fps = {rng.getrandbits(64) for _ in range(n)} | {0, 2**64 - 1}
    for x in list(fps)[:300]:  # chains of near fingerprints, and a dense ball
        for _ in range(3):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    ball = rng.getrandbits(64)
    fps |= {ball ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    fps = sorted(fps)
    values = np.array(fps, np.uint64)
    linked = [(fps[i], fps[i + 1 + j]) for i in range(len(fps))
              for j in np.nonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 3)[0]]
    signed = {x: int(np.uint64(x).astype(np.int64)) for x in fps}
    want = roots(signed.values(), [(signed[a], signed[b]) for a, b in linked])
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long").repartition(4)
    got = {r.fp: r.root for r in simhash.clusters(df).collect()}
    assert len(linked) > 500
    assert got == {x: r for x, r in want.items() if x in got}
    assert set(got) == {x for ab in linked for x in (signed[ab[0]], signed[ab[1]])}


def test_simhash_query_and_stage(spark, tmp_root):
    held = data.rows(40) + data.awkward()
    near = held[0][1].rsplit(" ", 1)[0] + " other"
    held += [(2000, near, "en", "src0", len(near)), (2001, held[1][1].upper(), "en", "src0", 1)]
    df = data.documents(spark, held)
    folder = data.save(spark, tmp_root, documents=df)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.query(spark, folder).collect()]
    fps = [plain_fingerprint(t) for _, t, *_ in held]
    group = roots(range(len(held)), [(i, j) for i in range(len(held)) for j in range(i)
                                     if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for i, g in group.items():
        if held[i][0] is not None:
            least[g] = min(least.get(g, held[i][0]), held[i][0])
    want = [(h[0], f"{fps[i]:016x}", least.get(group[i])) for i, h in enumerate(held)]
    assert sorted(got, key=str) == sorted(want, key=str)

    kept = simhash.stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(group.values()))
    assert {i for i in ids if i is not None} == set(least.values())


VEC = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(4)
    out, n = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            base = rng.standard_normal(24)
            for _ in range(rng.integers(1, 5)):
                v = base + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.25, 0.4])
                out.append((n, v.astype(np.float32).tolist(), label))
                n += 1
    out += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 24, 0), (n + 3, [float("nan")] * 24, 1),
            (n + 4, [float("inf")] + [0.0] * 23, 1), (n + 5, [None] + [1.0] * 23, 0), (n + 6, out[0][1], 1),
            (n + 7, out[0][1], 0), (n + 8, out[0][1], 0), (n + 9, [1.0, 2.0], 0), (n + 10, [1e-30] * 24, 0),
            (n + 11, [1e30] * 24, 0)]
    return out


def test_embeddings_against_all_pairs(spark, tmp_root, monkeypatch):
    monkeypatch.setattr(spherical, "BLOCK", 8)
    held = vectors()
    df = spark.createDataFrame(held, VEC).selectExpr("*", "'x' AS kept", "1 AS root", "2 AS n_links").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in
           spherical.query(spark, data.save(spark, tmp_root, embeddings=df)).collect()}
    fine = {}
    for i, v, label in held:
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            a = np.array(v, np.float64)
            fine[i] = (label, a / np.abs(a).max())
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    linked = [(i, j) for i, (la, a) in fine.items() for j, (lb, b) in fine.items()
              if i < j and la == lb and len(a) == len(b) and cos(a, b) >= 0.93]
    group = roots([h[0] for h in held], linked)
    n = {i: 0 for i in group}
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    assert len(linked) > 100
    assert got == {i: (n[i], group[i], group[i] == i) for i in group}


def test_embeddings_repeated_ids_and_empty(spark, tmp_root):
    prepare(spark)
    held = [(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (None, [1.0, 0.01], 3), (None, [0.0, 1.0], 4)]
    got = sorted(map(tuple, spherical.near_duplicates(spark.createDataFrame(held, VEC)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True)], key=str)
    folder = data.save(spark, tmp_root, embeddings=spark.createDataFrame([], VEC),
                       documents=spark.createDataFrame([], data.SCHEMA))
    assert spherical.query(spark, folder).count() == 0
    assert simhash.query(spark, folder).count() == 0
    assert simhash.stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).count() == 0


def test_list_decoding_gives_all_exceeding_filters():
    code = spherical.ProductCode(16, 5, blocks=3, hits=12, least_hits=4)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, filters = code.decode(x)
    s = code._scores(x)
    every = (s[0][:, :, None, None] + s[1][:, None, :, None] + s[2][:, None, None, :]).reshape(40, -1)
    for i in range(40):
        mine = set(filters[rows == i])
        assert len(mine) >= 4
        lowest = min(every[i][f] for f in mine)
        assert mine == set(np.nonzero(every[i] >= lowest - 1e-12)[0]) or mine >= set(
            np.nonzero(every[i] >= code.height)[0])


@pytest.mark.parametrize("dim, rows", [(1, 10**7), (2, 10**7), (3, 10**7), (8, 50_000), (64, 500), (64, 50_000)])
def test_plans_keep_the_miss_chance_in_any_dimension(dim, rows):
    codes = spherical.codes_for(rows, dim)
    hits, turns = spherical.plan_for(dim, codes)
    x, y = spherical.random_pairs(np.random.default_rng(9), 1000, dim, 0.93)
    none = np.ones(len(x), bool)
    for turn in range(turns):
        none &= spherical.apart(spherical.ProductCode(dim, codes, hits=hits, seed=5, turn=turn), x, y)[0]
    assert none.sum() <= 1


def test_embeddings_miss_no_pair_near_the_limit(spark):
    """1,500 pairs just above the limit in one label."""
    prepare(spark)
    rng = np.random.default_rng(8)
    x, z = rng.standard_normal((2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.931 * x + np.sqrt(1 - 0.931 ** 2) * z
    held = [(2 * i + k, v.tolist(), 1) for i in range(1500) for k, v in enumerate((x[i], y[i]))]
    got = spherical.near_duplicates(spark.createDataFrame(held, "vec_id long, embedding array<double>, label int"))
    assert {(r.vec_id, r.n_links, r.component_id) for r in got.collect()} == {(i, 1, i - i % 2) for i, _, _ in held}


def test_embeddings_plan_keeps_the_miss_chance_at_a_million_rows():
    codes = spherical.codes_for(1_000_000)
    hits, turns = spherical.plan_for(64, codes)
    x, y = spherical.random_pairs(np.random.default_rng(9), 3000, 64, 0.93)
    none = np.ones(len(x), bool)
    for turn in range(turns):
        none &= spherical.apart(spherical.ProductCode(64, codes, hits=hits, seed=5, turn=turn), x, y)[0]
    assert none.sum() <= 2
