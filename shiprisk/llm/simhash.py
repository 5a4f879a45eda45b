"""Operator 5: SimHash near-duplicates, linked exactly through vantage-point trees.

Fingerprint: A-Z lower-cased, words between ASCII white space, word shingles
(repeats included) hashed with XXH64 (seed 42); a bit is 1 if it is set in
over half of the hashes.  Two fingerprints link at ``distance`` or fewer
differing bits.

Linking works on distinct fingerprints, so a group of copies is one row.  A
routing tree of vantage points (built from a bounded sample; it decides the
balance, never the result) cuts the fingerprint space at median Hamming
distances into shards.  Each fingerprint goes to its home shard as data and, as
a query, to every later shard that the triangle bound can't exclude:
a ball of that radius reaches the inner side if d(v, x) - r <= mu and the outer
side if d(v, x) + r > mu.  Inside a shard a local vantage-point tree prunes the
same way down to small leaves, where pairs are compared bit by bit.  A shard
returns a spanning forest of its links, never all pairs of a dense group; the
forest edges of all shards are joined into components.

Defined results: a null or empty text has fingerprint zero and links like any
other; a text with fewer words than the shingle length is one shingle; the
component id is the least doc_id reachable (null doc_ids count only where there
is no other); repeated rows share fingerprint and component; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shiprisk.llm.common import materialise, prepare, sampled, table
from shiprisk.llm.components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42

#: Distinct fingerprints a shard is planned for, and fingerprints the routing tree is built from.
SHARD = 8_000
ROUTING_SAMPLE = 20_000
LEAF = 48
PAIR_BUFFER = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        windows, n = iter([b" ".join(words)]), 1
    else:
        windows, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, windows, repeat(SEED)), np.dtype("<u8"), n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        bits = np.unpackbits(hashes[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_udf(shingle: int):
    """Fingerprints as signed longs."""

    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of


def distances(one: np.uint64, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).astype(np.int16)


def routing_tree(sample: np.ndarray, depth: int) -> tuple | None:
    """(vantage point, mu, inner, outer), None for a leaf."""
    if depth <= 0 or len(sample) < 8:
        return None
    v = sample[len(sample) // 2]
    d = distances(v, sample)
    mu = int(np.median(d))
    inner = d <= mu
    if inner.all():
        mu = int(d.max()) - 1
        inner = d <= mu
        if not inner.any():
            return None
    return v, mu, routing_tree(sample[inner], depth - 1), routing_tree(sample[~inner], depth - 1)


def route(tree: tuple | None, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard in order: (number, indices at home in it, indices of all that reach it)."""
    number = 0
    stack = [(tree, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        node, at, home = stack.pop()
        if node is None:
            yield number, at[home], at
            number += 1
            continue
        v, mu, inner, outer = node
        d = distances(v, fps[at])
        near, far = d - radius <= mu, d + radius > mu
        stack.append((outer, at[far], (home & (d > mu))[far]))
        stack.append((inner, at[near], (home & (d <= mu))[near]))


class Forest:
    """Component labels of n nodes, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append(np.stack([a, b]))
            self.n_held += len(a)
            if self.n_held >= PAIR_BUFFER:
                self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        ends = np.sort(self.label[np.concatenate(self.held, axis=1)], axis=0)
        self.held, self.n_held = [], 0
        ends = np.unique(ends[:, ends[0] != ends[1]], axis=1)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for a, b in ends.T.tolist():
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if root:
            new = np.arange(len(self.label))
            for x in root:
                new[x] = find(x)
            self.label = new[self.label]


def shard_links(data: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as (fingerprint, root) arrays, of the links between data and queries and within data."""
    nodes = np.unique(np.concatenate([data, queries]))
    forest = Forest(len(nodes))
    stack = [(np.searchsorted(nodes, data), np.arange(len(nodes)))]
    while stack:
        held, asked = stack.pop()
        if not len(held) or not len(asked):
            continue
        if len(held) > LEAF:
            v = nodes[held[len(held) // 2]]
            d = distances(v, nodes[held])
            mu = int(np.median(d))
            if (d <= mu).all():
                mu = int(d.max()) - 1
            inner = d <= mu
            if inner.any():
                dq = distances(v, nodes[asked])
                stack.append((held[inner], asked[dq - radius <= mu]))
                stack.append((held[~inner], asked[dq + radius > mu]))
                continue
        step = max(1, 1_000_000 // len(held))
        for at in range(0, len(asked), step):
            some = asked[at:at + step]
            i, j = np.nonzero(np.bitwise_count(nodes[some][:, None] ^ nodes[held][None, :]) <= radius)
            a, b = some[i], held[j]
            forest.add(a[a != b], b[a != b])
    forest.settle()
    linked = np.nonzero(forest.label != np.arange(len(nodes)))[0]
    return nodes[linked], nodes[forest.label[linked]]


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct signed fingerprints (column fp) -> forest edges (u, v) of all pairs within ``distance`` bits."""
    n = fps.count()
    sample = sampled(fps, F.col("fp"), ROUTING_SAMPLE, n).orderBy(F.md5(F.col("fp").cast("string")), "fp")
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / SHARD))))
    chosen = np.array([r.fp for r in sample.collect()], np.int64).view(np.uint64) if depth else None
    tree = routing_tree(chosen, depth) if depth else None

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64)
            home = np.zeros(len(values), np.int32)
            reached = []
            for number, at_home, reach in route(tree, values.view(np.uint64), distance):
                home[at_home] = number
                reached.append((number, reach))
            for number, reach in reached:
                reach = reach[home[reach] <= number]
                yield pd.DataFrame({"shard": np.full(len(reach), number, np.int32), "fp": values[reach],
                                    "home": home[reach] == number})

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values = group["fp"].to_numpy(np.int64).view(np.uint64)
        home = group["home"].to_numpy(bool)
        u, v = shard_links(values[home], values[~home], distance)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    sent = fps.select("fp").mapInPandas(send, "shard int, fp long, home boolean")
    return sent.groupBy("shard").applyInPandas(search, "u long, v long")


def clusters(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct fingerprints (fp) -> (fp, root) for those linked to another one."""
    return components(links(fps, distance)).select(F.col("node").alias("fp"), "root")


def _classes(tagged: DataFrame, best, distance: int) -> DataFrame:
    """(fp, best of its component) for each distinct fingerprint of ``tagged``."""
    per = materialise(tagged.groupBy("fp").agg(best.alias("best")), "simhash-classes")
    roots = per.join(clusters(per.select("fp"), distance), "fp", "left").select(
        "fp", "best", F.coalesce("root", "fp").alias("root"))
    of_root = roots.groupBy("root").agg(F.min("best").alias("best"))
    return roots.select("fp", "root").join(of_root, "root").select("fp", "best")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagged = materialise(docs.select("doc_id", fingerprint_udf(SHINGLE)("text").alias("fp")), "simhash")
    found = _classes(tagged, F.min("doc_id"), DISTANCE)
    return tagged.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component stays, the one with the least doc_id."""
    prepare(spark)
    cols = docs.columns
    tagged = materialise(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), fingerprint_udf(SHINGLE)("text").alias("fp"),
        F.monotonically_increasing_id().alias("row_no")), "simhash")
    order = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("id"), "row_no")
    kept = _classes(tagged, F.min(order), DISTANCE).select(F.col("best.row_no").alias("row_no")).distinct()
    return tagged.join(kept, "row_no", "left_semi").select("row.*")
