"""Operator 9: embedding near-duplicates by spherical-cap filters.

Filters are directions from a structured random product code: after a random
rotation the space is cut into ``blocks`` sub-spaces, each with ``codes``
random unit directions; a filter is one direction per block, so codes**blocks
filters are never listed.  A vector's relevant filters are those whose inner
product exceeds a cap height; they are found by list decoding: partial sums
over the blocks, dropped as soon as the best remaining codes can't lift them
over the height.  The height gives about ``hits`` filters a vector; a vector
with fewer than ``least_hits`` lowers its own height until it has them.

The code is drawn several times with independent uniform rotations, and a pair
meets if any of them gives it a filter in common; this holds for every label,
whatever its size.  Under a uniform rotation the chance to share none depends on
the pair's cosine alone, whatever the data; ``plan_for`` measures it on random
pairs at the limit, for the code size of each vector length, and takes the
cheapest hits and number of draws with a chance below ``MISS``.

Vectors that meet are compared as 8-bit copies: a pair goes on
unless the copies' cosine, with their rounding errors added, stays below the
limit.  What is left is verified in double precision on the vectors themselves.

Identical vectors of a label are one class before anything is compared, so
copies are never expanded into pairs.  Small filters are compared many to a task
group; one with many classes is cut into blocks of ``BLOCK`` rows, and each pair
of blocks is a task group of its own; every pair in it is still verified.

Defined results: null, empty or zero vectors, vectors with null or non-finite
components, and rows with a null label link with nothing (n_links 0, their own
component, kept).  Vectors of different lengths never link.  Repeated rows are
copies of each other and link.  A null vec_id never is a component id unless
all of the component are null; ``kept`` is then true.  An empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiprisk.llm.common import materialise, table
from shiprisk.llm.components import components

COSINE = 0.93
BLOCKS = 4
HITS = 32
LEAST_HITS = 12
#: Chance to miss a pair at the limit, and the random pairs it is measured on.
MISS = 1e-4
HIT_STEPS = (16, 24, 32, 48, 64, 96, 128)
MISS_PAIRS = 4000
BLOCK = 1024
GROUP_ROWS = 20_000
SMALL = 48
SEED = 20240


def codes_for(rows: int, dim: int = 64, blocks: int = BLOCKS) -> int:
    """Directions a block, so that the filters number about the rows, but no more than caps lie apart in few dimensions."""
    filters = min(max(rows, 8**blocks), 4 ** min(dim, 30))
    return max(2, int(np.ceil(filters ** (1.0 / min(blocks, dim)) - 1e-9)))


class ProductCode:
    """The rotation and the block directions for one dimension; made anew from the seed in each task.

    Each ``turn`` is an independent draw of both.
    """

    def __init__(self, dim: int, codes: int, blocks: int = BLOCKS, hits: float = HITS,
                 least_hits: int = LEAST_HITS, seed: int = SEED, turn: int = 0):
        rng = np.random.default_rng([seed, dim, codes, blocks, turn])
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        self.rotation = q * np.where(np.diag(r) < 0, -1.0, 1.0)  # uniform over all rotations
        self.blocks = min(blocks, dim)
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.codes = codes
        self.directions = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            c = rng.standard_normal((codes, b - a))
            self.directions.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        filters = float(codes) ** self.blocks
        self.least_hits = int(min(least_hits, filters))
        # The height at which random unit vectors exceed `hits` filters, from random vectors.
        probe = rng.standard_normal((256, dim))
        sums = self._scores(probe / np.linalg.norm(probe, axis=1, keepdims=True))
        picks = rng.integers(0, codes, (self.blocks, 4096))
        spread = np.std(sum(s[:, p] for s, p in zip(sums, picks)))
        self.height = spread * _normal_quantile(1 - min(0.5, hits / filters))

    def _scores(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.rotation
        return [turned[:, a:b] @ d.T for a, b, d in zip(self.cuts[:-1], self.cuts[1:], self.directions)]

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter number) of every filter that a row exceeds."""
        scores = self._scores(unit)
        best = np.stack([s.max(axis=1) for s in scores], axis=1)
        heights = np.full(len(unit), self.height)
        rows_out, filters_out = [], []
        todo = np.arange(len(unit))
        while len(todo):
            rows, filters = self._above(scores, best, heights, todo)
            counts = np.bincount(rows, minlength=len(unit))
            enough = counts[todo] >= self.least_hits
            done = np.zeros(len(unit), bool)
            done[todo[enough]] = True
            rows_out.append(rows[done[rows]])
            filters_out.append(filters[done[rows]])
            todo = todo[~enough]
            heights[todo] -= 0.05 * np.abs(heights[todo]) + 1e-3
        if not rows_out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows_out), np.concatenate(filters_out)

    def _above(self, scores, best, heights, todo):
        rest = np.cumsum(best[:, ::-1], axis=1)[:, ::-1]  # of this block and those after it
        rows, sums, numbers = todo, np.zeros(len(todo)), np.zeros(len(todo), np.int64)
        for k, s in enumerate(scores):
            after = rest[:, k + 1] if k + 1 < len(scores) else np.zeros(len(rest))
            total = sums[:, None] + s[rows]
            i, j = np.nonzero(total >= (heights - after)[rows][:, None])
            rows, sums, numbers = rows[i], total[i, j], numbers[i] * self.codes + j
        return rows, numbers


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def random_pairs(rng: np.random.Generator, n: int, dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """n pairs of random unit vectors at one cosine."""
    x, z = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim == 1:
        return x, x
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine * cosine) * z


def apart(code: ProductCode, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int]:
    """Which pairs share no filter, and the filters of all vectors together."""
    rows, filters = code.decode(np.concatenate([x, y]))
    number = code.codes ** code.blocks
    key, second = rows % len(x) * number + filters, rows >= len(x)
    met = np.zeros(len(x), bool)
    met[np.intersect1d(key[~second], key[second], assume_unique=True) // number] = True
    return ~met, len(rows)


def plan_for(dim: int, codes: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(hits, turns): the fewest filters a vector that miss a pair at the limit with a chance below ``miss``.

    The chance of one draw is taken at the upper end of its estimate (three standard errors, Wilson).
    """
    best = None
    for hits in HIT_STEPS:
        rng = np.random.default_rng([SEED, dim, codes, hits])
        missed = copies = 0
        for turn in range(4):
            x, y = random_pairs(rng, MISS_PAIRS // 4, dim, cosine)
            none, filters = apart(ProductCode(dim, codes, hits=hits, turn=turn), x, y)
            missed, copies = missed + int(none.sum()), copies + filters
        p, z = missed / MISS_PAIRS, 9 / MISS_PAIRS
        chance = min(0.999, (p + z / 2 + np.sqrt(z * p * (1 - p) + z * z / 4)) / (1 + z))
        turns = max(1, ceil(log(miss) / log(chance)))
        if best is None or copies * turns < best[0]:
            best = copies * turns, hits, turns
    return best[1:]


def _classes(vectors: DataFrame) -> DataFrame:
    """Distinct comparable vectors: class_no, label, vec (double array), copies, least_id."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)
    ) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    per = vectors.filter(fine).groupBy("label", vec.alias("vec")).agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    return per.withColumn("class_no", F.monotonically_increasing_id())


def _scaled(rows) -> np.ndarray:
    """Vectors by their largest component, so that squares neither overflow nor vanish."""
    m = np.stack([np.asarray(r, np.float64) for r in rows])
    return m / np.abs(m).max(axis=1, keepdims=True)


def _matrix(group: pd.DataFrame) -> np.ndarray:
    """Unit vectors of the 8-bit copies."""
    m = np.stack([np.frombuffer(v, np.int8) for v in group["small"]]).astype(np.float64)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _near(bucket: pd.DataFrame, cosine: float) -> np.ndarray:
    """Pairs (2 x n class numbers) of one filter, or of two blocks of one, that may reach the cosine.

    With x = x' + e: |cos(x, y) - cos(x', y')| <= 2 (|ex| / |x| + |ey| / |y|).
    """
    m, numbers, own, error = _matrix(bucket), *(bucket[c].to_numpy() for c in ("class_no", "own", "error"))
    low, high = int(bucket["low"].iat[0]), int(bucket["high"].iat[0])
    first = np.nonzero(own == low)[0]
    second = first if low == high else np.nonzero(own == high)[0]
    found = [np.zeros((2, 0), np.int64)]
    for at in range(0, len(first), 512):
        some = first[at:at + 512]
        slack = 2 * (error[some][:, None] + error[second][None, :]) + 1e-9
        i, j = np.nonzero(m[some] @ m[second].T >= cosine - slack)
        i, j = some[i], second[j]
        keep = (i < j) if low == high else (i != j)
        found.append(np.stack([numbers[i[keep]], numbers[j[keep]]]))
    return np.concatenate(found, axis=1)


def _near_small(group: pd.DataFrame, spans: np.ndarray, cosine: float) -> np.ndarray:
    """The same for many small filters at once, pairing rows by their distance within a span."""
    lengths = spans[:, 1] - spans[:, 0]
    at = np.concatenate([np.arange(a, b) for a, b in spans])
    span = np.repeat(np.arange(len(spans)), lengths)
    part = group.iloc[at]
    m, numbers, own, error = _matrix(part), *(part[c].to_numpy() for c in ("class_no", "own", "error"))
    inside = (part["low"] == part["high"]).to_numpy()
    found = [np.zeros((2, 0), np.int64)]
    for step in range(1, int(lengths.max())):
        i = np.nonzero(span[:-step] == span[step:])[0]
        j = i + step
        met = (inside[i] | (own[i] != own[j])) & (
            np.einsum("ij,ij->i", m[i], m[j]) >= cosine - 2 * (error[i] + error[j]) - 1e-9)
        found.append(np.stack([numbers[i[met]], numbers[j[met]]]))
    return np.concatenate(found, axis=1)


def links(classes: DataFrame, *, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Distinct verified pairs (a, b) of class numbers, a < b."""
    dim = F.size("vec").alias("dim")

    def planned(group: pd.DataFrame) -> pd.DataFrame:
        codes = codes_for(int(group["n"].iat[0]), int(group["dim"].iat[0]))
        hits, turns = plan_for(int(group["dim"].iat[0]), codes, cosine)
        return group.assign(codes=codes, hits=hits, turns=turns).drop(columns="n")

    # A row a vector length.
    plans = materialise(classes.groupBy(dim).agg(F.count("*").alias("n")).groupBy("dim").applyInPandas(
        planned, "dim int, codes int, hits int, turns int"), "cap-plans")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[tuple, list[ProductCode]] = {}

        def decoded(plan: tuple[int, int, int, int], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            dim, codes, hits, turns = plan
            if plan not in made:
                made[plan] = [ProductCode(dim, codes, hits=hits, turn=t) for t in range(turns)]
            found = [code.decode(unit) for code in made[plan]]
            return (np.concatenate([rows for rows, _ in found]),
                    np.concatenate([f + t * codes ** made[plan][t].blocks for t, (_, f) in enumerate(found)]))

        for batch in batches:
            for plan, part in batch.groupby(["dim", "codes", "hits", "turns"]):
                dim = int(plan[0])
                scaled = _scaled(part["vec"])
                unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
                rows, filters = decoded(tuple(map(int, plan)), unit)
                small = np.rint(scaled * 127).astype(np.int8)
                error = np.linalg.norm(scaled - small / 127.0, axis=1) / np.linalg.norm(scaled, axis=1)
                packed = np.array([v.tobytes() for v in small], object)
                yield pd.DataFrame({"label": part["label"].to_numpy()[rows], "dim": np.int32(dim), "filter": filters,
                                    "class_no": part["class_no"].to_numpy()[rows], "small": packed[rows],
                                    "error": error[rows]})

    label = classes.schema["label"].dataType.simpleString()
    marked = classes.withColumn("dim", dim).join(plans, "dim").select("class_no", "label", "vec", *plans.columns)
    hits = marked.mapInPandas(
        send, f"label {label}, dim int, filter long, class_no long, small binary, error double")
    hits = materialise(hits, "cap-hits")
    key = ["label", "dim", "filter"]
    sizes = hits.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").withColumn(
        "blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = hits.join(sizes.drop("n"), key).withColumn("own", F.pmod(F.xxhash64("class_no"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    # Whole small filters share a task group; each pair of blocks of a large one is a group of its own.
    groups = max(1, hits.count() // GROUP_ROWS)
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(*key), F.lit(groups))).otherwise(
        F.xxhash64(*key, "low", "high"))
    dealt = dealt.withColumn("bucket", F.xxhash64(*key, "low", "high")).withColumn("task", task)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["dim", "filter", "bucket", "class_no"], ignore_index=True)
        starts = np.nonzero((group[["dim", "filter", "bucket"]].diff().fillna(1) != 0).any(axis=1).to_numpy())[0]
        found = [np.zeros((2, 0), np.int64)]
        small: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(starts, [*starts[1:], len(group)]):
            if b - a > SMALL:
                found.append(_near(group.iloc[a:b], cosine))
            elif b - a > 1:
                small.setdefault(int(group["dim"].iat[a]), []).append((a, b))
        for spans in small.values():
            found.append(_near_small(group, np.array(spans), cosine))
        a, b = np.concatenate(found, axis=1)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    pairs = dealt.select("dim", "filter", "bucket", "class_no", "small", "error", "own", "low", "high", "task").groupBy(
        "task").applyInPandas(compare, "a long, b long").distinct()
    side = lambda c: classes.select(
        F.col("class_no").alias(c), F.col("label").alias(f"label_{c}"), F.col("vec").alias(f"vec_{c}"))
    held = pairs.join(side("a"), "a").join(side("b"), "b").filter("label_a = label_b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["vec_a"].map(len)):
                x, y = _scaled(part["vec_a"]), _scaled(part["vec_b"])
                dot = lambda p, q: np.einsum("ij,ij->i", p, q)
                fits = dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y))) >= cosine
                yield part.loc[fits, ["a", "b"]]

    return held.select("a", "b", "vec_a", "vec_b").mapInPandas(verify, "a long, b long")


def near_duplicates(vectors: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept, one row per vector."""
    narrow = vectors.select("vec_id", "embedding", "label")
    classes = materialise(_classes(narrow), "vector-classes")
    pairs = materialise(links(classes, cosine=cosine), "vector-links")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(classes.select(F.col("class_no").alias("b"), "copies"), "b").groupBy("a").agg(
        F.sum("copies").alias("others"))
    roots = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    of_class = classes.join(counts, classes.class_no == counts.a, "left").join(
        roots, classes.class_no == roots.node, "left").select(
        "label", "vec", "least_id", F.coalesce("root", "class_no").alias("root"),
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    least = of_class.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = of_class.join(least, "root").select("label", "vec", "n_links", "component_id")
    vec = F.transform("embedding", lambda x: x.cast("double"))
    out = narrow.withColumn("vec", vec).join(of_class, ["label", "vec"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION SELECT links.b AS node, reach.root FROM reach JOIN links ON links.a = reach.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_links, roots.root AS component_id,
       e.vec_id = roots.root AS kept
FROM embeddings e JOIN roots ON roots.node = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id
"""
