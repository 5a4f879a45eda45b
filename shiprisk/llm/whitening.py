"""Operator 12: embedding whitening (PCA whitening of integer-scaled vectors).

An entry c becomes the integer x = floor(1024 c) + 100000.  Two passes in Arrow
batches sum the vectors, then the products of the entries centred by the rounded
mean; both sums are integers, added up in Spark as decimals, so neither the
partitioning nor the order of rows changes a bit of the covariance.  What is
gathered has the size of the dimension (a row a pair of dimensions), never of
the rows.

The covariance is solved in one task: Householder reflections make it
tridiagonal, bisection on Sturm counts finds the leading eigenvalues, inverse
iteration on the tridiagonal matrix their vectors, which are made orthogonal
again within clusters of close eigenvalues and reflected back.  The components
(at most ``COMPONENTS`` times the dimension) go to all tasks, which project their
own rows.  The covariance of the projected rows is then measured anew for
``identity_error``.

Defined results: rows whose vector is null or holds null or non-finite entries
are dropped, as are entries of 2**30 and more in size (their x is no number that
sums stay exact for) and empty vectors; vectors of another length than the most
common one (ties: the longer) are dropped, as they lie in no common space;
repeated rows count as often as they occur and are returned one by one; a null
vec_id is passed on; components whose eigenvalue is zero within rounding have no
scale and aren't returned, so vectors that are all alike give no rows; a
deviation beyond a long is null; an empty table gives an empty result; other
columns are ignored, whatever their names.  A component's largest entry is
positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiprisk.llm.common import materialise, prepare, table

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
LARGEST = float(2**30)
#: Eigenvalues nearer than this share of the matrix' size are one cluster.
CLUSTER = 1e-3
LONG = 2**63 - 1


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflection vectors of a symmetric matrix made tridiagonal."""
    a, n, mirrors = a.copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        v = np.zeros_like(x)
        if np.abs(x[1:]).max() > 0:
            v = x / size
            v[0] += np.copysign(1.0, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            q = p - (v @ p) * v
            rest -= 2 * (np.outer(v, q) + np.outer(q, v))
            a[k + 1:, k] = a[k, k + 1:] = 0
            a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def reflect(vectors: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    """Columns from the tridiagonal basis back to that of the matrix."""
    out = vectors.copy()
    for k in reversed(range(len(mirrors))):
        v = mirrors[k]
        out[k + 1:] -= 2 * np.outer(v, v @ out[k + 1:])
    return out


def sturm_counts(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Eigenvalues below each x: negative terms of the Sturm sequence."""
    least = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float((e * e).max(initial=0.0)))
    q, below = np.ones_like(x), np.zeros(len(x), int)
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring numbers."""
    reach = np.abs(np.concatenate([e, [0.0]])) + np.abs(np.concatenate([[0.0], e]))
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    high = high + 1e-12 * np.abs(high) + 1e-300
    wanted = len(d) - 1 - np.arange(k)
    for _ in range(2000):
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high)).all():
            break
        above = sturm_counts(d, e, mid) <= wanted
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return low + (high - low) / 2


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) z = b by elimination with row exchanges; zero pivots become ``tiny``."""
    n = len(d)
    main, up, up2, z = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    low = e.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(main[i]):
            main[i], low[i] = low[i], main[i]
            up[i], main[i + 1] = main[i + 1], up[i]
            if i + 2 < n:
                up2[i], up[i + 1] = up[i + 1], 0.0
            z[i], z[i + 1] = z[i + 1], z[i]
        if abs(main[i]) < tiny:
            main[i] = tiny
        factor = low[i] / main[i]
        main[i + 1] -= factor * up[i]
        up[i + 1] -= factor * up2[i]
        z[i + 1] -= factor * z[i]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for i in reversed(range(n)):
        after = (up[i] * z[i + 1] if i + 1 < n else 0.0) + (up2[i] * z[i + 2] if i + 2 < n else 0.0)
        z[i] = (z[i] - after) / main[i]
    return z


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling eigenvalues; orthogonal within clusters."""
    n, size = len(d), max(np.abs(d).max(), np.abs(e).max(initial=0.0), 1e-300)
    rng, out, start = np.random.default_rng(n), np.zeros((n, len(values))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * size:
            start = k
        near = out[:, start:k]
        z = rng.standard_normal(n)
        for _ in range(5):
            for _ in range(2):
                z -= near @ (near.T @ z)
            z = solve_shifted(d, e, value, z / np.linalg.norm(z), np.finfo(float).eps * size)
            z /= np.abs(z).max()
        for _ in range(2):
            z -= near @ (near.T @ z)
            z /= np.linalg.norm(z)
        out[:, k] = z
    return out


def leading_eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit vectors as columns."""
    size = float(np.abs(v).max(initial=0.0))
    k = min(k, len(v))
    if not size or not k:
        return np.zeros(0), np.zeros((len(v), 0))
    d, e, mirrors = householder(v / size)
    values = leading_eigenvalues(d, e, k)
    vectors = reflect(inverse_iteration(d, e, values), mirrors)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values * size, vectors * np.where(signs < 0, -1.0, 1.0)


def fit_rows(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """The fit list: ``id`` as text and the vector ``c`` as doubles, all of one length."""
    c = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double"))
    fine = F.coalesce(F.size("c") > 0, F.lit(False)) & F.coalesce(F.forall(
        "c", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(LARGEST))), F.lit(False))
    out = vectors.select(F.col(f"`{vec_id}`").cast("string").alias("id"), c.alias("c")).filter(fine)
    per = out.groupBy(F.size("c").alias("dim")).agg(F.count("*").alias("n"))
    most = per.agg(F.max(F.struct("n", "dim")).alias("m")).select("m.dim").first()
    return out.filter(F.size("c") == F.lit(most.dim or 0))


def scaled(batch: pd.Series) -> np.ndarray:
    """The integers x of a batch of vectors."""
    return np.floor(np.stack(batch.to_numpy()) * SCALE).astype(np.int64) + SHIFT


def exact_products(y: np.ndarray) -> np.ndarray:
    """y.T @ y as exact integers, as floats do it where no sum reaches 2**53."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 2**53:
        return (y.astype(float).T @ y.astype(float)).astype(np.int64)
    return y.T.astype(object) @ y.astype(object)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Rows and the sums of each dimension."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, 0
        for batch in batches:
            if len(batch):
                n, total = n + len(batch), total + scaled(batch["c"]).sum(axis=0).astype(object)
        if n:
            yield pd.DataFrame({"i": range(len(total)), "n": n, "total": [Decimal(int(t)) for t in total]})

    per = rows.select("c").mapInPandas(add, "i int, n long, total decimal(38,0)").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).orderBy("i").collect()
    return (per[0].n if per else 0), [int(r.total) for r in per]


def eigenpairs(rows: DataFrame, n: int, total: list[int], components: int) -> list:
    """(component, value, trace, vector) of the covariance, the leading components only."""
    middle = np.array([round(t / n) for t in total], np.int64)
    rest = [t - n * int(m) for t, m in zip(total, middle)]

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if len(batch):
                c = exact_products(scaled(batch["c"]) - middle).astype(object)
                held = c if held is None else held + c
        if held is not None:
            i, j = np.triu_indices(len(held))
            yield pd.DataFrame({"i": i, "j": j, "total": [Decimal(int(t)) for t in held[i, j]]})

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((len(rest), len(rest)))
        for i, j, t in zip(group["i"], group["j"], group["total"]):
            v[i, j] = v[j, i] = (n * int(t) - rest[i] * rest[j]) / (n * n)
        values, vectors = leading_eigenpairs(v, components)
        real = values > len(v) * np.finfo(float).eps * values.max(initial=0.0)
        return pd.DataFrame({"component": np.arange(1, len(values) + 1), "value": values, "trace": np.trace(v),
                             "vector": pd.Series(list(vectors.T), dtype=object)})[real]

    entries = rows.select("c").mapInPandas(products, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(
        F.sum("total").cast("decimal(38,0)").alias("total"))
    # A row a pair of dimensions: the size of this group doesn't depend on the rows.
    found = entries.groupBy(F.lit(0).alias("one")).applyInPandas(
        solve, "component int, value double, trace double, vector array<double>")
    return found.orderBy("component").collect()


def identity_error(w: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of column w (arrays of k numbers) minus the identity."""
    means = w.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    part = [F.col("w")[i] - F.lit(means[i]) for i in range(k)]
    got = w.agg(*[F.avg(part[i] * part[j]) for i in range(k) for j in range(i, k)]).first()
    want = [float(i == j) for i in range(k) for j in range(i, k)]
    return max(abs(a - b) for a, b in zip(got, want))


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; a row a vector and component."""
    prepare(vectors.sparkSession)
    kind = vectors.schema[vec_id].dataType.simpleString()
    shape = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {shape}")
    rows = fit_rows(vectors, vec_id, embedding)
    n, total = sums(rows)
    pairs = eigenpairs(rows, n, total, components) if n else []
    if not pairs:
        return nothing
    middle = np.array([round(t / n) for t in total], np.int64)
    rest = np.array([t - n * int(m) for t, m in zip(total, middle)], object)
    to = np.array([r.vector for r in pairs]).T / np.sqrt([r.value for r in pairs])
    mean = (rest / n).astype(float)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            y = scaled(batch["c"]) - middle
            if (n * int(np.abs(y).max()) + int(max(map(abs, rest)))) ** 2 * len(rest) <= LONG:
                off = n * y - rest.astype(np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:
                off = n * y.astype(object) - rest
                deviation = [int(s) if s <= LONG else None for s in (off * off).sum(axis=1)]
            yield pd.DataFrame({"id": batch["id"], "deviation": pd.array(deviation, "Int64"),
                                "w": list((y - mean) @ to)})

    held = materialise(rows.mapInPandas(project, "id string, deviation long, w array<double>"), "whitened")
    error = identity_error(held, len(pairs))
    explained = F.array(*[F.lit(r.value / r.trace) for r in pairs])
    numbers = F.array(*[F.lit(r.component) for r in pairs])
    each = held.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        F.col("id").cast(kind).alias("vec_id"), numbers[F.col("at")].alias("component"),
        F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
