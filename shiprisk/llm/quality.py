"""Operator 8: quality rules with robust multivariate outliers.

Base rules reject texts of under 50 words, and texts with over half of their
words in repeated 3-word windows.  The method judges the others by four
transformed statistics: log of the mean word length, root of the symbol share,
share of repeated lines, share of repeated words.  For every language and
source their location and scatter are estimated by minimum covariance
determinant over all rows that pass the base rules, and a row is rejected if its
squared Mahalanobis distance exceeds the chi-squared quantile ``KEEP``.

The estimate is FAST-MCD with the concentration steps as Spark jobs: from two
starts (moments; medians and quartile ranges) each step measures the distances
of all rows of a group, takes the closest half and estimates anew; the start
with the smaller determinant wins and a last step reweights.  Order statistics
come from counts on a fine logarithmic grid and moments from sums, so every
step is a map-side aggregate: a language or source with a third of all rows is
never gathered in a task.  Only estimates (a row a group) are joined back: they go
to the rows as a broadcast while there are at most ``BROADCAST_GROUPS`` of them,
which is checked; beyond that rows and estimates meet over a salted key.

Scatter has a floor (``FLOOR``, the least spread of each statistic), so that
groups of near-constant rows neither become singular nor reject rows for tiny
differences.  Sources with under ``LEAST_GROUP`` rows use their language's
estimate, such languages that of all rows.

Defined results: a null or empty text has no words and fails the base rules;
null lang and null source are values of their own; repeated rows are judged
alike; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shiprisk.llm.common import materialise, prepare, table

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEAT_PERCENT = 50

P = 4
FLOOR = (0.08, 0.03, 0.10, 0.08)
HALF = 0.5
REWEIGHT = 0.975
KEEP = 1 - 1e-9
STEPS = 4
LEAST_GROUP = 40
GRID = 16
#: Groups whose estimates (some 250 bytes a group and start) are sent to all tasks; salts of a group beyond that.
BROADCAST_GROUPS = 20_000
SALTS = 32
X = [f"x{i}" for i in range(P)]
M = [f"m{i}" for i in range(P)]
PAIRS = list(combinations_with_replacement(range(P), 2))
Q = [f"q{i}{j}" for i, j in PAIRS]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    number = dict(zip(dict.fromkeys(words), range(len(words))))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(windows, twice)
    inside = np.zeros(len(words), bool)
    for i in range(3):
        inside[i:len(windows) + i] |= again
    return int(inside.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            again += line in seen
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), again,
            repeated_words(words))


def counts_udf():
    """The counts of a text as a struct, with the number of lines that hold a word."""

    @pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [(*base_counts(t), sum(1 for x in (t or "").split("\n") if x.strip(SPACE))) for t in texts]
        return pd.DataFrame(rows, columns=[*COUNTS, "n_lines"])

    return of


def base_failed(c: Column) -> Column:
    return (c["n_words"] < LEAST_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * REPEAT_PERCENT)


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row (the carried columns, if any), c (the counts), failed, lang and source keys, and the statistics x0 to x3."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(0)
    out = docs.select(row.alias("row"), key("lang").alias("by_lang"),
                      key("source").alias("by_source"), counts_udf()("text").alias("c"))
    share = lambda a, b: F.col(f"c.{a}").cast("double") / F.greatest(F.col(f"c.{b}"), F.lit(1))
    stats = [F.log(F.greatest(share("word_chars", "n_words"), F.lit(1.0))), F.sqrt(share("n_symbols", "word_chars")),
             share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return out.select("row", "by_lang", "by_source", "c", base_failed(F.col("c")).alias("failed"),
                      *[x.alias(n) for x, n in zip(stats, X)])


def chi2_cdf(x: float, df: int) -> float:
    """Of an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(df // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - float(np.exp(-x / 2)) * total


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """Factor that makes the scatter of the closest ``share`` consistent at the normal model."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def _estimates(moments: DataFrame, factor: float) -> DataFrame:
    """Sums per group and start -> means m*, entries q* of the inverse scatter, log determinant."""
    keys = moments.select("group", "start", "n")
    fields = ", ".join(f"{c} double" for c in [*M, *Q, "logdet"])

    def solve(batches):
        for b in batches:
            n = b["n"].to_numpy(float)
            mean = np.stack([b[f"s{i}"] for i in range(P)], 1).astype(float) / n[:, None]
            cov = np.zeros((len(b), P, P))
            for i, j in PAIRS:
                cov[:, i, j] = cov[:, j, i] = b[f"s{i}{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
            cov = cov * factor + np.diag(np.square(FLOOR))
            inverse = np.linalg.inv(cov) if len(b) else cov
            out = b[["group", "start", "n"]].copy()
            for i in range(P):
                out[M[i]] = mean[:, i]
            for (i, j), q in zip(PAIRS, Q):
                out[q] = inverse[:, i, j] * (1 if i == j else 2)
            out["logdet"] = np.linalg.slogdet(cov)[1] if len(b) else 0.0
            yield out

    types = dict(keys.dtypes)
    return materialise(moments.mapInPandas(
        solve, f"group string, start int, n {types['n']}, {fields}"), "mcd-estimates")


def _distance() -> Column:
    """Squared Mahalanobis distance of x* from m* under q*."""
    d = [F.col(x) - F.col(m) for x, m in zip(X, M)]
    total = F.lit(0.0)
    for (i, j), q in zip(PAIRS, Q):
        total = total + d[i] * d[j] * F.col(q)
    return F.greatest(total, F.lit(0.0))


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(X)]
    sums += [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in PAIRS]
    return rows.groupBy("group", "start").agg(F.count("*").alias("n"), *sums)


def _grid_start(rows: DataFrame) -> DataFrame:
    """Start 1: medians and quartile ranges per statistic, from counts on a grid of 1/1024."""
    cells = rows.select("group", F.posexplode(F.array(*[F.floor(F.col(x) * 1024) for x in X])).alias("i", "cell"))
    cells = cells.groupBy("group", "i", "cell").agg(F.count("*").alias("n"))
    by = Window.partitionBy("group", "i")
    cells = cells.withColumn("upto", F.sum("n").over(by.orderBy("cell"))).withColumn("all", F.sum("n").over(by))
    at = lambda p: F.min(F.when(F.col("upto") >= F.col("all") * p, F.col("cell"))) / F.lit(1024.0)
    per = cells.groupBy("group", "i").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    var = F.pow((F.col("high") - F.col("low")) / 1.349, 2)
    pick = lambda i, c: F.max(F.when(F.col("i") == i, c))
    return per.groupBy("group").agg(
        F.lit(1).alias("start"), F.lit(0).cast("long").alias("n"),
        *[pick(i, F.col("mid")).alias(M[i]) for i in range(P)],
        *[(pick(i, 1 / (var + FLOOR[i] ** 2)) if i == j else F.lit(0.0)).alias(q) for (i, j), q in zip(PAIRS, Q)],
        F.lit(0.0).alias("logdet"))


def meet(rows: DataFrame, per_group: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows joined with a written table of a row a key; the rows of a key stay in many tasks."""
    if per_group.count() <= 2 * BROADCAST_GROUPS:
        return rows.join(F.broadcast(per_group), keys, how)
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    every = per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every.hint("merge"), [*keys, "salt"], how).drop("salt")


def estimates(rows: DataFrame) -> DataFrame:
    """(group, x*) rows -> the reweighted MCD estimate of each group, with n rows behind it."""
    keys = ["group", "start"]
    first = _estimates(_moments(rows.withColumn("start", F.lit(0))), 1.0)
    now = materialise(first.unionByName(_grid_start(rows).select(first.columns)), "mcd-starts")
    for _ in range(STEPS):
        far = meet(rows, now.drop("n"), ["group"]).withColumn(
            "cell", F.floor(F.log2(F.greatest(_distance(), F.lit(1e-6))) * GRID))
        counts = far.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
        by = Window.partitionBy(*keys)
        counts = counts.withColumn("upto", F.sum("n").over(by.orderBy("cell"))).withColumn(
            "all", F.sum("n").over(by))
        half = counts.filter(F.col("upto") >= F.col("all") * HALF).groupBy(*keys).agg(F.min("cell").alias("limit"))
        half = materialise(half, "mcd-halves")
        now = _estimates(_moments(meet(far, half, keys).filter("cell <= limit")), consistency(HALF))
    best = now.groupBy("group").agg(F.min_by(F.struct(*[c for c in now.columns if c not in ("group", "n")]), F.struct(
        "logdet", "start")).alias("e"))
    best = materialise(best.select("group", "e.*"), "mcd-best")
    near = meet(rows, best, ["group"]).filter(_distance() <= chi2_quantile(REWEIGHT, P))
    last = _estimates(_moments(near), consistency(REWEIGHT)).drop("start", "logdet", "n")
    return last.join(rows.groupBy("group").agg(F.count("*").alias("rows")), "group")


def chosen_estimates(stats: DataFrame) -> DataFrame:
    """The estimate to use for each by_lang and by_source of measured() rows.

    ``stats`` is read several times, so it should be a written table.
    """
    fit = stats.filter(~F.col("failed")).select("by_lang", "by_source", *X)
    source_group = F.concat_ws("\x1f", F.lit("s"), "by_lang", "by_source")
    lang_group = F.concat_ws("\x1f", F.lit("l"), "by_lang")
    levels = F.array(source_group, lang_group, F.lit("all"))
    found = estimates(fit.select(F.explode(levels).alias("group"), *X))
    named = stats.select("by_lang", "by_source").distinct().select(
        "by_lang", "by_source", F.posexplode(levels).alias("level", "group"))
    usable = named.join(found, "group").filter((F.col("rows") >= LEAST_GROUP) | (F.col("level") == 2))
    best = F.min_by(F.struct(*M, *Q), "level").alias("e")
    return materialise(usable.groupBy("by_lang", "by_source").agg(best).select("by_lang", "by_source", "e.*"),
                       "mcd-chosen")


def judge(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds distance and kept to measured() rows."""
    out = meet(stats, chosen, ["by_lang", "by_source"], "left").withColumn("distance", _distance())
    fits = F.coalesce(F.col("distance") <= chi2_quantile(KEEP, P), F.lit(True))
    return out.withColumn("kept", ~F.col("failed") & fits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(measured(table(spark, sf_dir, "documents"), ["doc_id"]), "quality")
    return judge(stats, chosen_estimates(stats)).select(
        "row.doc_id", *[f"c.{c}" for c in COUNTS], F.col("failed").alias("base_failed"), "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go, the others stay as they are.

    Only the statistics are written for the estimates; the documents are read
    and counted a second time for the verdict, so no copy of the texts is kept.
    """
    prepare(spark)
    chosen = chosen_estimates(materialise(measured(docs, []), "quality"))
    return judge(measured(docs, docs.columns), chosen).filter("kept").select("row.*")
