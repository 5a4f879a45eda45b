"""M3, M6: exactly stratified hash split and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiprisk.ml.features import ID

SEED = 42
#: The key hash has three digits of 16 bits; one histogram pass settles one digit.
DIGITS, DIGIT = 3, 16


def key_hash(key: str = ID, seed: int = SEED) -> Column:
    """48 bits: the first 12 hex digits of md5(seed || key).

    Depends only on the key, so the split is the same however the data is
    partitioned or re-read, and on any engine.
    """
    h = F.substring(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))), 1, DIGITS * DIGIT // 4)
    return F.conv(h, 16, 10).cast("bigint")


def _with_classes(rows: DataFrame, classes: list[tuple], names: str) -> DataFrame:
    """Rows with their class' values (a row a class, so it goes to all tasks); null is a class of its own."""
    kind = rows.schema["label"].dataType.simpleString()
    held = rows.sparkSession.createDataFrame(classes, f"class_label {kind}, {names}")
    return rows.join(F.broadcast(held), F.col("label").eqNullSafe(F.col("class_label"))).drop("class_label")


def test_limits(features: DataFrame, test_pct: int = 20, key: str = ID, seed: int = SEED) -> list[tuple]:
    """(label, hash, key) of the last test row of each class, in the order (hash, key).

    A class of n rows has round(n * test_pct / 100) test rows (halves up).  The
    row is found digit by digit: a histogram of the next 16 bits over the rows
    that share the digits so far, a partial aggregate of at most 65,536 counts a
    class, says in which bin it lies.  No rows of a class are ever brought
    together; only the few that share the last hash are ordered by key.
    """
    rows = features.select("label", key_hash(key, seed).alias("h"), F.col(key).alias("k"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a class
    state = {r.label: (0, (r.n * test_pct + 50) // 100) for r in counts}
    state = {label: s for label, s in state.items() if s[1] > 0}
    for at in reversed(range(DIGITS)):
        if not state:
            return []
        known = _with_classes(rows, [(c, p, k) for c, (p, k) in state.items()], "prefix bigint, wanted bigint")
        inside = known.where(F.shiftright("h", DIGIT * (at + 1)) == F.col("prefix"))
        digit = F.shiftright("h", DIGIT * at).bitwiseAND(F.lit((1 << DIGIT) - 1))
        bins = inside.groupBy("label", "wanted", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("label").orderBy("digit"))  # at most 65,536 bins a class
        first = bins.withColumn("upto", upto).where("upto >= wanted").groupBy("label").agg(
            F.min(F.struct("digit", (F.col("wanted") - F.col("upto") + F.col("n")).alias("left"))).alias("s"))
        state = {r.label: ((state[r.label][0] << DIGIT) + r.s.digit, r.s.left) for r in first.collect()}
    last = _with_classes(rows, [(c, p, k) for c, (p, k) in state.items()], "limit bigint, wanted bigint").where("h = limit")
    keys = last.groupBy("label", "wanted", "limit", "k").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("k"))  # the keys of one 48-bit hash
    ends = keys.withColumn("upto", upto).where("upto >= wanted").groupBy("label").agg(
        F.min("k").alias("k"), F.min("limit").alias("limit"))
    return [(r.label, r.limit, r.k) for r in ends.collect()]


def stratified_split(features: DataFrame, test_pct: int = 20, key: str = ID,
                     seed: int = SEED) -> DataFrame:
    """M3: adds ``split`` = test / train; every class gives exactly its share of test rows.

    The test rows are the first of their class by (key hash, key).  Rows of one
    key stay on one side, so the counts are exact for unique keys.
    """
    kind = features.schema[key].dataType.simpleString()
    limits = features.sparkSession.createDataFrame(
        test_limits(features, test_pct, key, seed),
        f"class_label {features.schema['label'].dataType.simpleString()}, class_hash bigint, class_key {kind}")
    marked = features.join(F.broadcast(limits), F.col("label").eqNullSafe(F.col("class_label")), "left")  # a row a class
    h = key_hash(key, seed)
    inside = (h < F.col("class_hash")) | ((h == F.col("class_hash")) & (F.col(key) <= F.col("class_key")))
    return marked.withColumn("split", F.when(F.coalesce(inside, F.lit(False)), "test").otherwise("train")).drop(
        "class_label", "class_hash", "class_key")


def split_balance(split: DataFrame) -> DataFrame:
    """Rows per split and class, and each class's share of its split."""
    counts = split.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows"))
    per_split = Window.partitionBy("split")  # <= 2 rows per split
    return counts.withColumn(
        "share_pct", F.round(F.col("n_rows") * 100.0 / F.sum("n_rows").over(per_split), 2)
        .cast("double"))


def class_weights(train: DataFrame) -> DataFrame:
    """M6: weight = n / (n_classes * n_class) ('balanced')."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    everything = Window.partitionBy()  # one row per class
    return counts.withColumn(
        "weight",
        F.sum("n_rows").over(everything).cast("double")
        / (F.count(F.lit(1)).over(everything) * F.col("n_rows")).cast("double"))


def with_class_weight(train: DataFrame) -> DataFrame:
    """Attach the balanced weight (class table is broadcast: one row per class)."""
    return train.join(F.broadcast(class_weights(train).select("label", "weight")), "label")
