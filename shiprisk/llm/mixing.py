"""Operator 10: mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, repeated
``repeats`` times.  A document's virtual finish time is the number of its
source's words up to and including it, divided by the source's target.  All
queued items are range-sorted by that time and taken until the total budget is
used up.  Every queue reaches time 1 with its target, so the cut falls where
all sources have about their targets.

Prefix sums are exact integers and never need one task: within a source they
run over the partitions of a range sort by source, shuffle key and row number (so
rows of one key needn't share a task either), globally over those of the range
sort by finish time.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; a null doc_id is shuffled as the empty text; repeated rows are
queued one by one (equal keys are told apart by a row number); an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiprisk.llm.common import WORD, materialise, table, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            repeats: int = REPEATS) -> DataFrame:
    """(source, size) rows -> (source, source_size, target).

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes; a target stops at ``repeats`` times its source's
    size and the excess is shared again by weight.  That fixed point is a water
    level: target = min(cap, weight * level).  The windows see one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                (((rank - 1) % len(weights)) + 1).cast("int")))
    per = per.withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("budget", F.sum("source_size").over(all_rows).cast("double") * F.lit(share))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level_here", level)
    # The level rises while the sources so far are full and falls after: its maximum is the fixed point.
    per = per.withColumn("level", F.max("level_here").over(all_rows))
    target = F.least(F.col("cap"), F.col("weight") * F.col("level"))
    return per.select("source", "source_size", target.alias("target"), "budget")


def _finish(sized: DataFrame, goals: DataFrame, repeats: int) -> DataFrame:
    """One row per queued item with its virtual finish time."""
    order = ["source", "key", "row_no"]
    sized = materialise(sized.repartitionByRange(*order).withColumn("bucket", F.spark_partition_id()), "mix-queues")
    place = Window.partitionBy("bucket", "source").orderBy("key", "row_no")
    offset = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(offset), F.lit(0)).alias("offset"))
    run = sized.withColumn("run", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    a, b = run.alias("a"), sums.alias("b")
    run = a.join(b, [F.col("a.source").eqNullSafe(F.col("b.source")), F.col("a.bucket") == F.col("b.bucket")]
                 ).select("a.*", (F.col("a.run") + F.col("b.offset")).alias("upto"))
    a, g = run.alias("a"), goals.alias("g")
    run = a.join(g, F.col("a.source").eqNullSafe(F.col("g.source"))).select(
        "a.*", "g.source_size", "g.target", "g.budget")
    items = run.withColumn("turn", F.explode(F.array(*[F.lit(i).cast("long") for i in range(repeats)])))
    words = F.col("turn") * F.col("source_size") + F.col("upto")
    return items.withColumn("finish", F.when(F.col("target") > 0, words.cast("double") / F.col("target")
                                             ).otherwise(F.lit(0.0)))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: Column | None = None,
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
        carry: list[str] | None = None) -> DataFrame:
    """Per row: row (a struct of the carried columns, by default doc_id), size, source_size, target,
    times (0..repeats) and taken = times * size.

    ``key`` is the shuffle key (default: md5 of doc_id); ties go by row number.
    """
    carry = ["doc_id"] if carry is None else carry
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) if key is None else key
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(source).alias("source"),
        F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"),
        key.alias("key"), F.monotonically_increasing_id().alias("row_no"))
    sized = materialise(sized, "mix-sizes")
    narrow = sized.drop("row")
    items = _finish(narrow, targets(sized, weights, share, repeats), repeats)
    order = ["finish", "turn", "key", "row_no"]
    ranked = materialise(items.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("part", F.spark_partition_id()), "mix-ranked")
    parts = ranked.groupBy("part").agg(F.sum("size").alias("part_size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = ranked.withColumn("inside", F.sum("size").over(inside)).join(parts, "part")
    fits = (F.col("inside") + F.col("ahead")).cast("double") <= F.col("budget")
    times = used.groupBy("row_no").agg(
        F.sum(fits.cast("long")).alias("times"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"))
    return sized.join(times, "row_no").select(
        "row", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row as often as the mix takes it (0, 1 or 2 times)."""
    mixed = mix(docs, carry=docs.columns).filter("times > 0")
    return mixed.select("row", F.explode(F.expr("sequence(1L, times)"))).select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM per),
weighed AS (
  SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight,
         CAST(2 * source_size AS DOUBLE) AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 AS budget
  FROM ranked),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_here
  FROM weighed),
level AS (SELECT max(level_here) AS level FROM levels),
goals AS (
  SELECT source, source_size, budget,
         least(cap, weight * level) AS target
  FROM levels CROSS JOIN level),
queued AS (
  SELECT doc_id, key, size, source_size, target, budget, turn,
         CASE WHEN target > 0 THEN CAST(turn * source_size + upto AS DOUBLE) / target ELSE 0e0 END AS finish
  FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id
                                       ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM sized) s
  JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
  CROSS JOIN (VALUES (0), (1)) AS t(turn)),
used AS (
  SELECT *, sum(size) OVER (ORDER BY finish, turn, key, doc_id ROWS UNBOUNDED PRECEDING) AS upto_all FROM queued)
SELECT doc_id, size, source_size, target,
       CAST(sum(CASE WHEN CAST(upto_all AS DOUBLE) <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM used GROUP BY doc_id, size, source_size, target
"""
