"""Cleaning and typing.

Every step is a single projection or a single aggregate so that the whole
bronze -> silver path is one Spark plan: narrow steps fuse into one
whole-stage-codegen stage and only the duplicate removal shuffles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiprisk import config
from shiprisk.session import work_dir
from shiprisk.schemas import (
    INT_COLUMNS, KEY_COLUMNS, JUNK_COLUMNS, NULL_FILLS, NUMERIC_TYPES, PII_COLUMNS, TIMESTAMP_COLUMNS,
)

_NON_ALNUM = re.compile(r"[^a-z0-9]+")


class ColumnCollisionError(ValueError):
    """Two source headers map to the same snake_case name."""


def snake_case(name: str) -> str:
    """Lower-case, each run of non [a-z0-9] -> '_', strip '_' at both ends."""
    return _NON_ALNUM.sub("_", name.lower()).strip("_")


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Rename every column to snake_case; refuse colliding names."""
    names = [snake_case(c) for c in df.columns]
    seen: dict[str, str] = {}
    for src, dst in zip(df.columns, names):
        if dst in seen:
            raise ColumnCollisionError(f"{seen[dst]!r} and {src!r} both become {dst!r}")
        seen[dst] = src
    return df.toDF(*names)


def drop_junk(df: DataFrame, cols: list[str] = JUNK_COLUMNS) -> DataFrame:
    """Drop empty / unused columns."""
    return df.drop(*cols)


def default_types() -> dict[str, T.DataType]:
    """The silver cast lists: 15 integer and 12 exact-decimal columns."""
    whole = {c: T.LongType() if c in KEY_COLUMNS else T.IntegerType() for c in INT_COLUMNS}
    return {**whole, **NUMERIC_TYPES}


def cast_columns(df: DataFrame, types: dict[str, T.DataType] | None = None,
                 on_error: str = "fail") -> DataFrame:
    """Cast many columns in one projection.

    ``on_error="fail"`` uses ANSI casts (a bad value stops the job, as the
    original did); ``"null"`` uses ``try_cast`` (bad values become NULL).
    Whole numbers written with a zero fraction (``725.0``) are whole numbers.
    """
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be 'fail' or 'null'")
    types = default_types() if types is None else types

    def conv(c: str) -> Column:
        col = F.col(f"`{c}`")
        if c not in types:
            return col
        if isinstance(types[c], T.IntegralType) and isinstance(df.schema[c].dataType, T.StringType):
            col = F.when(F.contains(col, F.lit(".")), F.regexp_replace(col, r"\.0+\s*$", "")).otherwise(col)
        casted = col.cast(types[c]) if on_error == "fail" else col.try_cast(types[c])
        return casted.alias(c)

    return df.select(*[conv(c) for c in df.columns])


def parse_timestamps(df: DataFrame, mapping: dict[str, str] | None = None,
                     fmt: str = config.RAW_TIMESTAMP_FORMAT, on_error: str = "fail") -> DataFrame:
    """Parse text timestamps into TIMESTAMP_NTZ columns, drop the sources."""
    mapping = TIMESTAMP_COLUMNS if mapping is None else mapping
    out = df
    for src, dst in mapping.items():
        if on_error == "fail":
            parsed = F.to_timestamp_ntz(F.col(src), F.lit(fmt))
        else:
            parsed = F.try_to_timestamp(F.col(src), F.lit(fmt)).cast("timestamp_ntz")
        out = out.withColumn(dst, parsed)
    return out.drop(*[s for s in mapping if s not in mapping.values()])


def fill_nulls(df: DataFrame, fills: dict | None = None) -> DataFrame:
    """C4: constant fills (zip and last name 'UNKNOWN', customer zip 0)."""
    fills = NULL_FILLS if fills is None else fills
    present = {k: v for k, v in fills.items() if k in df.columns}
    return df.fillna(present) if present else df


DIGEST = ["_digest_a", "_digest_b"]


def row_digests(df: DataFrame) -> list[Column]:
    """128 bits of a row: two 64-bit hashes of its columns, in either order."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return [F.xxhash64(F.lit(0), *cols).alias(DIGEST[0]), F.xxhash64(F.lit(1), *cols[::-1]).alias(DIGEST[1])]


def row_text(df: DataFrame) -> Column:
    """A row's plain values as one text: each with its length, nulls apart from empty texts, -0.0 as 0.0."""
    texts = [(F.col(f"`{f.name}`") + F.lit(0.0) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
              else F.col(f"`{f.name}`")).cast("string") for f in df.schema.fields if not _nested(f.dataType)]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.concat(F.lit(""), *parts)


def _nested(kind: T.DataType) -> bool:
    """Types whose text doesn't tell all values apart."""
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


#: Repeated digests up to which their rows are looked up by a join; 16 bytes each.
FEW_REPEATED = 500_000


def _repeated(df: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their digests, the digests that several rows have (written), and the number of these.

    Only the digests are shuffled, after a partial aggregate.
    """
    marked = df.select("*", *row_digests(df))
    seen = Observation()
    per = marked.groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").observe(
        seen, F.count(F.lit(1)).alias("repeated"))
    path = work_dir(df.sparkSession, "repeated-digests")
    per.select(*DIGEST, F.lit(True).alias("_again")).write.parquet(path)
    return marked, df.sparkSession.read.parquet(path), int(seen.get.get("repeated") or 0)


def drop_exact_duplicates(df: DataFrame, digests_first: bool = True) -> DataFrame:
    """Remove rows identical in every column.

    By default digests are counted first, and whole rows are compared (and shuffled)
    only where a 128-bit digest occurs twice; rows that merely share a digest are
    told apart there.  All others pass as they are: they meet the table of repeated
    digests, which was written, so the planner knows its size and sends it to the
    rows while it is small.  Where very many digests repeat, both joins would shuffle
    every row, so all rows are compared at once instead.  ``df`` is read up to three
    times, so it should be a written table.

    Without ``digests_first`` ``df`` is read once and all rows are compared.  That is
    for rows that cost more to make than to shuffle, and for rows already dealt by one
    of their columns (after a join on it): those aren't shuffled again.
    """
    if not digests_first:
        return df.dropDuplicates()
    marked, again, repeated = _repeated(df)
    if repeated > FEW_REPEATED:
        return df.dropDuplicates()
    once = marked.join(again, DIGEST, "left_anti").drop(*DIGEST)
    several = marked.join(again, DIGEST).drop(*DIGEST, "_again").dropDuplicates()
    return once.unionByName(several)


def dedupe_report(before: DataFrame) -> DataFrame:
    """Rows before and after exact-duplicate removal.

    Rows are told apart by SHA-256 of their text and by the columns that have no
    such text, so only these are shuffled; ``before`` is read once.
    """
    nested = [F.col(f"`{f.name}`") for f in before.schema.fields if _nested(f.dataType)]
    per = before.groupBy(F.unhex(F.sha2(row_text(before), 256)).alias("_sha"), *nested).agg(F.count(F.lit(1)).alias("_n"))
    rows, after = F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint"), F.count(F.lit(1))
    return per.agg(rows.alias("rows_before"), after.alias("rows_after"), (rows - after).alias("duplicates_removed"))


def add_delay_days(df: DataFrame) -> DataFrame:
    """delay_days = real - scheduled shipping days."""
    return df.withColumn(
        "delay_days", F.col("days_for_shipping_real") - F.col("days_for_shipment_scheduled"))


def drop_pii(df: DataFrame, cols: list[str] = PII_COLUMNS) -> DataFrame:
    """Remove personal columns (flat table only)."""
    return df.drop(*cols)


def project_rename(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Select ``src AS out`` for each (out, src) pair."""
    return df.select(*[F.col(f"`{src}`").alias(out) for out, src in pairs])


def dedupe_by_key(df: DataFrame, key: str, order_by: str) -> DataFrame:
    """One row per key: the row with the smallest ``order_by`` value.

    The order is total: rows without an order value come last and ties go by
    the other columns, so the same row is kept however the data is split.
    ``min`` over one packed struct is an aggregate with a map-side partial
    step: a key that holds a third of all rows is reduced to one row per task
    before the shuffle.
    """
    if order_by not in df.columns:
        raise ValueError(f"order column {order_by!r} not in frame")
    rest = [c for c in df.columns if c not in (key, order_by)]
    packed = F.struct(F.col(f"`{order_by}`").isNull().alias("_late"), F.col(f"`{order_by}`").alias("_order"),
                      *[F.col(f"`{c}`") for c in rest])
    kept = df.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.min(packed).alias("_row"))
    place = {key: F.col("_key"), order_by: F.col("_row._order")}
    return kept.select(*[place.get(c, F.col(f"_row.`{c}`")).alias(c) for c in df.columns])


def clean(bronze: DataFrame, types: dict[str, T.DataType] | None = None,
          timestamps: dict[str, str] | None = None, fmt: str = config.RAW_TIMESTAMP_FORMAT,
          on_error: str = "fail", digests_first: bool = True) -> DataFrame:
    """Bronze (strings, snake_case) -> cleaned typed frame with delay_days.

    drop junk -> cast -> parse timestamps -> fill nulls -> drop exact
    duplicates -> delay_days.  Personal columns are kept (the customer table
    needs them); :func:`drop_pii` makes the flat table.
    """
    out = drop_junk(bronze)
    out = cast_columns(out, types, on_error)
    out = parse_timestamps(out, timestamps, fmt, on_error)
    out = fill_nulls(out)
    out = drop_exact_duplicates(out, digests_first)
    return add_delay_days(out)


def filled(typed: DataFrame) -> DataFrame:
    """Typed rows without junk columns, nulls filled, repeated rows still in."""
    return add_delay_days(fill_nulls(drop_junk(typed)))


def clean_typed(typed: DataFrame, digests_first: bool = True) -> DataFrame:
    """Cleaning of rows that arrive already typed (no casts or parsing)."""
    return drop_exact_duplicates(filled(typed), digests_first)
