"""Silver layer written once: the flat table and the six relational tables.

Reports read persisted silver tables instead of re-deriving them from the
sources on every query (the medallion layout: bronze -> silver -> gold).
Writing to the shared folder also cuts the lineage: a lost executor costs a
re-read of Parquet, not a re-run of the joins.

* The flat table is partitioned by order month, so cutoff and year filters open
  only the months they need, and sorted by order date inside each file, so
  Parquet row-group statistics skip the rest.  Rows are dealt by ranges of
  (month, item): a small month is one file, a large one is several.
* ``order_items`` and ``shipments`` are bucketed by ``order_item_id`` and
  ``orders`` by ``order_id`` (external tables in the session catalog whose
  files live under the shared root).  The 1:1 item/shipment join then reads
  matching buckets side by side with no shuffle, and the item/order join
  shuffles only the item side.  Each bucket is one file: rows are
  hash-partitioned on the bucket key before the write.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from threading import RLock

from pyspark.sql import DataFrame, SparkSession

from shiprisk.functions.calendar import MONTH_NO, month_no
from shiprisk.model import SupplyTables
from shiprisk.operators.clean import project_rename
from shiprisk.schemas import TABLE_COLUMNS, TABLE_NAMES
from shiprisk.session import app_id, work_dir
from shiprisk.sources import testbed

# Tables with a row per line item and no column that the flat table lacks.
FLAT_PROJECTIONS = ["order_items", "shipments"]
#: The table that holds both, where they are bucketed.
LINES = "lines"

BUCKET_KEYS = {"order_items": "order_item_id", "shipments": "order_item_id", "orders": "order_id"}


@dataclass(frozen=True)
class SilverLayout:
    root: str
    prefix: str      # catalog name prefix of the bucketed tables ('' = none)
    buckets: int


def _prefix_for(root: str) -> str:
    tail = re.sub(r"[^a-z0-9]+", "_", os.path.basename(root.rstrip("/")).lower())
    return tail if tail.startswith("silver") else f"silver_{tail}"


# Line items a bucket is planned for.
BUCKET_ROWS = 1_000_000
# The layer is written once and read often.
CODEC = "zstd"


def _by_month(flat: DataFrame) -> DataFrame:
    return (flat.withColumn(MONTH_NO, month_no("order_date")).repartitionByRange(MONTH_NO, "order_item_id")
            .sortWithinPartitions(MONTH_NO, "order_date"))


def _write_flat(dealt: DataFrame, root: str) -> DataFrame:
    """Write the flat rows, dealt and sorted by month, and read them back."""
    dealt.write.mode("errorifexists").option("compression", CODEC).partitionBy(MONTH_NO).parquet(f"{root}/flat")
    return dealt.sparkSession.read.parquet(f"{root}/flat")


def _write_table(name: str, df: DataFrame, root: str, prefix: str, buckets: int) -> None:
    path = f"{root}/{name}"
    if buckets and name in BUCKET_KEYS:
        key = BUCKET_KEYS[name]
        (df.repartition(buckets, key).write.mode("errorifexists").option("compression", CODEC)
         .bucketBy(buckets, key).sortBy(key).option("path", path)
         .saveAsTable(f"{prefix}_{name}"))
    else:
        df.write.mode("errorifexists").option("compression", CODEC).parquet(path)


def _bucket_count(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def write_silver(flat: DataFrame, tables: SupplyTables, root: str,
                 buckets: int | None = None, concurrency: int = 4) -> SilverLayout:
    """Persist the flat table, then the six tables, under ``root``.

    Item and shipment rows are projections of the written flat table, so the
    joins behind it run once.  ``buckets`` sets the bucket count of the fact
    tables; by default it follows from the rows written (``BUCKET_ROWS`` a
    bucket, the session's shuffle partitions at least), so buckets stay of one
    size as the data grows; 0 writes plain Parquet only.  The table writes are
    independent jobs, submitted from ``concurrency`` driver threads.
    """
    from concurrent.futures import ThreadPoolExecutor

    written = _write_flat(_by_month(flat), root)
    if buckets is None:
        buckets = _bucket_count(flat.sparkSession, written.count())
    prefix = _prefix_for(root) if buckets else ""
    frames = tables.as_dict() | {t: project_rename(written, TABLE_COLUMNS[t]) for t in FLAT_PROJECTIONS}
    jobs = [(lambda n=n, d=d: _write_table(n, d, root, prefix, buckets)) for n, d in frames.items()]
    with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
        for future in [pool.submit(job) for job in jobs]:
            future.result()  # re-raise the first failure
    return SilverLayout(root, prefix, buckets or 0)


def _read_table(spark: SparkSession, layout: SilverLayout, name: str) -> DataFrame:
    if layout.prefix and name in BUCKET_KEYS:
        return spark.table(f"{layout.prefix}_{name}")
    return spark.read.parquet(f"{layout.root}/{name}")


def read_silver(spark: SparkSession, layout: SilverLayout | str) -> SupplyTables:
    if isinstance(layout, str):
        layout = SilverLayout(layout, "", 0)
    parts = {name: _read_table(spark, layout, name) for name in TABLE_NAMES}
    return SupplyTables(**parts, flat=spark.read.parquet(f"{layout.root}/flat"))


class TestbedSilver(SupplyTables):
    """Silver tables of a source folder, each written when it is first asked for.

    A report on the flat table so doesn't wait for the six others, nor a join of
    two tables for the rest.  The handles kept are lazy (no data is cached).
    """

    __test__ = False  # no test class

    def __init__(self, spark: SparkSession, sf_dir: str, root: str | None = None, buckets: int | None = None,
                 of: TestbedSilver | None = None):
        keep = vars(of) | {"_with_flat": False} if of is not None else {
            "_spark": spark, "_sf_dir": sf_dir, "_root": root or work_dir(spark, "silver"), "_buckets": buckets,
            "_held": {}, "_lock": RLock(), "_with_flat": True}
        for name, value in keep.items():
            object.__setattr__(self, name, value)

    def _layout(self) -> SilverLayout:
        if "layout" not in self._held:
            rows = testbed.plan_shuffles(self._spark, self._sf_dir)
            buckets = _bucket_count(self._spark, rows) if self._buckets is None else self._buckets
            self._held["layout"] = SilverLayout(self._root, _prefix_for(self._root) if buckets else "", buckets)
        return self._held["layout"]

    def table(self, name: str) -> DataFrame:
        with self._lock:
            if name not in self._held:
                spark, layout = self._spark, self._layout()
                if name == "flat":
                    self._held[name] = _write_flat(testbed.flat_by_month(spark, self._sf_dir), layout.root)
                elif name == LINES:
                    self._held[name] = self._write_lines(layout)
                elif name in FLAT_PROJECTIONS and layout.buckets:
                    self._held[name] = project_rename(self.table(LINES), TABLE_COLUMNS[name])
                else:
                    rows = project_rename(self.table("flat"), TABLE_COLUMNS[name]) if name in FLAT_PROJECTIONS \
                        else getattr(testbed.tables(spark, self._sf_dir, with_flat=False), name)
                    _write_table(name, rows, layout.root, layout.prefix, layout.buckets)
                    self._held[name] = _read_table(spark, layout, name)
            return self._held[name]

    def _write_lines(self, layout: SilverLayout) -> DataFrame:
        """Items and shipments as one bucketed table: they have the same key and a row a line item each.

        The flat table is its source if it is there already; it isn't written for it.
        """
        columns = list(dict.fromkeys(src for t in FLAT_PROJECTIONS for _, src in TABLE_COLUMNS[t]))
        key = BUCKET_KEYS["order_items"]
        dealt = self._held["flat"].select(*columns).repartition(layout.buckets, key) if "flat" in self._held \
            else testbed.lines_by_item(self._spark, self._sf_dir, columns, layout.buckets)
        name = f"{layout.prefix}_{LINES}"
        (dealt.write.mode("errorifexists").option("compression", CODEC).bucketBy(layout.buckets, key).sortBy(key)
         .option("path", f"{layout.root}/{LINES}").saveAsTable(name))
        return self._spark.table(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.table(name)

    @property
    def flat(self) -> DataFrame | None:
        return self.table("flat") if self._with_flat else None

    def relational(self) -> TestbedSilver:
        return TestbedSilver(self._spark, self._sf_dir, of=self)


# (application id, source dir) -> silver tables; keeping the handles avoids
# re-listing the folders and re-reading Parquet footers per query.
_WRITTEN: dict[tuple[str, str], TestbedSilver] = {}


def testbed_silver(spark: SparkSession, sf_dir: str) -> TestbedSilver:
    """Silver tables of ``sf_dir``, each written on first use in this application."""
    key = (app_id(spark), os.path.abspath(sf_dir))
    if key not in _WRITTEN:
        _WRITTEN[key] = TestbedSilver(spark, sf_dir)
    testbed.plan_shuffles(spark, sf_dir)
    return _WRITTEN[key]
