"""What the mapping, the silver layer and the duplicate removal shuffle, write and keep."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from shiprisk.functions.calendar import MONTH_NO
from shiprisk.ml import features, split, train
from shiprisk.operators import clean
from shiprisk.schemas import PRIMARY_KEYS
from shiprisk.sources import csv_io, silver, testbed

from conftest import SF_SMALL
from test_plans import plan

Q = E.queries()


@pytest.fixture()
def little_broadcast(spark):
    """Only nation and region are broadcast."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for k in keys:
        spark.conf.set(k, "4096")
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("name", ["silver_flat", "drop_exact_duplicates", "fact_order_items", "fact_shipments"])
def test_raw_rows_are_not_shuffled_again(spark, little_broadcast, name):
    tree = plan(Q[name](spark, SF_SMALL)).split("\n\n")[0]
    assert "Generate" in tree and "Exchange" not in tree.split("Generate")[0]


def test_narrow_jobs_read_narrow_rows(spark):
    p = plan(Q["dedupe_by_key"](spark, SF_SMALL))
    assert "l_orderkey" in p and "l_extendedprice" not in p and "c_name" not in p


def test_only_the_tables_asked_for_are_written(spark, tmp_root):
    t = silver.TestbedSilver(spark, SF_SMALL, f"{tmp_root}/silver_lazy", 0)
    assert t.relational().flat is None and not t._held
    t.star("products", "categories").count()
    assert set(t._held) == {"layout", "products", "categories"}
    t.relational().shipments.count()
    assert set(t._held) == {"layout", "products", "categories", "flat", "shipments"}
    assert set(t.as_dict()) == set(PRIMARY_KEYS) and t.relational().flat is None and t.flat is not None


def test_flat_by_month_is_the_flat_table(spark):
    out, flat = testbed.flat_by_month(spark, SF_SMALL), testbed.flat(spark, SF_SMALL)
    rows = out.drop(MONTH_NO)
    assert rows.schema == flat.schema
    assert rows.exceptAll(flat).isEmpty() and flat.exceptAll(rows).isEmpty()
    assert out.where(F.col(MONTH_NO) != F.date_format("order_date", "yyyyMM").cast("int")).isEmpty()


def test_many_repeated_rows_are_compared_at_once(spark, monkeypatch):
    rows = [(i % 7, "x" if i % 2 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, v string")
    monkeypatch.setattr(clean, "FEW_REPEATED", 0)
    out = clean.drop_exact_duplicates(df)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(set(rows), key=str)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_duplicate_counts_tell_values_apart(spark):
    df = spark.createDataFrame([("a", None, 0.0, [1]), ("a", None, -0.0, [1]), (None, "a", 0.0, [1]), ("", "a", 0.0, [1]),
                                ("1:a", "", 0.0, [1]), ("a", None, 0.0, [2]), ("a", None, None, [1])],
                               "x string, y string, z double, w array<int>")
    report = clean.dedupe_report(df)
    assert tuple(report.first()) == (7, df.dropDuplicates().count(), 1)
    assert "Join" not in report._jdf.queryExecution().executedPlan().toString()


def test_compressed_raw_files_read_the_same(spark, tmp_root):
    typed = testbed.typed_rows(spark, SF_SMALL).limit(300).withColumn("customer_fname", F.lit("J\u00f6rg \"x\", y"))
    csv_io.write_raw_csv(typed, f"{tmp_root}/plain")
    csv_io.write_raw_csv(csv_io.read_raw_csv(spark, f"{tmp_root}/plain"), f"{tmp_root}/packed", compression="gzip")
    a, b = csv_io.read_raw_csv(spark, f"{tmp_root}/plain"), csv_io.read_raw_csv(spark, f"{tmp_root}/packed")
    assert a.count() == 300 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert not spark.read.format("binaryFile").load(f"{tmp_root}/packed/*.csv.gz").select("path").isEmpty()


def test_training_rows_kept_are_label_and_features(spark):
    prep = train.prepare(split.stratified_split(features.delivery_features(testbed.flat(spark, SF_SMALL))))
    try:
        assert prep.train.columns == ["label", "features"]
    finally:
        prep.release()
