"""Checked CSV load: good rows typed, bad lines kept with their reasons; co-moments merged from any split."""

import numpy as np
import pytest
from pyspark.sql import types as T

from shiprisk.plans import reports
from shiprisk.sources import csv_io

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()),
                       T.StructField("price", T.DecimalType(6, 2)), T.StructField("day", T.DateType())])
LINES = ["id,name,price,day", '1,"Lamp, large",12.50,2017-01-02', '2,"say ""hi""",3,2017-01-03', "3,,,", "x4,Box,1.00,2017-01-02",
         ",Nameless,2.00,2017-01-02", "5,Short,1.00", "6,Long,1.00,2017-01-02,more", "7,Dear,99999.99,2017-01-02",
         "y,Two,much,2017-13-45", ",,,"]


def test_every_line_is_a_good_row_or_rejected_with_reasons(spark, tmp_root):
    spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1).write.text(f"{tmp_root}/in")
    good, bad = csv_io.load_checked(spark, f"{tmp_root}/in", "items", SCHEMA, f"{tmp_root}/out")
    assert [(f.name, f.dataType) for f in good.schema.fields] == [(f.name, f.dataType) for f in SCHEMA.fields]
    rows = {r.id: (r.name, None if r.price is None else str(r.price), None if r.day is None else str(r.day))
            for r in good.collect()}
    assert rows == {1: ("Lamp, large", "12.50", "2017-01-02"), 2: ('say "hi"', "3.00", "2017-01-03"), 3: (None, None, None)}
    got = sorted((r.line, r.table_name, r.column_name, r.reason) for r in bad.fillna("-", ["column_name"]).collect())
    assert got == sorted([
        (LINES[4], "items", "id", "bad_cast"), (LINES[5], "items", "id", "null_in_not_null"),
        (LINES[6], "items", "-", "malformed"), (LINES[7], "items", "-", "malformed"),
        (LINES[8], "items", "price", "bad_cast"), (LINES[9], "items", "id", "bad_cast"),
        (LINES[9], "items", "price", "bad_cast"), (LINES[9], "items", "day", "bad_cast"),
        (LINES[10], "items", "id", "null_in_not_null")])
    assert good.count() + bad.select("line").distinct().count() == len(LINES) - 1


def test_checked_load_of_nothing(spark, tmp_root):
    spark.createDataFrame([(LINES[0],)], "value string").write.text(f"{tmp_root}/in")
    good, bad = csv_io.load_checked(spark, f"{tmp_root}/in", "items", SCHEMA, f"{tmp_root}/out")
    assert good.count() == 0 and bad.count() == 0


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_co_moments_of_any_split_equal_numpy(spark, parts):
    rng = np.random.default_rng(parts)
    x = rng.standard_normal((200, 3)) @ rng.standard_normal((3, 3)) + [0, 1e6, -5]
    known = rng.random((200, 3)) < 0.7
    rows = [tuple(float(v) if k else None for v, k in zip(a, b)) for a, b in zip(x, known)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(parts)
    for r in reports.co_moments(df, ["a", "b", "c"]).collect():
        both = known[:, r.i] & known[:, r.j]
        p, q = x[both, r.i], x[both, r.j]
        assert r.n == both.sum()
        assert (r.mx, r.my) == pytest.approx((p.mean(), q.mean()))
        assert (r.qx, r.qy, r.c) == pytest.approx((
            ((p - p.mean()) ** 2).sum(), ((q - q.mean()) ** 2).sum(), ((p - p.mean()) * (q - q.mean())).sum()), rel=1e-9)


def test_correlations_of_nothing_are_null(spark):
    got = reports.corr_matrix(spark.createDataFrame([], "a double, b double"), ["a", "b"]).collect()
    assert len(got) == 4 and all(r.correlation is None for r in got)
