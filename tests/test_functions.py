import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from shiprisk.functions import discount_bucket, month_label, rate_pct, ratio_round
from shiprisk.functions.calendar import before, weekday_index, weekday_name, year_range


def test_rate_pct_half_up_exact(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3), (0, 5), (5, 0), (1, 200000)], "late long, n long")
    got = [r[0] for r in df.select(rate_pct("late", "n")).collect()]
    # 12.5, 33.333.. -> 33.33, 66.666.. -> 66.67, 0, division by zero -> NULL, 0.0005 -> 0.0
    assert got == [12.5, 33.33, 66.67, 0.0, None, 0.0]


def test_ratio_round_negative_and_ties(spark):
    df = spark.createDataFrame([(-1, 8), (-5, 2), (5, 2), (1, -8), (1005, 1000)], "a long, b long")
    got = [r[0] for r in df.select(ratio_round("a", "b", 2)).collect()]
    # half away from zero, exactly like DECIMAL ROUND (1.005 -> 1.01)
    assert got == [-0.13, -2.5, 2.5, -0.13, 1.01]


def test_discount_bucket_edges(spark):
    rows = [(Decimal("0.0000"),), (Decimal("0.1000"),), (Decimal("0.1001"),), (Decimal("0.2000"),),
            (Decimal("0.2500"),), (None,)]
    df = spark.createDataFrame(rows, "r decimal(6,4)")
    got = [r[0] for r in df.select(discount_bucket("r")).collect()]
    assert got == ["No Discount", "Low (0-10%)", "Medium (10-20%)", "Medium (10-20%)",
                   "High (20%+)", "High (20%+)"]


def test_weekday_and_month(spark):
    df = spark.createDataFrame([(dt.datetime(2017, 10, 29, 5, 0),), (dt.datetime(2017, 10, 30, 0, 0),)],
                               "d timestamp_ntz")
    got = df.select(weekday_name("d"), weekday_index("d"), month_label("d")).collect()
    assert [tuple(r) for r in got] == [("Sunday", 6, "2017-10"), ("Monday", 0, "2017-10")]


def test_cutoff_is_strict_and_year_range(spark):
    df = spark.createDataFrame([(dt.datetime(2017, 10, 31, 23, 59),), (dt.datetime(2017, 11, 1, 0, 0),)],
                               "d timestamp_ntz")
    assert df.where(before("d", "2017-11-01")).count() == 1
    assert df.where(year_range("d", 2017)).count() == 2
    assert df.where(year_range("d", 2018)).count() == 0


def test_cutoff_filter_reaches_parquet_scan(spark, tmp_root, capsys):
    df = spark.createDataFrame([(dt.datetime(2017, 10, 31, 23, 59), 1)], "order_date timestamp_ntz, x int")
    df.write.parquet(f"{tmp_root}/t")
    q = spark.read.parquet(f"{tmp_root}/t").where(before("order_date", "2017-11-01")).select(F.col("x"))
    q.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(order_date), LessThan(order_date," in plan


def test_ratio_round_matches_decimal_half_up(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal

    rnd = random.Random(7)
    pairs = []
    for _ in range(2000):
        den = rnd.choice([1, 2, 3, 7, 8, 400, 2_000_003, rnd.randint(1, 10**12)])
        num = rnd.randint(-10**13, 10**13) if rnd.random() < 0.5 else rnd.randint(-50, 50)
        pairs.append((num, den * rnd.choice([1, -1])))
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", ratio_round("a", "b", 2, 100).alias("pct"),
                    ratio_round("a", "b", 4).alias("r4")).collect()
    for r in got:
        # the rounded value is exact; its DOUBLE form is correctly rounded
        # while the scaled integer stays below 2**53
        if abs(Decimal(r.a) / Decimal(r.b)) * 10**4 >= 2**53:
            continue
        exact = Decimal(r.a) * 100 / Decimal(r.b)
        want_pct = float((Decimal(r.a) * 100 / Decimal(r.b)).quantize(Decimal("0.01"), ROUND_HALF_UP))
        want_r4 = float((Decimal(r.a) / Decimal(r.b)).quantize(Decimal("0.0001"), ROUND_HALF_UP))
        assert r.pct == want_pct, (r.a, r.b, exact)
        assert r.r4 == want_r4, (r.a, r.b)
