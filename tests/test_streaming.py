from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiprisk.operators import clean
from shiprisk.plans import gold
from shiprisk.sources import csv_io, tables, testbed
from shiprisk.streaming import incremental

from conftest import SF_SMALL

TS = {"order_date_dateorders": "order_date", "shipping_date_dateorders": "shipping_date"}


def test_incremental_refresh_matches_batch(spark, tmp_root):
    typed = testbed.typed_rows(spark, SF_SMALL)
    # three arrivals; the third re-sends the pending orders' lines
    first = typed.where("order_status <> 'P'")
    second = typed.where("order_status = 'P'")
    for i, part in enumerate([first, second, second]):
        csv_io.write_raw_csv(part.coalesce(1), f"{tmp_root}/in_{i}")
    # move the three single-file outputs into one landing folder, in order
    import glob
    import os
    import shutil

    from shiprisk.session import local_path
    landing = f"{local_path(tmp_root)}/landing"
    os.makedirs(landing)
    for i in range(3):
        src = glob.glob(f"{local_path(tmp_root)}/in_{i}/part-*.csv")[0]
        shutil.copy(src, f"{landing}/batch_{i}.csv")
        os.utime(f"{landing}/batch_{i}.csv", (1_000_000 + i, 1_000_000 + i))
    types = {f.name: f.dataType for f in typed.schema.fields
             if not isinstance(f.dataType, (T.StringType, T.TimestampNTZType))}
    root = f"{tmp_root}/tables"
    gold_root = f"{root}/gold_shipping_risk"
    n_versions = incremental.run_gold_refresh(spark, landing, root, f"{tmp_root}/ckpt", types, TS,
                                              files_per_trigger=1)
    assert n_versions == 3
    totals = [tables.read_run(spark, gold_root, v).agg(F.sum("total_shipments")).first()[0]
              for v in range(3)]
    assert totals[0] < totals[1] == totals[2]  # re-sent lines are dropped
    # restart from the same checkpoint with no new files: nothing is re-published
    again = incremental.run_gold_refresh(spark, landing, root, f"{tmp_root}/ckpt", types, TS,
                                         files_per_trigger=1)
    assert again == 3
    batch = gold.gold_shipping_risk(clean.drop_pii(clean.clean_typed(typed)))
    assert sorted(map(tuple, tables.read_run(spark, gold_root).collect())) == \
        sorted(map(tuple, batch.collect()))
    # every batch replayed from the start (a lost checkpoint): the same versions again
    replayed = incremental.run_gold_refresh(spark, landing, root, f"{tmp_root}/ckpt2", types, TS,
                                            files_per_trigger=1)
    assert replayed == 3
    assert [tables.read_run(spark, gold_root, v).agg(F.sum("total_shipments")).first()[0] for v in range(3)] == totals
    assert tables.runs(spark, f"{root}/digests").groupBy("digest").count().filter("count > 1").isEmpty()


def test_row_digests_tell_nulls_and_shifted_values_apart(spark):
    rows = [("a", None), (None, "a"), ("", "a"), ("a", ""), ("ab", "c"), ("a", "bc"), ("1:a", "b"), ("-", "b"), (None, "b")]
    df = spark.createDataFrame(rows + rows[:3], "x string, y string")
    assert incremental.new_rows(df, None).count() == len(rows)
    seen = incremental.new_rows(df.limit(2), None)
    assert incremental.new_rows(df, seen).count() == len(rows) - seen.count()
