"""Rows that wait for their keys on a stream: each once, in whatever order both arrive."""

import random

from pyspark.sql import functions as F

from lumenar.streaming import admission


def test_rows_are_admitted_once(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(12)])) for i in range(80)]
    keys = [(rng.choice([None, *range(0, 12, 2)]),) for _ in range(40)] + [(2,)] * 20
    waiting = admission.replay(spark.createDataFrame(rows, "id long, key long"), 3, "waiting")
    told = admission.replay(spark.createDataFrame(keys, "key long"), 4, "keys")
    got, progress = admission.landed(admission.admitted(waiting, told, "key"), "admitted")
    known = {k for (k,) in keys if k is not None}
    assert sorted(r["id"] for r in got.collect()) == [i for i, k in rows if k in known]
    assert len(progress) >= 3 and got.columns == ["id", "key"]


def test_rows_beyond_the_time_limit_stay_out(spark):
    at = lambda minutes: F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col(minutes))
    rows = spark.createDataFrame([(1, 7, 0), (2, 7, 50), (3, 8, 3), (4, 9, 4)], "id long, key long, m long").withColumn("t", at("m")).drop("m")
    keys = spark.createDataFrame([(7, 5), (8, 0), (8, 1)], "key long, m long").withColumn("t", at("m")).drop("m")
    got, _ = admission.landed(admission.admitted(admission.replay(rows, 1, "rows"), admission.replay(keys, 1, "keys"), "key", "t", "10 minutes"), "admitted")
    assert sorted(r["id"] for r in got.collect()) == [1, 3]
