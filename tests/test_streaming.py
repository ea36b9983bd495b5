"""Streams over dropped files: late data, exactly-once appends, weekly windows."""

import datetime as dt

from pyspark.sql import functions as F

from lexstrata.streaming import events as S


def test_append_once(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "table", "ck"))
    write = lambda rows: spark.createDataFrame(rows, "id string, v int").write.mode("append").parquet(src)
    write([("a", 1), ("b", 2), ("a", 3)])
    schema = spark.read.parquet(src).schema
    S.append_once(S.follow(spark, src, schema), out, ck).awaitTermination()
    write([("b", 9), ("c", 4)])
    S.append_once(S.follow(spark, src, schema), out, ck).awaitTermination()
    S.append_once(S.follow(spark, src, schema), out, f"{ck}2").awaitTermination()  # a lost checkpoint adds nothing
    got = [r.id for r in spark.read.parquet(out).collect()]
    assert sorted(got) == ["a", "b", "c"]


def test_weeks_begin_on_monday(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 7, 5), "k", 1.0), (dt.datetime(2026, 1, 11, 23), "k", 2.0), (dt.datetime(2026, 1, 12), "k", 4.0)], "ts timestamp, k string, v double")
    got = {r.start: r.total for r in S.tumbling(df, ["k"], "v", late=None).collect()}
    assert got == {dt.datetime(2026, 1, 5): 3.0, dt.datetime(2026, 1, 12): 4.0}


def test_late_rows_are_left_out(spark, tmp_path):
    """The watermark of a batch filters the late rows of the batch after the next."""
    src = f"{tmp_path}/in"
    day = lambda d: dt.datetime(2026, 1, d, 12)
    schema = "ts timestamp, k string, v double"
    for rows in ([(day(1), "k", 1.0)], [(day(20), "k", 1.0)], [(day(21), "k", 1.0)], [(day(2), "k", 1.0)], [(day(31), "k", 1.0)], [(day(31), "k", 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        import time

        time.sleep(0.05)
    stream = S.follow(spark, src, spark.read.parquet(src).schema, max_files=1)
    S.to_memory(S.tumbling(stream, ["k"], "v", width="1 day", start="0 days", late="3 days"), "late_days").awaitTermination()
    got = {r.start.day: r.n for r in spark.table("late_days").collect()}
    assert got[1] == 1 and 2 not in got and got[20] == 1


def test_sessions(spark):
    ts = [dt.datetime(2026, 1, 1, 0, 0), dt.datetime(2026, 1, 1, 0, 30), dt.datetime(2026, 1, 1, 3, 0)]
    df = spark.createDataFrame([("u", t) for t in ts], "u string, ts timestamp")
    assert sorted(r.n for r in S.sessions(df, "u", "1 hour", late=None).collect()) == [1, 2]
    assert S.drop_future(spark.createDataFrame([(dt.datetime(2999, 1, 1),)], "ts timestamp")).count() == 0
    assert F is not None
