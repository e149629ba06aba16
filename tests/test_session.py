"""Written stages and partitions asked for by number."""

import os

from lexdelta import session


def test_a_written_stage_is_read_back_and_given_up(spark):
    df = session.cut(spark.range(10).selectExpr("id", "cast(null as string) t"), "test")
    assert df.count() == 10 and df.schema.simpleString() == "struct<id:bigint,t:string>"
    path = df._lexdelta_path.removeprefix("file:")
    assert os.path.isdir(path)
    session.discard(df)
    assert not os.path.exists(path)


def test_groups_are_spread_however_few_bytes_they_are(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = session.spread(spark.range(100).selectExpr("id % 50 k"), "k")
    assert df.rdd.getNumPartitions() == n
    held = df.groupBy("k").applyInPandas(lambda p: p.head(1), "k bigint")
    assert held.rdd.getNumPartitions() == n and held.count() == 50
