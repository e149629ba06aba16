"""Streams of several batches whose files are not ordered by time."""

import os

from pyspark.sql import functions as F

from lexdelta.streaming import ingest


def test_complete_counts_lose_no_rows_of_later_batches(spark, tmp_path):
    d = str(tmp_path)
    os.mkdir(f"{d}/events.parquet")
    for k, hours in enumerate([(9, 10), (1, 10), (5, 1), (3, 9), (1, 5), (10, 2)]):
        e = spark.createDataFrame([(f"2024-01-01 {h:02}:10:00", "t", 1.5) for h in hours], "s string, event_type string, value double").withColumn("ts", F.to_timestamp("s"))
        e.coalesce(1).write.parquet(f"{d}/part")
        (part,) = [f for f in os.listdir(f"{d}/part") if f.endswith(".parquet")]
        at = f"{d}/events.parquet/{k}.parquet"
        os.rename(f"{d}/part/{part}", at)
        os.utime(at, (1.7e9 + k, 1.7e9 + k))
        for f in os.listdir(f"{d}/part"):
            os.remove(f"{d}/part/{f}")
        os.rmdir(f"{d}/part")
    s = ingest.read_stream(spark, d, "events", files_per_trigger=2)
    got = {r["window_start"].hour: (r["n"], r["cents"]) for r in ingest.complete_counts(s).collect()}
    assert got == {1: (3, 450), 2: (1, 150), 3: (1, 150), 5: (2, 300), 9: (2, 300), 10: (3, 450)}
