"""Deliveries as streams: windowed counts with late data, and the newest version of each bill as files arrive.

Batch is the special case: ``availableNow`` runs a stream over what is there and ends.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdelta.session import shared_dir


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """The files of a delivered table as a stream, be the table one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs).isDirectory()
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(f"{sf_dir}/{name}.parquet") if folder else r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of tumbling windows; rows later than ``late`` are dropped by the watermark, none if it is None."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e if late is None else e.withWatermark(ts, late)
    return e.groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.col("w.start").alias("window_start"), "event_type", "n", "cents")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything there is into the shared folder and read the result."""
    spark = stream.sparkSession
    base = os.path.join(shared_dir(spark), f"stream-{name}-{uuid.uuid4().hex}")
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/log").option("path", f"{base}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def complete_counts(events: DataFrame, late: str | None = None, **options: str) -> DataFrame:
    """``windowed_counts`` of everything a stream holds, open windows too: each batch updates its windows in a state folder.

    Appending would hold back the windows the watermark has not passed; here the newest figures of a window win.
    Files come in any order of time, so there is no watermark and the state is a row a window and type; a ``late`` that
    is given bounds the state and drops rows of later batches.
    """
    spark = events.sparkSession
    counts = windowed_counts(events, late=late, **options)
    base = os.path.join(shared_dir(spark), f"stream-windows-{uuid.uuid4().hex}")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/b={number}")

    q = counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "cents"), "batch_no").alias("x")).select("window_start", "event_type", "x.*")


def latest_versions(versions: DataFrame, name: str = "latest") -> DataFrame:
    """(bill_id, version_no, version_label, delivered_at): the newest delivery of each bill's highest version, kept up batch by batch.

    Each micro-batch is reduced to one row a bill and merged with the state written by the last one, so the state is a
    row a bill however many deliveries there were. A batch that is run again gives the same state.
    """
    spark = versions.sparkSession
    base = os.path.join(shared_dir(spark), f"stream-{name}-{uuid.uuid4().hex}")
    pick = lambda df: df.groupBy("bill_id").agg(F.max_by(F.struct("version_no", "version_label", "delivered_at"), F.struct("version_no", "delivered_at")).alias("x")).select("bill_id", "x.*")
    lean = versions.select("bill_id", "version_no", "version_label", "delivered_at").where("bill_id is not null")

    def merge(batch: DataFrame, number: int) -> None:
        fresh = pick(batch)
        if number > 0:
            fresh = pick(fresh.unionByName(spark.read.schema(fresh.schema).parquet(f"{base}/state-{number - 1}")))
        fresh.write.mode("overwrite").parquet(f"{base}/state-{number}")
        last[0] = number

    last = [-1]
    q = lean.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], lean.schema)
    return spark.read.parquet(f"{base}/state-{last[0]}").select(lean.columns)
