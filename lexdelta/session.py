"""Session factory and the helpers that cut lineage on shared storage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "lexdelta", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here relies on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (_DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a context, where their path does not have it already."""
    package = os.path.dirname(os.path.abspath(__file__))
    root, sc = os.path.dirname(package), spark.sparkContext
    have = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if root in have or getattr(sc, "_lexdelta_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="lexdelta-package-"), "lexdelta.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    sc._lexdelta_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` when set, else (tests) a local one."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if given:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(given)
        return given
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lexdelta-")
    sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into as many partitions as a shuffle has.

    For groups that Python works on: adaptive execution joins small partitions by their bytes, not by the work they make, but
    leaves partitions alone whose number was asked for.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table survives the loss of executors and is compressed parquet, so it is smaller
    than an RDD checkpoint. It is removed when the driver ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"lexdelta-{name}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._lexdelta_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that ``cut`` wrote and that nothing reads any more."""
    _remove(df.sparkSession, df._lexdelta_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already; the folder is scratch space
        pass
