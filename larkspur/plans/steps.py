"""Written steps: cutting the lineage of iterative programs in the shared folder."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, as in tests, a local session uses a folder of its own; on
    a cluster that is an error, since no machine-local folder is seen by all.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file:///tmp/checkpoints/larkspur-{os.getpid()}"
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone at interpreter exit
            pass

    atexit.register(drop)
    return path


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes a frame as Parquet into the shared folder and reads it back.

    Lost executors never cause more than the reading of files, and later steps
    plan on files of known size.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def superseded(*steps: DataFrame | None) -> None:
    """Deletes the files of steps that nothing reads any more."""
    for df in steps:
        own = {} if df is None else vars(df)  # not getattr, which finds columns too
        if table := own.get("_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path := own.get("_step"):
            remove(df.sparkSession, path)


def keyed(df: DataFrame, key: str, name: str = "keyed") -> DataFrame:
    """Writes a frame bucketed by a column into the shared folder: joins on that column only shuffle their other side.

    The buckets need a name in the catalog, which goes with superseded() or when
    the driver ends.
    """
    spark = df.sparkSession
    path, n = new_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"larkspur_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._step, out._table = path, table

    def drop() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the session may be gone at interpreter exit
            pass

    atexit.register(drop)
    return out
