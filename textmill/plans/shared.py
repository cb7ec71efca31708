"""Written tables in the folder that driver and executors share; they cut the lineage of loops.

All of an application's tables lie in one folder. An operator discards those that its result no
longer needs; the rest goes with the application (`discard_all`, which also runs when the
driver's Python ends).
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; a local session without that setting (tests) gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="textmill-"))
        found = spark.conf.get("spark.checkpoint.dir")
    own = f"{found.rstrip('/')}/textmill-{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_leave, spark, own)
    return own


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read again."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._textmill_path = path
    return made


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(at)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that materialize() made and that no plan still to be run reads."""
    for table in tables:
        path = getattr(table, "_textmill_path", None)
        if path:
            delete(table.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Deletes every table of this application; results that were not written elsewhere are gone then."""
    delete(spark, shared_dir(spark))


def _leave(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone before
        delete(spark, path)
