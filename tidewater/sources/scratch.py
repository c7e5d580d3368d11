"""Derived tables that the queries over the sample tables read: stored once for an application, in a folder that all executors share."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_MADE: dict[tuple[str, str, str], tuple[str, StructType]] = {}
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may go without and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master, key = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if key not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="tidewater-stored-")
        atexit.register(shutil.rmtree, folder, True)
        _LOCAL[key] = f"file://{folder}"
    return _LOCAL[key]


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the JVM deletes it when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for what is read more than once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of the files below a path: names, sizes and times of change."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files, seen = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hadoop, True), []
    while files.hasNext():
        x = files.next()
        seen.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()


def stored(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame], order: list[str] | None = None) -> DataFrame:
    """The table of that name over the files of ``source``, made at the first call and read by all others until the files change.

    With ``order`` the rows of one value of its first column lie in one file, or few if they are many, and each file is ordered, so that a reader
    skips pages by their statistics.  A range over all files would compute the rows once more to find its bounds.
    """
    key = (spark.sparkContext.applicationId, name, fingerprint(spark, source))
    if key not in _MADE:
        path = new_path(spark, "stored")
        rows = make()
        rows = rows.hint("rebalance", order[0]).sortWithinPartitions(*order) if order else rows
        rows.write.parquet(path)
        _MADE[key] = (path, rows.schema)
    path, schema = _MADE[key]
    return spark.read.schema(schema).parquet(path)
