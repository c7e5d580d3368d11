"""Tables cut off from their lineage, and batches cut to a bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a purely local session may go without the setting; it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    return _LOCAL[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the JVM deletes it when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@contextmanager
def held(spark: SparkSession, **settings: str):
    """Session settings (dots as ``__``) that hold inside the block alone."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def own_jobs(spark: SparkSession, rows: int = 500):
    """Settings of the operators' own jobs: shuffle files go when a job ends, and Python workers
    get texts in batches of at most ``rows``, so that long texts don't add up in memory.
    """
    most = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    rows = min(rows, most) if most > 0 else rows
    return held(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxRecordsPerBatch=str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with own_jobs(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["scratch"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing will read again."""
    for df in tables:
        delete(df.sparkSession, df.__dict__["scratch"])


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def sample_by_hash(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` values of ``column`` with the smallest hashes, each once; the hashes alone are ordered."""
    key = F.xxhash64(column)
    last = df.select(key.alias("key")).distinct().orderBy("key").limit(n).agg(F.max("key")).first()[0]
    few = df.where(key <= F.lit(last)) if last is not None else df.limit(0)
    return few.groupBy(key.alias("key")).agg(F.any_value(column).alias(column)).select(column)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        size = batch.column(column).nbytes
        if size <= limit or batch.num_rows <= 1:
            if batch.num_rows:
                yield batch
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(n)
        yield batch.slice(begin)
