"""Tables in buckets of Parquet files, commits over several tables at once, and the merge rules of upserts.

A table's rows are dealt to buckets by a hash of its key; a merge reads and writes the buckets of the new rows alone.  What
a bucket consists of stands in a commit, a small JSON file with the files of all tables.  A transaction writes new files beside
the old ones and ends with one new commit, which is made exclusively: of two writers that began at the same commit one
fails with ``Conflict``, and a run that breaks off before its commit leaves nothing but files that no commit names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType


def replace_columns(old: DataFrame, new: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """Rows of both; of a key in both, ``columns`` are the new ones and all others stay as first written."""
    columns, new = set(columns), new.select(*(F.col(c).alias(f"__{c}") for c in new.columns))
    both = old.withColumn("__old", F.lit(True)).join(new, F.col(key) == F.col(f"__{key}"), "full")

    def pick(c: str):
        if f"__{c}" not in both.columns:
            return F.col(c)
        later = F.coalesce(F.col(f"__{c}"), F.col(c)) if c in columns else F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}"))
        return later.alias(c)

    return both.select(*(pick(c) for c in old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of a key stays; of new rows with one key, the one that sorts first."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*(c for c in new.columns)))
    fresh = new.withColumn("__n", first).where("__n = 1").drop("__n").join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def merge_greatest(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of both; ``column`` is the largest seen, all else as first written."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    rest = [c for c in old.columns if c not in (key, column)]
    return both.groupBy(key).agg(F.max(column).alias(column), *(F.min_by(c, "__age").alias(c) for c in rest)).select(*old.columns)


def supersede(old: DataFrame, new: DataFrame, owner: str, key: str = "rid", owners: DataFrame | None = None) -> DataFrame:
    """Active rows of owners that come anew become ``superseded``; the new rows are added or take their places.

    ``owners`` (owner) names those that come anew where some of them may have no rows any more.
    """
    owners = (new if owners is None else owners).select(F.col(owner).alias("__owner")).distinct().withColumn("__new", F.lit(True))
    marked = old.join(owners, F.col(owner) == F.col("__owner"), "left")
    marked = marked.withColumn("status", F.when(F.col("__new") & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))).drop("__owner", "__new")
    return marked.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def changed(files: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Files whose content is not what is stored for their uri."""
    if force:
        return files
    same = stored.where("status = 'active'").select("source_uri", "content_hash")
    return files.join(same, ["source_uri", "content_hash"], "left_anti")


class Conflict(RuntimeError):
    """Another writer has committed since this transaction began; nothing of it is visible."""


def bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")


class Store:
    """Named tables below one folder.

    ``bucket_bytes`` is what a bucket may have on the average before a table's buckets are doubled.  The folder's file system must not rename
    onto an existing file (HDFS, ABFS) or be local; on stores without that, such as S3, one writer at a time is up to the caller.
    """

    def __init__(self, spark: SparkSession, folder: str, bucket_bytes: int = 256 << 20, buckets: int = 4):
        self.spark, self.folder, self.bucket_bytes, self.buckets = spark, folder.rstrip("/"), bucket_bytes, buckets

    def _path(self, text: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        path, fs = self._path(f"{self.folder}/_commits")
        if not fs.exists(path):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def state(self, commit: int) -> dict[str, Any]:
        """The tables of a commit: schema, key, number of buckets, and files with their bytes, by bucket."""
        if not commit:
            return {}
        path, fs = self._path(f"{self.folder}/_commits/{commit:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def head(self) -> tuple[int, dict[str, Any]]:
        last = (self.commits() or [0])[-1]
        return last, self.state(last)

    def has(self, name: str) -> bool:
        return name in self.head()[1]

    def read(self, name: str) -> DataFrame:
        return self.load(self.head()[1][name])

    def load(self, entry: dict[str, Any], only: set[int] | None = None) -> DataFrame:
        """The rows of a table as a commit has them, or those of some buckets; no files make an empty table."""
        schema = StructType.fromJson(entry["schema"])
        files = [f"{self.folder}/{f}" for b, own in entry["files"].items() if only is None or int(b) in only for f, _ in own]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def begin(self) -> Transaction:
        return Transaction(self)

    def clean(self, keep: int = 2) -> int:
        """Delete commits before the last ``keep`` and all files that none of the kept ones names; returns how many of these.

        For times when nobody writes: a transaction that is under way has files that no commit names yet.
        """
        commits = self.commits()
        named = {f for c in commits[-keep:] for entry in self.state(c).values() for own in entry["files"].values() for f, _ in own}
        for old in commits[:-keep]:
            path, fs = self._path(f"{self.folder}/_commits/{old:010d}.json")
            fs.delete(path, False)
        stray = [f for f, _ in self.files_below("data") if f not in named]
        for f in stray:
            path, fs = self._path(f"{self.folder}/{f}")
            fs.delete(path, False)
        return len(stray)

    def files_below(self, inside: str) -> list[tuple[str, int]]:
        """(path below the folder, bytes) of Parquet files."""
        path, fs = self._path(f"{self.folder}/{inside}")
        if not fs.exists(path):
            return []
        root, found, files = fs.makeQualified(self._path(self.folder)[0]).toUri().getPath(), [], fs.listFiles(path, True)
        while files.hasNext():
            x = files.next()
            if x.getPath().getName().endswith(".parquet"):
                found.append((x.getPath().toUri().getPath().removeprefix(root).lstrip("/"), x.getLen()))
        return found

    def put(self, commit: int, state: dict[str, Any]) -> None:
        """Write a commit unless there is one of its number: a whole file is made first and then given its name."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        made, fs = self._path(f"{self.folder}/_commits/_{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        target, _ = self._path(f"{self.folder}/_commits/{commit:010d}.json")
        try:
            if fs.getUri().getScheme() == "file":
                java = jvm.java.nio.file.Paths
                empty = self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
                jvm.java.nio.file.Files.createLink(java.get(target.toUri().getPath(), empty), java.get(made.toUri().getPath(), empty))
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(made, target, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"commit {commit} was made by another writer") from None
            raise
        finally:
            fs.delete(made, False)


class Transaction:
    """Changes to several tables that become visible together.  Reads see the commit it began at and its own changes."""

    def __init__(self, store: Store):
        self.store = store
        self.base, self.state = store.head()
        self.number = self.base + 1

    def has(self, name: str) -> bool:
        return name in self.state

    def read(self, name: str) -> DataFrame:
        return self.store.load(self.state[name])

    def staged(self, rows: DataFrame) -> DataFrame:
        """``rows`` written once, for what is read more than once; ``clean`` removes them."""
        path = f"{self.store.folder}/data/_staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def _written(self, name: str, rows: DataFrame, key: str, n: int) -> dict[str, list]:
        """Files by bucket.  Rebalancing splits a large bucket into several files and puts small ones together in a task."""
        inside = f"data/{name}/{uuid.uuid4().hex}"
        rows.withColumn("__bucket", bucket(key, n)).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.store.folder}/{inside}")
        files: dict[str, list] = {}
        for f, size in self.store.files_below(inside):
            files.setdefault(f.rpartition("/")[0].rpartition("=")[2], []).append([f, size])
        return files

    def replace(self, name: str, rows: DataFrame, key: str) -> None:
        """The whole table anew."""
        n = self.state[name]["buckets"] if self.has(name) else self.store.buckets
        self.state = self.state | {name: {"schema": rows.schema.jsonValue(), "key": key, "buckets": n, "files": self._written(name, rows, key, n)}}

    def merge(self, name: str, new: DataFrame, key: str, rule: Callable[[DataFrame, DataFrame], DataFrame], touched: DataFrame | None = None) -> None:
        """``rule(old, new)`` in place of the rows of the buckets of ``new``, or of ``touched`` (with the key), whose old rows may change.

        The rule must see all it needs in the rows that share a key.  Pass written tables: both are read twice.
        """
        if not self.has(name):
            return self.replace(name, rule(self.store.spark.createDataFrame([], new.schema), new), key)
        entry = self.state[name]
        n, size = entry["buckets"], sum(s for own in entry["files"].values() for _, s in own)
        grown = n
        while size > grown * self.store.bucket_bytes:
            grown *= 2
        keys = new.select(key) if touched is None else new.select(key).union(touched.select(key))
        own = {r[0] for r in keys.select(bucket(key, n)).distinct().collect()}  # as many as buckets at most
        if grown > n:
            own = None  # every bucket is dealt anew
        elif not own:
            return None
        files = self._written(name, rule(self.store.load(entry, own), new), key, grown)
        kept = {} if own is None else {b: f for b, f in entry["files"].items() if int(b) not in own}
        self.state = self.state | {name: entry | {"buckets": grown, "files": kept | files}}

    def append(self, name: str, rows: DataFrame, order: list[str], live: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Rows as a further segment of the table, with those of one value of ``order[0]`` in one file, or few if they are many, and each file in that
        order, so that readers skip by the pages' statistics.

        The newest segments go together into one while the older one is no more than twice as large as they are, so that there are
        as many as the table's size has binary digits; ``live`` then keeps the rows that still count.
        """
        entry = self.state.get(name) or {"schema": rows.schema.jsonValue(), "key": order[0], "buckets": 0, "files": {}}
        made = self._segment(name, rows, order)
        segments = sorted(entry["files"].items(), key=lambda x: int(x[0]))
        size = lambda files: sum(s for _, s in files)
        joined: list[tuple[str, list]] = []
        while segments and size(segments[-1][1]) <= 2 * (size(made) + sum(size(f) for _, f in joined)) and len(segments) + len(joined) >= 4:
            joined.append(segments.pop())
        number = int(joined[-1][0]) if joined else int(segments[-1][0]) + 1 if segments else 0
        if joined:
            old = self.store.load(entry | {"files": {"0": [f for _, own in joined for f in own] + made}})
            made = self._segment(name, live(old) if live else old, order)
        self.state = self.state | {name: entry | {"files": dict(segments) | ({str(number): made} if made else {})}}

    def _segment(self, name: str, rows: DataFrame, order: list[str]) -> list[list]:
        inside = f"data/{name}/{uuid.uuid4().hex}"
        rows.hint("rebalance", order[0]).sortWithinPartitions(*order).write.parquet(f"{self.store.folder}/{inside}")
        return [list(f) for f in self.store.files_below(inside)]

    def commit(self) -> int:
        self.store.put(self.number, self.state)
        return self.number
