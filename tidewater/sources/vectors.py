"""The vector index of a store: inverted lists around centroids, probed for many queries at once, with exact distances at the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewater.functions import access
from tidewater.sources.store import Store, Transaction

MOST_BYTES = 256 << 20  # of all centroids, which every task holds


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors as rows; a zero vector stays zero."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there, is not zero and holds numbers alone; others can't have a direction."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))


def nearest(rows: DataFrame, centroids: np.ndarray, n: int, column: str = "embedding") -> DataFrame:
    """``rows`` with ``lists``, the ``n`` centroids with the largest inner products, best first; ties go to the smaller number."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)  # MOST_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                near = np.argsort(-(_matrix(part.column(column)) @ held.value.T), axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], [*part.schema.names, "lists"])

    rows = rows.drop("lists")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, lists array<int>")


def train(vectors: DataFrame, n_lists: int, rounds: int = 8, column: str = "embedding", sample_rows: int | None = None) -> np.ndarray:
    """``n_lists`` centroids of the directions of ``vectors`` (rid, embedding) by distributed k-means; fewer if there are fewer vectors.

    The centroids are fitted to ``sample_rows`` vectors, 256 for each list unless given, in the order of a hash of rid; all vectors are
    indexed.  Each round every task sums its vectors by list, so that what is shuffled is a row for each task and list.  A list
    that stays empty keeps its centroid.
    """
    seen = usable(vectors.select("rid", column), column).orderBy(F.xxhash64("rid"), "rid").limit(sample_rows or 256 * n_lists)
    first = seen.limit(n_lists).toArrow()  # n_lists rows
    if not first.num_rows:
        return np.zeros((0, 0))
    centroids = _matrix(first.column(column))
    if centroids.nbytes > MOST_BYTES:
        raise ValueError(f"{n_lists} centroids of {centroids.shape[1]} dimensions are more than {MOST_BYTES >> 20} MB")
    seen = seen.select(column).repartition(8 * vectors.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        for _ in range(rounds):
            held = vectors.sparkSession.sparkContext.broadcast(centroids)

            def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                total, count = np.zeros_like(held.value), np.zeros(len(held.value), np.int64)
                for batch in batches:
                    rows = _matrix(batch.column(column))
                    own = (rows @ held.value.T).argmax(1) if len(rows) else np.zeros(0, np.int64)
                    np.add.at(total, own, rows)
                    count += np.bincount(own, minlength=len(count))
                used = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(list(total[used]), pa.list_(pa.float64()))], ["list", "total"])

            parts = seen.mapInArrow(sums, "list int, total array<double>").select("list", F.posexplode("total").alias("i", "x")).groupBy("list", "i").agg(F.sum("x").alias("x"))
            found = parts.groupBy("list").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding")).toArrow()  # n_lists rows
            moved = centroids.copy()
            moved[found.column("list").to_numpy()] = _matrix(found.column("embedding"))
            done = np.allclose(moved, centroids, atol=1e-6)
            centroids = moved
            if done:
                break
    finally:
        seen.unpersist()
    return centroids


def _cells(sizes: dict[int, int], rows: int) -> dict[int, tuple[int, int]]:
    """The first cell and the number of cells of each list, given their sizes: small lists share a cell, and one with more than ``rows`` rows gets several."""
    found, cell, room = {}, -1, 0
    for name, n in sorted(sizes.items()):
        parts = -(-n // rows)
        if parts > 1 or n > room:
            cell, room = cell + 1, rows
        found[name] = (cell, parts)
        cell, room = cell + parts - 1, room - n if parts == 1 else 0
    return found


def _within(k: int):
    """The k nearest of a cell's vectors for each query of a block, in the lists it asks."""

    def run(stored: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", asked.schema.field("query_id").type), ("rid", pa.string()), ("distance", pa.float64()), ("list", pa.int32())])
        if not stored.num_rows or not asked.num_rows:
            return schema.empty_table()
        stored = stored.sort_by("rid")
        vectors, lists = _matrix(stored.column("embedding")), stored.column("list").to_numpy()
        queries, wanted = _matrix(asked.column("q")), asked.column("lists").to_pylist()
        order = sorted(range(len(wanted)), key=lambda i: wanted[i])  # queries of like lists go together
        places, owners, distances = [], [], []
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            union = sorted(set().union(*(wanted[i] for i in part)))
            some = np.flatnonzero(np.isin(lists, union))
            if not len(some):
                continue
            raw = 1 - queries[part] @ vectors[some].T
            for j, i in enumerate(part):
                own = np.arange(len(some)) if wanted[i] == union else np.flatnonzero(np.isin(lists[some], wanted[i]))
                mine = np.round(raw[j, own], 6)
                limit = np.partition(mine, k - 1)[k - 1] if len(mine) > k else np.inf
                own, mine = own[mine <= limit], mine[mine <= limit]
                own = own[np.argsort(mine, kind="stable")[:k]]  # rows are in the order of rid, so ties go to the smaller
                places.append(some[own]), owners.append(np.full(len(own), i)), distances.append(raw[j, own])
        if not places:
            return schema.empty_table()
        at, owner = pa.array(np.concatenate(places)), pa.array(np.concatenate(owners))
        return pa.Table.from_arrays([asked.column("query_id").take(owner), stored.column("rid").take(at), pa.array(np.concatenate(distances)), stored.column("list").take(at)], schema=schema)

    return run


def _ranked(stored: DataFrame, asked: DataFrame, k: int, rows: int = 1 << 14, queries: int = 1 << 12) -> DataFrame:
    """(query_id, rid, list, score, rank): the k nearest of ``stored`` (rid, list, embedding) for each query of ``asked`` (query_id, q, lists), in the lists it asks.

    Vectors go by list into cells of about ``rows``, queries into blocks of about ``queries``; each cell meets each block that asks it as
    one product of matrices and gives k rows for a query.
    """
    spark = stored.sparkSession
    cells = _cells({r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}, rows)  # as many as centroids
    blocks = max(1, -(-asked.count() // queries))
    held = spark.sparkContext.broadcast(cells)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own: dict[int, list[int]] = {}
                for name in sorted(batch.column("lists")[at].as_py()):
                    first, parts = held.value.get(name, (0, 0))
                    for cell in range(first, first + parts):
                        own.setdefault(cell, []).append(name)
                one = pa.array(np.full(len(own), at))
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array(list(own.values()), pa.list_(pa.int32())), *(batch.column(c).take(one) for c in ("query_id", "q", "block"))], ["cell", "lists", "query_id", "q", "block"])

    kind = asked.schema["query_id"].dataType.simpleString()
    by_block = asked.select("query_id", F.col("q").cast("array<double>").alias("q"), "lists", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    right = by_block.mapInArrow(spread, f"cell int, lists array<int>, query_id {kind}, q array<double>, block int")
    table = F.broadcast(spark.createDataFrame([(n, *c) for n, c in cells.items()], "list int, first int, parts int"))  # as many as centroids
    placed = stored.select("rid", "list", "embedding").join(table, "list").withColumn("cell", (F.col("first") + F.pmod(F.xxhash64("rid"), F.col("parts"))).cast("int"))
    left = placed.select("rid", "list", "embedding", "cell", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    near = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(_within(k), f"query_id {kind}, rid string, distance double, list int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "rid"))
    return near.withColumn("score", F.round("distance", 6)).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rid", "list", "score", "rank")


class VectorIndex:
    """Two tables of a store: ``centroids`` (list, centroid), and ``vectors`` (rid, list, generation, embedding) in segments ordered by list.

    As with postings, a vector counts while ``lengths`` has its row in its generation, so that an update writes what it brings.
    """

    def __init__(self, store: Store):
        self.store = store

    def build(self, tx: Transaction, rows: DataFrame, n_lists: int | None = None, recall: float = 0.95, trials: int = 64) -> int:
        """Fit centroids to ``rows`` (rid, embedding), about the square root of their number unless given, and index them; returns the number of lists.

        ``trials`` of the vectors, in the order of a hash, are then searched in all lists; as many lists as hold the share ``recall`` of their ten
        nearest are probed by searches that don't ask for another number.
        """
        n = n_lists or max(1, int(rows.count() ** 0.5))
        centroids = train(rows, n)
        table = self.store.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
        tx.replace("centroids", table, "list")
        tx.state = {k: v for k, v in tx.state.items() if k != "vectors"}
        self.update(tx, rows.join(tx.read("lengths").select("rid", "generation"), "rid"))
        if len(centroids):
            tx.state["centroids"]["probes"] = self._probes(tx.state, centroids, rows, recall, trials)
        return len(centroids)

    def _probes(self, state: dict, centroids: np.ndarray, rows: DataFrame, recall: float, trials: int) -> int:
        some = usable(rows).orderBy(F.xxhash64("rid"), "rid").limit(trials).select(F.xxhash64("rid").alias("query_id"), "embedding")
        asked = nearest(some, centroids, len(centroids)).select("query_id", F.col("embedding").alias("q"), "lists").persist()  # trials times lists
        found = _ranked(self.store.load(state["vectors"]), asked, 10).join(asked.select("query_id", "lists"), "query_id")
        places = sorted(r[0] for r in found.select(F.array_position("lists", F.col("list")) - 1).collect())  # ten for each trial
        asked.unpersist()
        return places[min(len(places) - 1, int(np.ceil(recall * len(places))))] + 1 if places else 1

    def update(self, tx: Transaction, rows: DataFrame) -> None:
        """Add ``rows`` (rid, generation, embedding) to the lists of their nearest centroids; rows without a usable vector are left out."""
        if not tx.has("centroids"):
            return
        centroids = self._centroids(tx.state)
        rows = usable(rows.select("rid", "generation", "embedding"))
        listed = (nearest(rows, centroids, 1) if len(centroids) else rows.limit(0).withColumn("lists", F.array(F.lit(0)))).select("rid", F.get("lists", F.lit(0)).alias("list"), "generation", "embedding")
        lengths = tx.read("lengths").select("rid", "generation")
        tx.append("vectors", listed, ["list", "rid"], live=lambda v: v.join(lengths, ["rid", "generation"], "left_semi").select(*v.columns))

    def _centroids(self, state: dict) -> np.ndarray:
        found = self.store.load(state["centroids"]).toArrow().sort_by("list")  # MOST_BYTES at most
        return _matrix(found.column("centroid")) if found.num_rows else np.zeros((0, 0))

    def search(self, queries: DataFrame, tenant: str = "default", clearance: str = "INTERNAL", k: int = 20, probes: int | None = None) -> DataFrame:
        """(query_id, rid, score, rank): the k nearest by cosine distance of each of ``queries`` (query_id, embedding), among the lists probed.

        ``probes`` lists are probed, as many as ``build`` has measured unless given; all of them make the search exact.  Distances are rounded to
        six digits, ties go to the smaller rid.  A query's own row is like any other; queries without a usable vector find nothing.
        """
        _, state = self.store.head()
        empty = self.store.spark.createDataFrame([], "query_id long, rid string, score double, rank int")
        if "vectors" not in state:
            return empty
        centroids = self._centroids(state)
        if not len(centroids):
            return empty
        n = min(len(centroids), probes or state["centroids"]["probes"])
        asked = nearest(usable(queries.select("query_id", "embedding")), centroids, n).select("query_id", F.col("embedding").alias("q"), "lists")
        seen = self.store.load(state["lengths"]).where((F.col("tenant") == tenant) & (access.level(F.col("classification")) <= access.clearance(clearance)))
        stored = self.store.load(state["vectors"]).join(seen.select("rid", "generation"), ["rid", "generation"], "left_semi")
        return _ranked(stored, asked, k).drop("list")
