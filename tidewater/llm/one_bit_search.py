"""Nearest neighbours with randomly rotated one-bit codes.

Vectors are centred, scaled to length one and rotated at random.  A code is the signs of the result, one
bit a dimension, packed; with it go the distance from the centre and f, the inner product of the rotated
vector with its own code.  <code, query> / f estimates the inner product of vector and query, with an error of
about sqrt((1 - f^2) / (f^2 (D - 1))); a multiple of it gives each candidate a lower and an upper bound
of its distance.  A candidate whose lower bound is above the k-th smallest upper bound is out.  The rest is
reranked by exact distances of the original vectors, in the same step.

Equal vectors share one code.  Of equal vectors only the k + 1 with the smallest ids can be among a query's k
nearest (ties go to smaller ids; one may be the query itself), so a crowd of copies costs one comparison.

Queries meet codes (bits, f, norm and id, but not the vectors) in blocks of bounded size.  A first round keeps,
of each block, the codes of the best estimates for each query; the best of all blocks are measured exactly, and the k-th of
these distances is the query's limit.  A second round over the codes keeps those whose lower bound is within
the limit.  Only then do these survivors meet their vectors, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .shared import written

QUERY_BLOCK, CODE_BLOCK, STEP, SAMPLE = 4096, 8192, 64, 4096
QUERY_BLOCKS = 8  # that share one reading of a block's vectors


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.RandomState(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, f, distance from the centre) of each row."""
    rest = vectors - centre
    norm = np.sqrt((rest**2).sum(1))
    unit = (rest / np.where(norm > 0, norm, 1)[:, None]) @ turn.T
    return np.packbits(unit > 0, axis=1), np.abs(unit).sum(1) / np.sqrt(vectors.shape[1]), norm


class Codes:
    """One block of codes, unpacked once."""

    def __init__(self, codes: pd.DataFrame, dim: int):
        bits = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), -1)
        self.signs = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
        self.f, self.norm, self.cid = (codes[c].to_numpy() for c in ("f", "norm", "cid"))
        safe = np.maximum(self.f, 1e-6)
        self.scale = (1 / safe).astype(np.float32)
        self.error = np.sqrt(np.maximum(1 - self.f**2, 0) / (safe**2 * max(1, dim - 1)))

    def estimates(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base, scale, inner): the squared distances are about base - scale * inner, a row for each query."""
        rest = queries - centre
        q_norm = np.sqrt((rest**2).sum(1))
        unit = (rest / np.where(q_norm > 0, q_norm, 1)[:, None]) @ turn.T
        inner = (unit.astype(np.float32) @ self.signs.T) * self.scale
        return (q_norm**2)[:, None] + (self.norm**2)[None, :], 2 * q_norm[:, None] * self.norm[None, :], inner

    def lower(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, errors: float) -> np.ndarray:
        """Lower bounds of the squared distances."""
        base, scale, inner = self.estimates(queries, centre, turn)
        return base - scale * np.minimum(inner + errors * self.error + 1e-5, 1)


def _codes(centre: np.ndarray, turn: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                bits, f, norm = encode(np.stack(rows["vector"]).astype(np.float64), centre, turn)
                yield pd.DataFrame({"cid": rows["cid"], "code": [x.tobytes() for x in bits], "f": f, "norm": norm, "block": rows["block"]})

    return run


def _promising(centre: np.ndarray, turn: np.ndarray, k: int):
    """(qid, cid, estimate): the k best estimates of one block for each query of one block."""

    def run(key, codes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"qid": [], "cid": [], "estimate": []}
        if len(codes) and len(queries):
            block = Codes(codes, len(centre))
            asked, qid, n = np.stack(queries["vector"]).astype(np.float64), queries["qid"].to_numpy(), min(k, len(codes))
            for at in range(0, len(asked), STEP):
                base, scale, inner = block.estimates(asked[at : at + STEP], centre, turn)
                guess = base - scale * np.clip(inner, -1, 1)
                best = np.argpartition(guess, n - 1, axis=1)[:, :n]
                out["qid"].append(np.repeat(qid[at : at + STEP], n))
                out["cid"].append(block.cid[best].ravel())
                out["estimate"].append(np.take_along_axis(guess, best, 1).ravel())
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0) for c, x in out.items()}).astype({"qid": "int64", "cid": "int64", "estimate": "float64"})

    return run


def _survivors(centre: np.ndarray, turn: np.ndarray, errors: float):
    """(qid, vector of the query, cids): the codes of one block whose lower bounds are within the queries' limits."""

    def run(key, codes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(codes) and len(queries):
            block = Codes(codes, len(centre))
            asked, limit = np.stack(queries["vector"]).astype(np.float64), queries["reach"].to_numpy() ** 2 * (1 + 1e-9) + 1e-9
            for at in range(0, len(asked), STEP):
                low = block.lower(asked[at : at + STEP], centre, turn, errors)
                found += [block.cid[np.flatnonzero(x <= y)] for x, y in zip(low, limit[at : at + STEP], strict=True)]
        queries = queries.iloc[: len(found)]
        return pd.DataFrame({"block": queries["block"], "part": queries["q_block"] // QUERY_BLOCKS, "qid": queries["qid"], "asked": queries["vector"], "cids": found})[[len(x) > 0 for x in found]]

    return run


def _measured(k: int):
    """(qid, cid, score): the k nearest survivors of one block for each query, by exact distances."""

    def run(key, survivors: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = {"qid": [], "cid": [], "score": []}
        if len(survivors) and len(vectors):
            order = np.argsort(vectors["cid"].to_numpy())
            ids, all_ = vectors["cid"].to_numpy()[order], np.stack(vectors["vector"])[order]
            for qid, asked, cids in zip(survivors["qid"], survivors["asked"], survivors["cids"], strict=True):
                own = all_[np.searchsorted(ids, cids)].astype(np.float64)
                score = np.sqrt(((own - np.asarray(asked, np.float64)) ** 2).sum(1))
                best = np.lexsort((cids, score))[:k]
                out["qid"].append(np.full(len(best), qid))
                out["cid"].append(cids[best])
                out["score"].append(score[best])
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0) for c, x in out.items()}).astype({"qid": "int64", "cid": "int64", "score": "float64"})

    return run


def usable(vector: str, dim: int):
    """Whether a vector has ``dim`` components, all finite, not all zero."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, errors: float = 1.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` to each of ``queries``, without the query itself.

    ``score`` is the Euclidean distance in double precision; ties go to smaller ids.  ``errors`` is the multiple of
    the standard error in the bounds; larger loses less.  Null, zero and non-finite vectors, null ids and vectors
    of another length than the most common one take no part.  A repeated row is one more candidate, with
    its id; a query leaves out every row with its own id.  The centre is the mean of a sample of SAMPLE
    rows by a hash of the id; every row is indexed.  Empty tables give an empty result.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    lengths = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 1
    element = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    kind = f"array<{element}>"

    def clean(df: DataFrame) -> DataFrame:
        known = df.withColumn(vector_col, F.col(vector_col).cast(kind))
        return known.where(usable(vector_col, dim) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x + F.lit(0.0).cast(element)).alias("vector"))

    # of equal rows one stands for all, with their number
    rows = clean(vectors).groupBy("vector", "id").agg(F.count("*").alias("times"))
    rows = written(rows, "ann-rows")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    centre = np.mean([r["vector"] for r in sample], axis=0) if sample else np.zeros(dim)
    turn = rotation(dim)
    # the first ids of equal vectors: the rank limit is applied before the shuffle as well
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    classes = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vector").agg(F.min("id").alias("cid"), F.sort_array(F.collect_list(F.struct("id", "times"))).alias("ids"))
    n_codes = rows.select("vector").distinct().count()
    code_blocks = max(1, -(-n_codes // CODE_BLOCK))
    classes = written(classes.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(code_blocks)).cast("int")), "ann-classes")
    asked = written(clean(queries).select("id", "vector").distinct(), "ann-queries")
    asked_classes = written(asked.groupBy("vector").agg(F.min("id").alias("qid")), "ann-asked")
    query_blocks = max(1, -(-asked_classes.count() // QUERY_BLOCK))
    codes = classes.select("cid", "vector", "block").mapInPandas(_codes(centre, turn), "cid long, code binary, f double, norm double, block int")
    codes = written(codes, "ann-codes").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(code_blocks - 1))).alias("block")
    own = asked_classes.select("qid", "vector", F.pmod(F.xxhash64("qid"), F.lit(query_blocks)).cast("int").alias("q_block"))
    in_blocks = codes.groupBy("block", "q_block")
    # first round: limits from the exact distances of the best estimates, a few for each query
    n = 2 * (k + 1)
    first = in_blocks.cogroup(own.select("*", blocks).groupBy("block", "q_block")).applyInPandas(_promising(centre, turn, n), "qid long, cid long, estimate double")
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("estimate", "cid"))).where(F.col("place") <= n)
    near = written(first.select("qid", "cid"), "ann-first").join(classes.select("cid", "vector"), "cid").join(own.select("qid", F.col("vector").alias("asked")), "qid")
    exact = F.sqrt(F.aggregate(F.zip_with("vector", "asked", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))
    placed = near.select("qid", exact.alias("score")).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("score")))
    limits = placed.where(F.col("place") <= k + 1).groupBy("qid").agg(F.when(F.count("*") > k, F.max("score")).otherwise(F.lit(float("inf"))).alias("reach"))
    # second round: the survivors of the bounds, and then their vectors
    limited = written(own.join(limits, "qid"), "ann-limits").select("*", blocks)
    open_ = in_blocks.cogroup(limited.groupBy("block", "q_block")).applyInPandas(_survivors(centre, turn, errors), f"block int, part int, qid long, asked {kind}, cids array<long>")
    parts = -(-query_blocks // QUERY_BLOCKS)
    vectors_in = classes.select("cid", "vector", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    near = written(open_, "ann-open").groupBy("block", "part").cogroup(vectors_in.groupBy("block", "part")).applyInPandas(_measured(k + 1), "qid long, cid long, score double")
    # (k + 1) of each block are left; of all blocks, the first again, with the ids of equal vectors
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("score", "cid"))).where(F.col("place") <= k + 1).drop("place")
    ids = first.join(classes.select("cid", "ids"), "cid").select("qid", F.explode("ids").alias("one"), "score").select("qid", "one.id", "one.times", "score")
    each = asked.join(asked_classes, "vector").select(F.col("id").alias("query_id"), "qid")
    found = each.join(written(ids, "ann-near"), "qid").where("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    # repeated rows are candidates each; k of them are enough
    repeated = found.select("query_id", "score", F.explode(F.array_repeat("id", F.least("times", F.lit(k)).cast("int"))).alias("vec_id"))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return repeated.withColumn("rank", again).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
