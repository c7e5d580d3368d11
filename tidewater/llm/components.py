"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import written


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node in its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    tied = both.where("b > a").join(least, F.col("a") == F.col("u"))
    return _distinct(tied.select(F.col("b").alias("a"), F.least("m", "u").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    tied = down.join(least, F.col("a") == F.col("u"))
    return _distinct(tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))


def stars(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(a, b): each linked node a but the smallest of its component, and that smallest node b.

    ``edges`` has a and b, of one orderable type.  Links from a node to itself and repeated links don't
    matter; nulls take no part.  A node's neighbours are never gathered: minima are aggregated and joined back.
    """
    edges, before = written(_distinct(edges.select("a", "b").where("a is not null and b is not null")), "stars"), None
    for _ in range(rounds):
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            return edges
        before = now
        if not now[0]:
            return edges
        edges = written(_small_star(written(_large_star(edges), "stars")), "stars")
    raise RuntimeError("components did not settle")
