"""Numbering and running sums within keys, without all rows of a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import written

BLOCK = 4096


def running(df: DataFrame, key: str, at: str, columns: list[str], most: int) -> DataFrame:
    """``df`` with each of ``columns`` replaced by its sum over the rows of the key up to this one, in the order of ``at``.

    ``at`` is a whole number from 0 to ``most`` that no two rows of a key share; ``columns`` hold no nulls.  A window sees
    the ``BLOCK`` rows of a block at most; what stands before a block is the running sum over the blocks themselves.
    Works on empty tables.  ``df`` is read twice where ``most`` reaches past a block, so pass a written table.
    """
    name = f"__of_{at}"  # each level of blocks has a name of its own
    block = F.floor(F.col(at) / BLOCK).cast("long")
    window = Window.partitionBy(key, name).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumn(name, block).withColumns({c: F.sum(c).over(window) for c in columns})
    if most < BLOCK:
        return inside.drop(name)
    own = df.groupBy(key, block.alias(name)).agg(*(F.sum(c).alias(c) for c in columns))
    upto = running(own, key, name, columns, most // BLOCK)
    before = own.select(F.col(key).alias("__key"), F.col(name).alias("__own"), *(F.col(c).alias(f"__own_{c}") for c in columns))
    upto = upto.join(before, (F.col(key) == F.col("__key")) & (F.col(name) == F.col("__own")))
    upto = upto.select("__key", "__own", *((F.col(c) - F.col(f"__own_{c}")).alias(f"__own_{c}") for c in columns))
    joined = inside.join(upto, (F.col(key) == F.col("__key")) & (F.col(name) == F.col("__own")))
    return joined.withColumns({c: F.col(c) + F.col(f"__own_{c}") for c in columns}).select(*df.columns)


def numbered(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``pos``: the place, from 1, of each row among those of its key, in the given order.

    Rows are dealt by ranges of key and order, so that a key of any size spreads over many tasks, and counted by range.
    Rows that the order can't tell apart are numbered as the input has them.  ``key`` holds no nulls.
    """
    tie = df.withColumn("__tie", F.monotonically_increasing_id())
    by = [F.col(key), *order, F.col("__tie")]
    rows = tie.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie")
    rows = written(rows.withColumns({"__part": F.spark_partition_id(), "__line": F.monotonically_increasing_id()}), name)
    runs = rows.groupBy(key, "__part").agg(F.min("__line").alias("__begin"), F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that the key is in
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(F.col(key).alias("__key"), F.col("__part").alias("__range"), "__begin", "__before")
    joined = rows.join(runs, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__range")))
    return joined.select(*df.columns, (F.col("__line") - F.col("__begin") + F.col("__before") + 1).alias("pos"))
