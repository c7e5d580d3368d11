"""Who may see what: ordered clearances and the filter that stands directly on every scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Levels in ascending order.
LEVELS = ("PUBLIC", "INTERNAL", "RESTRICTED")


def level(name: Column) -> Column:
    """The order of a resource's level; an unknown one counts as the highest."""
    return F.when(name == LEVELS[0], 0).when(name == LEVELS[1], 1).otherwise(2)


def clearance(name: str) -> int:
    """The order of a reader's clearance; an unknown one counts as the lowest."""
    return LEVELS.index(name) if name in LEVELS else 0


def base_filter(df: DataFrame, tenant: str, clearance_name: str = "INTERNAL") -> DataFrame:
    """Active rows of the tenant that are not quarantined and within the clearance."""
    return df.where((F.col("tenant") == tenant) & (level(F.col("classification")) <= clearance(clearance_name)) & ~F.col("is_quarantined") & (F.col("status") == "active"))
