"""Where designed and observed relations disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def edge_diff(designed: DataFrame, observed: DataFrame) -> DataFrame:
    """(diff_type, edge_rid, obs_rid, from_name, to_name, edge_type, confidence, call_count, latency_p95).

    Matched on both ends alone.  ``conflict`` is a known flag that nothing sets.
    """
    ends = ["from_rid", "to_rid"]
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    doc = designed.join(observed.select(*ends), ends, "left_anti").select(F.lit("doc_only").alias("diff_type"), F.col("rid").alias("edge_rid"), text.alias("obs_rid"), "from_name", "to_name", "edge_type", "confidence", F.lit(None).cast("long").alias("call_count"), number.alias("latency_p95"))
    obs = observed.join(designed.select(*ends), ends, "left_anti").select(F.lit("observed_only").alias("diff_type"), text.alias("edge_rid"), F.col("rid").alias("obs_rid"), "from_name", "to_name", "edge_type", number.alias("confidence"), "call_count", "latency_p95")
    return doc.unionByName(obs)


def summary(diff: DataFrame) -> DataFrame:
    """(diff_type, n) of the three flags, zero where there are none."""
    spark = diff.sparkSession
    flags = spark.createDataFrame([("doc_only",), ("observed_only",), ("conflict",)], "diff_type string")
    return flags.join(diff.groupBy("diff_type").agg(F.count("*").alias("found")), "diff_type", "left").select("diff_type", F.coalesce("found", F.lit(0)).alias("n"))


def filtered(diff: DataFrame, flag: str | None = None, entity: str | None = None) -> DataFrame:
    out = diff if flag is None else diff.where(F.col("diff_type") == flag)
    return out if entity is None else out.where((F.col("from_name") == entity) | (F.col("to_name") == entity))


def detail(diff: DataFrame) -> DataFrame:
    """Diff rows with a line of text; a missing value reads None."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return diff.withColumn("detail", F.concat(F.lit("confidence="), shown("confidence"), F.lit(", calls="), shown("call_count"), F.lit(", p95="), shown("latency_p95")))


def tag(rows: DataFrame, flagged: DataFrame, flag: str, key: str = "rid", flags: str = "quality_flags") -> DataFrame:
    """``rows`` with the flag once in the flags of those in ``flagged`` (key), and in no other's."""
    marks = flagged.select(F.col(key).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    out = rows.join(marks, F.col(key) == F.col("__key"), "left")
    clean = F.array_remove(F.coalesce(flags, F.array().cast("array<string>")), flag)
    return out.withColumn(flags, F.when(F.col("__hit"), F.array_append(clean, F.lit(flag))).otherwise(clean)).drop("__key", "__hit")


def with_evidence(edges: DataFrame, evidence: DataFrame, chunks: DataFrame, size: int = 200) -> DataFrame:
    """(edge_rid, evidence_rid, note, snippet): evidence of each edge with the text of its chunk, if there is one.

    Chunks with ``section_path`` and ``title`` give these, too.
    """
    from tidewater.functions.text import snippet

    links = edges.select(F.col("rid").alias("edge_rid")).join(evidence.select(F.col("subject_rid").alias("edge_rid"), "evidence_rid", "note"), "edge_rid")
    more = [c for c in ("section_path", "title") if c in chunks.columns]
    texts = chunks.select(F.col("rid").alias("evidence_rid"), snippet(F.col("chunk_text"), size).alias("snippet"), *more)
    return links.join(texts, "evidence_rid", "left").select("edge_rid", "evidence_rid", "note", "snippet", *more)


def diff_evidence(diff: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """The evidence of the edges that differ, of either side, with the kind of difference."""
    rows = diff.select("diff_type", F.coalesce("edge_rid", "obs_rid").alias("rid"))
    return with_evidence(rows, evidence, chunks).join(rows.select("diff_type", F.col("rid").alias("edge_rid")), "edge_rid")
