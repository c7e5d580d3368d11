"""The stored tables: 18 common columns, then each table's own, and the checks that hold for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

COMMON = "rid string, rtype string, tenant string, classification string, owner string, source_uri string, source_version string, source_kind string, hash string, labels array<string>, is_quarantined boolean, quality_flags array<string>, status string, created_at timestamp, updated_at timestamp, prov_pipeline string, prov_inputs array<string>, prov_transform string"
TABLES = {
    "documents": "title string, doc_type string, language string, content_hash string",
    "chunks": "doc_rid string, section_path string, chunk_text string, context_prefix string, search_text string, embedding array<float>, chunk_index int, embed_model string, metadata string",
    "entities": "entity_type string, name string, aliases array<string>, description string",
    "edges": "edge_type string, from_rid string, to_rid string, confidence double, source_category string",
    "observed_edges": "edge_type string, from_rid string, to_rid string, call_count int, error_rate double, latency_p50 double, latency_p95 double, latency_p99 double, protocol string, interaction_style string, sample_trace_ids array<string>, trace_query_ref string, resolved_via string, window_start timestamp, window_end timestamp, last_seen_at timestamp",
    "evidence": "subject_rid string, evidence_rid string, kind string, weight double, note string",
}
DEFAULTS = {"tenant": "default", "classification": "INTERNAL", "status": "active", "is_quarantined": False}
EDGE_TYPES = ("CALLS", "PUBLISHES", "SUBSCRIBES")


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(f"{COMMON}, {TABLES[table]}")


def complete(df: DataFrame, table: str) -> DataFrame:
    """``df`` with all columns of the table: defaults where there are any, else null; of a chunk also its search text."""
    from tidewater.functions.text import search_text

    def column(f: T.StructField):
        own = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in DEFAULTS:
            own = F.coalesce(own, F.lit(DEFAULTS[f.name]))
        return own.cast(f.dataType).alias(f.name)

    out = df.select(*map(column, schema(table)))
    if table == "chunks":
        out = out.withColumn("search_text", search_text(F.col("context_prefix"), F.col("section_path"), F.col("chunk_text")))
    return out


def violations(table: str, df: DataFrame, entities: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """(rule, rid): rows that break a key, a range or a reference."""
    found = [df.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("rid is unique").alias("rule"), "rid")]
    if table in ("edges", "observed_edges"):
        found.append(df.where(~F.col("edge_type").isin(*EDGE_TYPES)).select(F.lit("edge type is known"), "rid"))
        if entities is not None:
            for end in ("from_rid", "to_rid"):
                found.append(df.join(entities.select(F.col("rid").alias(end)), end, "left_anti").select(F.lit(f"{end} is an entity"), "rid"))
    if table == "edges":
        found.append(df.where(~F.col("confidence").between(0, 1)).select(F.lit("confidence is within 0 and 1"), "rid"))
    if table == "evidence":
        found.append(df.where(~F.col("weight").between(0, 1)).select(F.lit("weight is within 0 and 1"), "rid"))
    if table == "entities":
        found.append(df.groupBy("tenant", "entity_type", "name").agg(F.count("*").alias("n"), F.min("rid").alias("rid")).where("n > 1").select(F.lit("name is unique"), "rid"))
    if table == "chunks" and documents is not None:
        found.append(df.join(documents.select(F.col("rid").alias("doc_rid")), "doc_rid", "left_anti").select(F.lit("doc_rid is a document"), "rid"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
