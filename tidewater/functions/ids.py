"""Identities: resource ids and canonical entity names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rid(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and the first 12 hex digits of SHA-256 over ``prefix:part:part...``; a null part counts as empty."""
    joined = F.concat_ws(":", F.lit(prefix), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 12))


def doc_rid(tenant: Column, uri: Column) -> Column:
    return rid("doc", tenant, uri)


def chunk_rid(doc: Column, section: Column, index: Column) -> Column:
    return rid("chunk", doc, section, index)


def entity_rid(tenant: Column, kind: Column, name: Column) -> Column:
    return rid("ent", tenant, kind, canonical_name(name))


def edge_rid(tenant: Column, kind: Column, source: Column, target: Column) -> Column:
    return rid("edge", tenant, kind, source, target)


def observed_rid(tenant: Column, kind: Column, source: Column, target: Column) -> Column:
    return rid("obs", tenant, kind, source, target)


def evidence_rid(subject: Column, evidence: Column) -> Column:
    return rid("evi", subject, evidence)


def canonical_name(name: Column) -> Column:
    """Trimmed, lower case, ``_`` and white space as ``-``, no repeated or outer ``-``."""
    low = F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))
    dashed = F.regexp_replace(F.regexp_replace(low, "_", "-"), r"(?U)\s+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-|-$", "")
