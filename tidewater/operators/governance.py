"""Classification, PII scan and quarantine, as expressions compiled from the settings."""

from __future__ import annotations

from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewater.functions import text as T


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regex; ``*`` also crosses ``/``."""
    out = []
    for c in pattern:
        out.append(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "/_-" else "\\" + c)
    return "(?s)^" + "".join(out) + "$"


def pii_types(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns found in the text; a card number must have 16 digits and pass the Luhn check."""
    found = []
    for name, pattern in patterns.items():
        if name == "credit_card":
            digits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
            hit = F.exists(digits, lambda d: (F.length(d) == 16) & F.call_function("luhn_check", d))
        else:
            hit = text.rlike(pattern)
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found))


def pii_matches(text: Column, patterns: dict[str, str]) -> Column:
    """(type, count) of each pattern that is found; Luhn applies to cards."""
    rows = []
    for name, pattern in patterns.items():
        if name == "credit_card":
            digits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
            n = F.size(F.filter(digits, lambda d: (F.length(d) == 16) & F.call_function("luhn_check", d)))
        else:
            n = F.regexp_count(text, F.lit(pattern))
        rows.append(F.struct(F.lit(name).alias("pii_type"), n.cast("int").alias("n")))
    return F.filter(F.array(*rows), lambda r: r["n"] > 0)


def usable_patterns(spark: SparkSession, patterns: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """(patterns that compile, what is wrong with the others): a broken pattern is left out and told, and costs no document."""
    good, bad = {}, {}
    for name, pattern in patterns.items():
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
            good[name] = pattern
        except IllegalArgumentException as e:
            bad[name] = str(e)
    return good, bad


def ingest_outcomes(classified: DataFrame, chunks: DataFrame, owner: str = "doc_rid", error: str = "embed_error") -> DataFrame:
    """(rid, outcome, stage, n_chunks, n_failed) of each of ``classified`` (rid, is_quarantined), from its ``chunks`` (owner, error).

    quarantined: held back; skipped: nothing to index; failed: no chunk came through the stage; else indexed.  Some failed chunks name the
    stage without failing the document.
    """
    own = chunks.groupBy(F.col(owner).alias("__owner")).agg(F.count("*").alias("n_chunks"), F.count(error).alias("n_failed"))
    rows = classified.select("rid", "is_quarantined").join(own, F.col("rid") == F.col("__owner"), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_chunks", "n_failed")})
    outcome = F.when(F.col("is_quarantined"), "quarantined").when(F.col("n_chunks") == 0, "skipped").when(F.col("n_failed") == F.col("n_chunks"), "failed").otherwise("indexed")
    return rows.select("rid", outcome.alias("outcome"), F.when(~F.col("is_quarantined") & (F.col("n_failed") > 0), "embed").alias("stage"), "n_chunks", "n_failed")


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def doc_type(path: Column, stated: Column, rules: list) -> Column:
    out = F.lit("markdown")
    for keys, name in reversed(rules):
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.lower(path).contains(k)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.coalesce(F.nullif(stated, F.lit("")), out)


def classify(docs: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """``docs`` (path, text, frontmatter map) with classification, is_quarantined, pii_types, language and doc_type.

    PII decides first and leaves language and type at their defaults.  Else the first path rule, then the
    extension, which only raises, then the front matter, which can't lower RESTRICTED.
    """
    path, front = F.col("path"), F.col("frontmatter")
    by_path = F.lit("INTERNAL")
    for pattern, name in reversed(settings["path_rules"]):
        by_path = F.when(path.rlike(glob_regex(pattern)), F.lit(name)).otherwise(by_path)
    by_file = F.when(_extension(path).isin(settings["restricted_extensions"]), F.lit("RESTRICTED")).otherwise(by_path)
    stated = F.upper(F.try_element_at(front, F.lit("classification")))
    final = F.when(stated.isin("PUBLIC", "INTERNAL", "RESTRICTED") & ((by_file != "RESTRICTED") | (stated == "RESTRICTED")), stated).otherwise(by_file)
    rows = docs.withColumn("pii_types", pii_types(F.col("text"), settings["pii_patterns"]))
    hit = F.size("pii_types") > 0
    return rows.withColumns(
        {
            "is_quarantined": hit,
            "classification": F.when(hit, "RESTRICTED").otherwise(final),
            "language": F.when(hit, "ko").otherwise(T.language(F.col("text"))),
            "doc_type": F.when(hit, "markdown").otherwise(doc_type(path, F.try_element_at(front, F.lit("doc_type")), settings["doc_types"])),
        }
    )


def outcomes(classified: DataFrame) -> DataFrame:
    """One row of ingest counters: total, quarantined, skipped (no text), indexed."""
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    return classified.agg(
        F.count("*").alias("total"),
        F.count_if("is_quarantined").alias("quarantined"),
        F.count_if(~F.col("is_quarantined") & empty).alias("skipped"),
        F.count_if(~F.col("is_quarantined") & ~empty).alias("indexed"),
    )
