"""Markdown folders as tables of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FRONT = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"


def front_matter(text: Column) -> Column:
    """The leading block of plain ``key: value`` lines as a map; {} if there is none or if it is broken.

    A block is broken if a line that is not indented, empty or a comment has no key: its text then stays in the body.
    """
    block = F.regexp_extract(text, FRONT, 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w.-]*\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), "^[\"']|[\"']$", "").alias("value")))
    keys = F.transform(pairs, lambda p: p["key"])
    made = F.map_from_entries(F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"])))
    return F.when(sound(text), made).otherwise(F.create_map().cast("map<string,string>"))


def sound(text: Column) -> Column:
    """Whether every line of the leading block is a key, a list item, an indented line, a comment or empty."""
    return F.forall(F.split(F.regexp_extract(text, FRONT, 1), r"\r?\n"), lambda x: x.rlike(r"^(?:[A-Za-z_][\w.-]*\s*:(?:\s.*)?|\s+.*|-(?:\s.*)?|#.*|)$"))


def body(text: Column) -> Column:
    """The text without its leading block, unless that is broken."""
    return F.when(sound(text), F.regexp_replace(text, FRONT, "")).otherwise(text)


def collect(spark: SparkSession, folder: str, tenant: str = "default", pattern: str = "*.md") -> DataFrame:
    """(path, source_uri, content_hash, frontmatter, text) of all files below the folder that are valid UTF-8.

    The hash is of the raw text, front matter included.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    rows = raw.select(F.col("path").alias("file"), F.try_validate_utf8(F.decode("content", "UTF-8")).alias("raw"), "content")
    rows = rows.where(F.is_valid_utf8(F.col("content").cast("string")))
    root = folder.rstrip("/").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("file", "^file:/*", "/"), "^\\Q" + root + "\\E/", "")
    return rows.select(path.alias("path"), F.concat(F.lit(f"{tenant}:"), path).alias("source_uri"), F.sha2("content", 256).alias("content_hash"), front_matter(F.col("raw")).alias("frontmatter"), body(F.col("raw")).alias("text"))
