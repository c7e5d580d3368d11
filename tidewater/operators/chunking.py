"""Markdown into sections, paragraphs and packed chunks."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.functions import text as T
from tidewater.functions.ids import chunk_rid

STRIP = r"(?U)^\s+|\s+$"


def sections(docs: DataFrame, key: str = "rid", text: str = "text") -> DataFrame:
    """(key, section, section_path, section_text): one row for each H1/H2 section with text, in order.

    The windows run over the lines of one document.  Headings inside code fences split, too.
    """
    lines = docs.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("i", "line"))
    lines = lines.withColumn("s", F.regexp_replace("line", STRIP, ""))
    h2, h1 = F.col("s").startswith("## "), F.col("s").startswith("# ")
    by = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.select(
        key, "i", "line",
        F.sum((h1 | h2).cast("int")).over(by).alias("section"),
        F.last(F.when(h1, F.struct("i", F.regexp_replace(F.substring("s", 3, 1 << 30), STRIP, "").alias("t"))), ignorenulls=True).over(by).alias("h1"),
        F.last(F.when(h2, F.struct("i", F.regexp_replace(F.substring("s", 4, 1 << 30), STRIP, "").alias("t"))), ignorenulls=True).over(by).alias("h2"),
    )
    parts = lines.groupBy(key, "section").agg(F.max("h1").alias("h1"), F.max("h2").alias("h2"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("raw"))
    top = F.coalesce(F.col("h1.t"), F.lit(""))
    sub = F.when(F.col("h1").isNull() | (F.col("h2.i") > F.col("h1.i")), F.coalesce(F.col("h2.t"), F.lit(""))).otherwise("")
    path = F.when(sub == "", top).when(top == "", sub).otherwise(F.concat(top, F.lit(" > "), sub))
    path = F.when(path == "", "root").otherwise(path)
    return parts.select(key, "section", path.alias("section_path"), F.regexp_replace("raw", STRIP, "").alias("section_text")).where("section_text <> ''")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines; a fenced block is one whole paragraph."""
    empty = F.array().cast("array<string>")

    def closed(s: Column) -> Column:
        return F.when(F.size(s["block"]) > 0, F.array_append(s["done"], F.array_join(s["block"], "\n"))).otherwise(s["done"])

    def step(s: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, STRIP, "")
        fence = bare.startswith("```")
        grown = F.array_append(s["block"], line)
        return (
            F.when(fence & s["code"], F.struct(F.array_append(s["done"], F.array_join(grown, "\n")).alias("done"), empty.alias("block"), F.lit(False).alias("code")))
            .when(fence, F.struct(closed(s).alias("done"), F.array(line).alias("block"), F.lit(True).alias("code")))
            .when(s["code"] | (bare != ""), F.struct(s["done"].alias("done"), grown.alias("block"), s["code"].alias("code")))
            .otherwise(F.struct(closed(s).alias("done"), empty.alias("block"), F.lit(False).alias("code")))
        )

    start = F.struct(empty.alias("done"), empty.alias("block"), F.lit(False).alias("code"))
    return F.aggregate(F.split(text, "\n"), start, step, closed)


def packed(pieces: Column, language: Column, target: Column, overlap: Column) -> Column:
    """Paragraphs packed in order up to ``target`` tokens; the last ones, up to ``overlap`` tokens, are carried over.

    A paragraph larger than the target stands alone when nothing is open, and joins what is carried over otherwise.
    """
    none = F.array().cast("array<struct<t:string,n:int>>")

    def text_of(open_: Column) -> Column:
        return F.array_join(F.transform(open_, lambda p: p["t"]), "\n\n")

    def carried(open_: Column) -> Column:
        start = F.struct(none.alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

        def back(s: Column, p: Column) -> Column:
            stop = s["full"] | (s["n"] + p["n"] > overlap)
            return F.when(stop, F.struct(s["kept"].alias("kept"), s["n"].alias("n"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(F.array(p), s["kept"]).alias("kept"), (s["n"] + p["n"]).alias("n"), F.lit(False).alias("full")))

        return F.aggregate(F.reverse(open_), start, back)

    def step(s: Column, p: Column) -> Column:
        alone = (p["n"] > target) & (F.size(s["open"]) == 0)
        over = (s["n"] + p["n"] > target) & (F.size(s["open"]) > 0)
        kept = carried(s["open"])
        return (
            F.when(alone, F.struct(F.array_append(s["done"], p["t"]).alias("done"), s["open"].alias("open"), s["n"].alias("n")))
            .when(over, F.struct(F.array_append(s["done"], text_of(s["open"])).alias("done"), F.array_append(kept["kept"], p).alias("open"), (kept["n"] + p["n"]).alias("n")))
            .otherwise(F.struct(s["done"].alias("done"), F.array_append(s["open"], p).alias("open"), (s["n"] + p["n"]).alias("n")))
        )

    sized = F.transform(pieces, lambda p: F.struct(p.alias("t"), T.token_estimate(p, language).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("open"), F.lit(0).alias("n"))
    return F.aggregate(sized, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.array_append(s["done"], text_of(s["open"]))).otherwise(s["done"]))


def chunks(docs: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """(rid, doc_rid, section_path, chunk_index, chunk_text, token_count) of ``docs`` (rid, text, language)."""
    parts = sections(docs).join(docs.select("rid", "language"), "rid")
    size = settings["chunk_tokens"]
    target = F.when(F.col("language") == "ko", F.lit(size["ko"])).otherwise(F.lit(size["other"]))
    overlap = F.floor(target * F.lit(settings["overlap_ratio"])).cast("int")
    whole = T.token_estimate(F.col("section_text"), F.col("language")) <= target
    pieces = F.when(whole, F.array("section_text")).otherwise(packed(paragraphs(F.col("section_text")), F.col("language"), target, overlap))
    rows = parts.select("rid", "section", "section_path", "language", F.posexplode(pieces).alias("part", "chunk_text"))
    index = F.row_number().over(Window.partitionBy("rid").orderBy("section", "part")) - 1
    rows = rows.select(F.col("rid").alias("doc_rid"), "section_path", index.alias("chunk_index"), "chunk_text", T.token_estimate(F.col("chunk_text"), F.col("language")).alias("token_count"))
    return rows.select(chunk_rid(F.col("doc_rid"), F.col("section_path"), F.col("chunk_index")).alias("rid"), "*")
