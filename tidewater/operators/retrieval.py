"""Lexical and vector retrieval, reciprocal rank fusion, enrichment, packets and routes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.functions import text as T

K1, B = 1.2, 0.75
MANY = 1000


def postings(chunks: DataFrame, key: str = "rid", text: str = "text") -> DataFrame:
    """(key, term, tf, length): how often each term stands in each row, and the row's number of terms."""
    rows = chunks.select(key, T.terms(F.col(text)).alias("terms")).select(key, F.size("terms").alias("length"), F.inline(T.counted(F.col("terms"))))
    if _repeats(chunks, [key]):
        return rows.groupBy(key, "term", "length").agg(F.sum("tf").alias("tf"))
    return rows.select(key, "term", "length", "tf")


def _repeats(rows: DataFrame, keys: list[str]) -> bool:
    """Whether rows share a key; where none do, a row's terms are counted in the row and nothing is shuffled."""
    return not rows.groupBy(*keys).count().where("count > 1").isEmpty()


def positional(rows: DataFrame, keys: list[str], terms: str = "terms") -> DataFrame:
    """(keys, term, tf, length, positions) of rows with arrays of terms: the places, from 0, at which each term stands, in order."""
    length = F.size(terms).cast("long").alias("length")
    if not _repeats(rows, keys):
        return rows.select(*keys, length, F.inline(T.placed(F.col(terms)))).select(*keys, "term", "tf", "length", "positions")
    each = rows.select(*keys, length, F.posexplode(terms).alias("place", "term"))
    found = each.groupBy(*keys, "term", "length").agg(F.sort_array(F.collect_list("place")).alias("positions"))
    return found.select(*keys, "term", F.size("positions").cast("long").alias("tf"), "length", "positions")


def of_terms(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """The stored postings of the terms of ``asked``.

    Up to MANY terms go into the scan as values, so that files and pages without them are skipped by their statistics; more are joined.
    """
    words = [r["term"] for r in asked.select("term").distinct().limit(MANY + 1).collect()]
    return stored.where(F.col("term").isin(words)) if len(words) <= MANY else stored.join(asked.select("term").distinct(), "term", "left_semi")


def in_a_row(hits: DataFrame, asked: DataFrame, key: str = "rid") -> DataFrame:
    """(query_id, key, n): rows of ``hits`` (key, term, positions) in which the terms of a query of ``asked`` (query_id, place, term) stand one behind the other, n times."""
    wanted = asked.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    starts = hits.join(asked, "term").select("query_id", key, "place", F.transform("positions", lambda p: p - F.col("place")).alias("starts"))
    # as many arrays for a row as its query has terms
    rows = starts.groupBy("query_id", key).agg(F.collect_list("starts").alias("all")).join(wanted, "query_id").where(F.size("all") == F.col("n_terms"))
    common = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda have, more: F.array_intersect(have, more))
    return rows.select("query_id", key, F.size(common).cast("long").alias("n")).where("n > 0")


def indexed_search(stored: DataFrame, lengths: DataFrame, queries: DataFrame, k: int = 20, key: str = "rid") -> DataFrame:
    """``lexical_search`` from stored postings (key, term, length, tf) of the rows in ``lengths`` (key, length), and of no others; texts are not read."""
    asked = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"))
    hits = of_terms(stored, asked).select(key, "term", "length", "tf").join(lengths.select(key), key, "left_semi")
    stats = lengths.agg(F.count(key).alias("n_docs"), F.avg("length").alias("mean"))
    return rank_postings(hits, stats, asked, k, key)


def lexical_search(chunks: DataFrame, queries: DataFrame, k: int = 20, key: str = "rid", text: str = "text") -> DataFrame:
    """(query_id, key, score, rank): the k best rows that hold all terms of each of ``queries`` (query_id, query).

    Okapi BM25; document frequencies are counted for the queries' terms alone, and ties go to the smaller key.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"))
    found = T.terms(F.col(text))
    sized = chunks.select(key, found.alias("terms"), F.size(found).alias("length"))
    stats = sized.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))
    hits = sized.select(key, "length", F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy(key, "term", "length").agg(F.count("*").alias("tf"))
    return rank_postings(hits, stats, asked, k, key)


def rank_postings(hits: DataFrame, stats: DataFrame, asked: DataFrame, k: int, key: str) -> DataFrame:
    """The k best rows of ``hits`` (key, term, length, tf) for each query of ``asked`` (query_id, term), that hold all its terms."""
    wanted = asked.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.join(df, "term").crossJoin(F.broadcast(stats)).join(asked, "term")  # stats: one row
    rows = scored.groupBy("query_id", key).agg(F.count("*").alias("met"), F.round(F.sum(part), 6).alias("score")).join(wanted, "query_id").where("met = n_terms")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def cosine_distance(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_search(vectors: DataFrame, query: list[float], k: int = 20, key: str = "rid", vector: str = "embedding") -> DataFrame:
    """(key, score, rank): the k rows nearest to one query vector by cosine distance; ties go to the smaller key."""
    target = F.array(*(F.lit(float(x)) for x in query))
    near = vectors.where(F.col(vector).isNotNull()).select(key, F.round(cosine_distance(F.col(vector), target), 6).alias("score")).orderBy("score", key).limit(k)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("score", key)))  # k rows


def fuse(lexical: DataFrame, vector: DataFrame, k: int = 10, rrf_k: int = 60, key: str = "rid") -> DataFrame:
    """(key, score, lexical_rank, vector_rank, rank): sums of 1 / (rrf_k + rank + 1); ties keep the lexical order first."""
    a, b = lexical.select(key, F.col("rank").alias("lexical_rank")), vector.select(key, F.col("rank").alias("vector_rank"))
    part = lambda c: F.coalesce(1 / (F.lit(float(rrf_k)) + F.col(c) + 1), F.lit(0.0))
    both = a.join(b, key, "full").withColumn("score", F.round(part("lexical_rank") + part("vector_rank"), 9))
    order = [F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("vector_rank")]
    best = both.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def enrich(ranked: DataFrame, docs: DataFrame, key: str = "rid") -> DataFrame:
    """Ranked rows with title, uri, classification and snippet; rows that are gone drop out."""
    return ranked.join(docs.select(key, "doc_rid", "title", "source_uri", "section_path", "classification", T.snippet(F.col("text")).alias("snippet")), key)


def packet(hits: DataFrame) -> DataFrame:
    """(doc_rid, source_uri, first_rank): each document of the hits once, in the order in which it first comes up."""
    first = F.row_number().over(Window.partitionBy("doc_rid").orderBy("rank"))
    return hits.withColumn("n", first).where("n = 1").select("doc_rid", "source_uri", F.col("rank").alias("first_rank"))


def prompt_text(hits: DataFrame) -> DataFrame:
    """One row: the evidence as text, a heading and the snippet for each hit in rank order.  The hits are top-k rows."""
    one = F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(" ["), F.col("title"), F.lit("] ("), F.col("section_path"), F.lit(")\nsource: "), F.col("source_uri"), F.lit("\nlevel: "), F.col("classification"), F.lit("\n"), F.col("snippet"))
    parts = hits.agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("t")))).alias("parts"))
    return parts.select(F.concat(F.lit("## Evidence\n"), F.array_join(F.transform("parts", lambda p: p["t"]), "\n")).alias("prompt"))


def route(query: Column, n_entities: Column, requested: Column, settings: dict[str, Any]) -> Column:
    """The asked route, or by the entities named and the words used."""
    low = F.lower(query)

    def any_of(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    auto = F.when(n_entities >= 2, "graph_then_hybrid").when(any_of(settings["graph_keywords"]), "hybrid_then_graph").when(any_of(settings["diff_keywords"]), "graph_then_hybrid").otherwise("hybrid_only")
    return F.when(requested == "auto", auto).otherwise(requested)

