"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversation_trie, decontamination, jaccard_join, license_scan, mixing, one_bit_search, periodic_runs, quality, secret_scan, sql, token_records, toxicity, url_filter
from .shared import scratch_path, written
from .substring_dedup import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed rules of the query (longest match wins).
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), similarity=0.8)


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-records")
    token_records.write_records(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_records.read_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return one_bit_search.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), length=35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    out = quality.score(docs, model)
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"), size=5, percent=80)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(conversation_trie.turns_in_order(table(spark, sf_dir, "conversations")), "conversation-turns")
    ids = turns.select("conv").distinct()
    convs = written(ids.select("conv", (F.col("conv") - F.col("conv") % 100).alias("base"), (F.crc32(F.col("conv").cast("string")) % 6).alias("h")), "conversation-ids")
    return conversation_trie.trie(conversation_trie.borrow_heads(turns, convs, most=5), convs.select("conv"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents; a tenth of them, by the hash of the id, repeat some words from one place on to the end.

    With h = crc32 of the id as text and g = h // 10, where h % 10 = 0: from word a = g % n on, word i is word a + (i - a) % p of
    the text, p = 1 + (n - a) // (3 + g % 8).  A null text counts as empty; a null id has no hash and leaves its text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("int")
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("__words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
    again = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("__words", F.when(i < a, i).otherwise(a + (i - a) % p))), " ")
    split = docs.select("doc_id", text.alias("text"), F.when(h % 10 == 0, words).alias("__words"))
    return split.select("doc_id", F.when(n > 0, again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_period(table(spark, sf_dir, "documents")), shortest=12)
    longest = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"])).when(x["start"] != y["start"], F.sign(x["start"] - y["start"])).otherwise(F.sign(x["period"] - y["period"])).cast("int"))
    found = found.withColumn("top", F.get(longest, F.lit(0)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_secret_scan": op2_secret_scan,
    "op3_license_scan": op3_license_scan,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_token_records": op5_token_records,
    "op6_source_mixing": op6_source_mixing,
    "op7_one_bit_search": op7_one_bit_search,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_toxicity": op12_toxicity,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op6_source_mixing": sql.MIX,
    "op8_substring_dedup": sql.REPEATS,
    "op10_ngram_jaccard_join": sql.COMPONENTS,
    "op11_conversation_trie": sql.TRIE,
}
